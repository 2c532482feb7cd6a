"""Conversation repair against an exhaustive search and on odd and long conversations; the query against SQL is in test_sql."""

import hashlib
import itertools
import random
import re

from rankspark.llm import conversations

SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """The cheapest edits of a short conversation by trying every number of insertions at every place."""
    best, seen, faults = None, set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, edits, strict=True)):
            continue
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * inserts[0] + "".join(e + "I" * n for e, n in zip(edits, inserts[1:], strict=True))
            cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[e] for e in audit) + sum(3 for f, e in zip(faults, edits, strict=True) if f == "truncated" and e != "D")
            if best is None or (cost, audit) < best[:2]:
                out, k = [], 0
                for e in audit:
                    role, text = rows[k][1:] if e != "I" else ("", "")
                    k += e != "I"
                    if e != "D":
                        due = "assistant" if out and out[-1][0][:1] == "u" else "user"
                        out.append((role if e == "K" else due, text))
                if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                    best = (cost, audit, out, faults)
    return best


def test_random_conversations(spark):
    draw, rows, want = random.Random(5), [], {}
    for conv in range(250):
        turns = sorted(draw.randint(0, 4) for _ in range(draw.randint(1, 4)))
        own = sorted((t, draw.choice(["user", "assistant", "system", "tool", "", "ux"]), draw.choice(["a.", "b", "c?\n", "", " \t", "a."])) for t in turns)
        rows += [(conv, *r) for r in own]
        want[conv] = plain(own)
    draw.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, conv int")
    got = {r.conv_id: r for r in conversations.report(df).collect()}
    for conv, (cost, audit, out, faults) in want.items():
        r = got[conv]
        assert (r.cost, r.audit) == (cost, audit), (conv, want[conv])
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    lines = sorted((r.conv_id, r.place, r.role, r.text) for r in conversations.repair(df).collect())
    assert lines == [(conv, k, *x) for conv in sorted(want) for k, x in enumerate(want[conv][2])]


def test_odd_rows(spark):
    rows = [
        (None, None, "user", "a."), (None, None, "assistant", "b."), (1, None, None, None), (1, 5, "user", "x."), (1, 9, "assistant", "y " * 10**6 + "."), (1, 9, "assistant", "y " * 10**6 + "."),
        (2, None, "user", "q."), (3, 2, "system", "s."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in conversations.report(df).collect()}
    assert got == {None: (0, 0, 0, 0, 0, 6, "IKKI"), 1: (3, 1, 1, 0, 2, 8, "DKKD"), 2: (0, 0, 0, 0, 0, 3, "KI"), 3: (0, 0, 0, 0, 0, 4, "D")}
    assert conversations.report(df.where("false")).collect() == [] and conversations.query(df.where("false")).collect() == []


def test_a_conversation_of_many_turns(spark):
    n = 60_000
    df = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 1000 = 3 THEN 'tool' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('turn ', id, '.') AS text")
    (r,) = conversations.report(df).collect()
    assert r.cost == 3 * n // 1000 and r.audit == "".join("R" if i % 1000 == 3 else "K" for i in range(n)) and r.gaps == 0
    assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:turn {i}." for i in range(n)).encode()).hexdigest()
    one = conversations.Repair()
    held = 0
    for i in range(n):
        one.add("user" if i % 2 == 0 else "assistant", ".", False, False)
        list(one.settled())
        held = max(held, len(one.turns))
    assert held < 3 * conversations.PENDING
