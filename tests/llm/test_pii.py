"""Personal data: base spans and the whole method against a plain Python version, planted phrases, odd rows."""

import hashlib
import math
import os
import re
from collections import defaultdict

import duckdb

from rankspark.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)


def fine(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and doubled % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(PATTERNS[kind], text) if fine(kind, m.group()))


def listed(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


T = r"[A-Za-z0-9@._%+()\x80-\U0010ffff-]"


def plain(texts, support, confidence, rounds, accept):
    """The whole method in dictionaries: spans of each text."""
    edges, bare, info, places = defaultdict(set), defaultdict(set), {}, defaultdict(list)
    for n, text in enumerate(texts):
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(T + "+", text)]
        seen = ["#" if re.search("[0-9@]", w) else w.lower() for *_, w in words]
        k = 0
        while k < len(words):
            if seen[k] != "#":
                left2, left, right = ("#" if k and seen[k - 1] == "#" else seen[k - 2] if k > 1 else ""), (seen[k - 1] if k else ""), (seen[k + 1] if k + 1 < len(seen) else "")
                for p in ((0, left), (1, left2, left), (2, left, right)):
                    bare[p].add(seen[k])
                k += 1
                continue
            end = k
            while end + 1 < len(words) and seen[end + 1] == "#" and text[words[end][1] : words[end + 1][0]] == " ":
                end += 1
            whole = text[words[k][0] : words[end][1]]
            lead = len(whole) - len(re.sub(r"^[@._%)-]*", "", whole))
            core = re.sub(r"[@._%+(-]*$", "", re.sub(r"^[@._%)-]*", "", whole))
            if core:
                own = [j for j, kind in enumerate(KINDS) if any(fine(kind, m.group()) for m in re.finditer(PATTERNS[kind], whole))]
                digits = len(re.sub("[^0-9]", "", core))
                left2, left, right = ("#" if k and seen[k - 1] == "#" else seen[k - 2] if k > 1 else ""), (seen[k - 1] if k else ""), (seen[end + 1] if end + 1 < len(seen) else "")
                for p in ((0, left), (1, left2, left), (2, left, right)):
                    edges[p].add(core)
                old = info.get(core)
                kind = own[0] if len(own) == 1 else -1
                info[core] = [bool(own) or bool(old and old[0]), kind if not old or old[1] == kind else -1, ["@" in core, *(digits >= pii.DIGITS[x] for x in ("ip", "card", "phone"))]]
                start = words[k][0] + lead
                places[core].append((n, start, start + len(core), bool(own)))
            k = end + 1
    edges = {p: v for p, v in edges.items() if len(v) >= support}
    found = {}
    for _ in range(rounds):
        reached = defaultdict(lambda: defaultdict(list))
        for p, values in edges.items():
            for k in range(4):
                total = weight = count = 0
                for v in values:
                    seed, kind, forms = info[v]
                    score = 1.0 if kind == k else found[v][1] if not seed and v in found and found[v][0] == k else 0.0
                    total, count = total + score, count + (score >= accept)
                    weight += 0.5 if not seed and v not in found and forms[k] else 1.0
                conf = total / (weight + len(bare[p]))
                if count >= support and conf >= confidence:
                    for v in values:
                        if not info[v][0] and info[v][2][k]:
                            reached[v][k].append(conf)
        found = {}
        for v, kinds in reached.items():
            scores = [(-(1 - math.prod(max(1 - c, 1e-12) for c in cs)), k) for k, cs in kinds.items()]
            score, k = min(scores)
            if -score >= accept:
                found[v] = (k, -score)
    out = [base(t) for t in texts]
    for v, (k, _) in found.items():
        for n, a, b, seed in places[v]:
            if not seed:
                out[n] = sorted({*out[n], (a, k, b)})
    return out, found


def test_query_equals_plain(spark, sf):
    got = {r.doc_id: r for r in queries.op12_contextual_pii(spark, sf).collect()}
    path = f"{sf}/documents.parquet"
    rows = duckdb.connect().execute(f"SELECT doc_id, coalesce(text, '') FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'").fetchall()
    spans, _ = plain([t for _, t in rows], pii.SUPPORT, pii.CONFIDENCE, pii.ROUNDS, pii.ACCEPT)
    assert len(got) == len(rows)
    for (doc, text), own in zip(rows, spans, strict=True):
        r, first = got[doc], base(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in first) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(listed(first).encode()).hexdigest() and r.spans == listed(own)


def phrases():
    """Seeds and unseen identifiers in fixed phrases, among texts without any."""
    texts = []
    for i in range(6):
        texts.append(f"Bonjour, number {i} speaking. Please call me at +1 (555) 010-9{i}{i}{i} today or never.")
        texts.append(f"Lines {i}: my card is 411111111111{['1111', '1129', '1137', '1145', '1152', '1160'][i]} thanks")
    texts += ["Éé 😀 please call me at 555-0134-77 today!", "you can call me at 0171.555.0188 today", "please call me at home today", "In 1999 we saw 123456 of 77777777 birds", "my card is 4111-1111-1111-1112 thanks"]
    # A second phrase that only found identifiers share with an unseen one.
    texts += ["reach desk line 555-0134-77 now", "reach desk line 0171.555.0188 now", "reach desk line 555-0222-11 now", "please call me at 555-0222-11 today", "reach desk line 555-0999-12 now", "the desk 12 34 5678901"]
    return texts


def test_very_long_texts_take_one_pass(spark):
    for text in ("x" * 3_000_000, "7" * 3_000_000, "+1" + " " * 3_000_000, "a@b.c 12 " * 300_000):
        (r,) = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        assert len(r.spans) == 300_000 * text.startswith("a@") and (not r.spans or tuple(r.spans[-1]) == (9 * 299_999, 0, 9 * 299_999 + 5))


def test_phrases_and_odd_rows(spark):
    texts = phrases() + ["", None, "a@b", "a@b.c.d@e.f 1.2.3.4.5 256.1.1.1 0255.1.1.1 1.2.3", "x" * 5_000, "7" * 5_000, "+1" + " " * 5_000, "has \x01 and \x01 call a@b.c\x01", "1 2-3 4 5 6 7 8 9 0 1 2 3 4", "@@ 5% (3) -", "a@b.c " * 3000 + "z", "q@x.y\nq@x.y"]
    texts += texts[:2]
    df = spark.createDataFrame([(i // 2, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, value int, pattern string")
    out = sorted((r.doc_id, r.spans and [tuple(s) for s in r.spans] or []) for r in pii.find(df).collect())
    want, found = plain([t or "" for t in texts], pii.SUPPORT, pii.CONFIDENCE, pii.ROUNDS, pii.ACCEPT)
    assert out == sorted((i // 2, own) for i, own in enumerate(want))
    assert set(found) >= {"555-0134-77", "0171.555.0188", "555-0222-11", "555-0999-12", "4111-1111-1111-1112"}, found
    assert not {"1999", "123456", "77777777", "12 34 5678901"} & set(found)
    assert pii.find(df.where("false")).collect() == []


def test_plain_tokens_and_their_patterns(spark, capsys):
    """Neighbours of the plain tokens, against a plain list; the text is cut into tokens once."""
    texts = [None, "", " ,;", "One", "9", "a 1b2 C@d e", "  ÉCOLE, x0 ΑΣ'Α! \u0663 (end) 7", "0 0 z z", "İx 😀y"]
    df = spark.createDataFrame([(t or "",) for t in texts], "__text string")
    hashes = lambda w: [r.h for r in spark.createDataFrame([(x,) for x in w], "w string").selectExpr("xxhash64(w) h").collect()]
    want = []
    for (text,) in spark.createDataFrame([(t or "",) for t in texts], "t string").selectExpr("lower(t)").collect():
        words = re.findall(T + "+", text)
        h = [0 if re.search("[0-9@]", w) else x for w, x in zip(words, hashes(words) if words else [], strict=True)]
        at = lambda i: h[i] if 0 <= i < len(h) else pii.EDGE  # noqa: B023, E731
        want += [(x, 0 if at(i - 1) == 0 else at(i - 2), at(i - 1), at(i + 1)) for i, x in enumerate(h) if x]
    tokens = pii._plain_tokens(df)
    assert sorted(map(tuple, tokens.collect())) == sorted(want) and len(want) == 12
    assert pii._plain_edges(tokens).count() == 3 * len(want)
    capsys.readouterr()
    tokens.explain()
    plan = capsys.readouterr().out
    assert plan.count("split(") == 1 and "arrays_zip" not in plan and "Generate posexplode" in plan


def test_only_tokens_behind_a_left_token_of_a_pattern_get_patterns(spark, monkeypatch):
    seen, own = [], pii._plain_edges
    monkeypatch.setattr(pii, "_plain_edges", lambda tokens: (seen.append(tokens), own(tokens))[1])
    texts = phrases() + [f"word{'abcdefgh'[i % 8]} other thing {i}x" for i in range(8)] + ["nothing here at all"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: [tuple(s) for s in r.spans or []] for r in pii.find(df).collect()}
    want, _ = plain(texts, pii.SUPPORT, pii.CONFIDENCE, pii.ROUNDS, pii.ACCEPT)
    assert out == dict(enumerate(want))
    every = pii._plain_tokens(df.select(pii.F.col("text").alias("__text"))).count()
    assert 0 < seen[-1].count() < every / 2
