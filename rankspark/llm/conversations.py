"""Conversation structure repair (operator 11): the cheapest edits that give a conversation the form (system? (user assistant)+)?.

A forward Viterbi pass over four grammar states - nothing yet, after the system turn, after a user turn, after an
assistant turn - carries for each state the least (cost, audit string) with which it is reached. A turn is kept, given the
role that is due, or deleted; after each turn the layer is closed with the insertions that one turn can make useful, a
user and an assistant turn in this order. Ends are the first and the last state.

Rows of a conversation stand next to each other, in order, in one partition, and are read as a stream: of a conversation
only the turns are held on which its states do not agree yet, so its length does not matter for memory. A state that
costs over ``REACH`` more than the best can never win (from any state, any other one's future is within that cost), which
keeps the states close together. Whether role and text were seen before is told by Spark beforehand.

Defined results: a null role or text is one space; turns are ordered with nulls first, then by role and text; a null
conversation id is an id like any other; very long texts are only hashed or passed on; other columns are left out,
whatever their names; no row gives no row.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rankspark.llm.common import BATCH_BYTES

# Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept turn leads by its role's first letter, and where the role that is due leads.
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
DUE = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
REACH = 10
#: Letters of undecided audit from which the decided ones are split off.
PENDING = 4096


class Repair:
    """One conversation: turns come in by ``add``; ``settled`` and ``end`` give (edit, role, text) as they are decided."""

    def __init__(self) -> None:
        self.states: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self._close()
        self.turns: list[tuple[str, str]] = []
        self.at = NONE
        self.next_look = PENDING

    def _close(self) -> None:
        s = self.states
        for to in (USER, ASSISTANT):
            s[to] = min([x for x in (s[to], *((s[k][0] + INSERT, s[k][1] + "I") for k in range(4) if s[k] and DUE[k] == to)) if x], default=None)

    def add(self, role: str, text: str, drop: bool, truncated: bool) -> None:
        self.turns.append((role, text))
        new: list[tuple[int, str] | None] = [None] * 4
        extra, initial = TRUNCATED * truncated, role[:1]

        def offer(to: int, cost: int, audit: str) -> None:
            if new[to] is None or (cost, audit) < new[to]:
                new[to] = cost, audit

        for k, state in enumerate(self.states):
            if state:
                cost, audit = state
                offer(k, cost + DELETE, audit + "D")
                if not drop:
                    offer(DUE[k], cost + REROLE + extra, audit + "R")
                    if initial in KEEP[k]:
                        offer(KEEP[k][initial], cost + extra, audit + "K")
        self.states = new
        self._close()
        least = min(x[0] for x in self.states if x)
        self.states = [x if x and x[0] <= least + REACH else None for x in self.states]

    def settled(self) -> Iterator[tuple[str, str, str]]:
        """What all states agree on, once enough is undecided."""
        if max(len(x[1]) for x in self.states if x) >= self.next_look:
            same = os.path.commonprefix([x[1] for x in self.states if x])
            self.states = [x and (x[0], x[1][len(same) :]) for x in self.states]
            self.next_look = PENDING + 2 * max(len(x[1]) for x in self.states if x)
            yield from self._edits(same)

    def end(self) -> tuple[int, Iterator[tuple[str, str, str]]]:
        """The whole cost and the remaining edits."""
        cost, audit = min(x for x in (self.states[NONE], self.states[ASSISTANT]) if x)
        return cost, self._edits(audit)

    def _edits(self, audit: str) -> Iterator[tuple[str, str, str]]:
        used = 0
        for edit in audit:
            role, text = self.turns[used] if edit != "I" else ("", "")
            used += edit != "I"
            if edit in "RI":
                role = NAMES[DUE[self.at]]
            if edit != "D":
                self.at = KEEP[self.at][role[0]]
            yield edit, role, text
        self.turns = self.turns[used:]


def _marked(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, again), conversation by conversation in each partition, in order."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), some(role_col).alias("role"), some(text_col).alias("text"))
    seen = Window.partitionBy("conv", "role", "text").orderBy("turn")
    return rows.withColumn("again", F.row_number().over(seen) > 1).repartition("conv").sortWithinPartitions("conv", "turn", "role", "text", "again")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[int | None, str, str, bool]]]]:
    """(conversation, its turns) in turn; the turns of one must be used up before the next."""
    rows = (row for b in batches for part in range(0, b.num_rows, 256) for row in zip(*(c.to_pylist() for c in b.slice(part, 256).columns), strict=True))
    for conv, own in groupby(rows, key=lambda r: r[0]):
        yield conv, (r[1:] for r in own)


def _pieces(rows: Iterator[tuple[int | None, str, str, bool]], report: dict) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of a conversation, in order, while ``report`` is filled."""
    one, before, turns, low, high = Repair(), None, 0, None, None
    for turn, role, text, again in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if again else "truncated" if body[-1] not in ".!?" else None
        if fault:
            report[fault] += 1
        report["illegal"] += before is not None and before + role[:1] not in ("su", "ua", "au")
        before = role[:1]
        if turn is not None and turn != high:
            turns, low, high = turns + 1, turn if low is None else low, turn
        one.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        yield from one.settled()
    report["cost"], rest = one.end()
    yield from rest
    report["gaps"] = high - low + 1 - turns if turns else 0


def _together(records: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of up to 1000 records or about 4 MB of text."""
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record.get("text") or record.get("audit") or "")
        if len(held) == 1000 or size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def report(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: the id, counts of faults, cost, audit and the SHA-256 of the repaired ``role:text`` lines."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, rows in _conversations(batches):
            counts, audit, digest, first = dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), True
            for edit, role, text in _pieces(rows, counts):
                audit.append(edit)
                if edit != "D":
                    digest.update((b"" if first else b"\n") + f"{role}:{text}".encode())
                    first = False
            yield {"conv": conv, **counts, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    marked = _marked(df, conv_col, turn_col, role_col, text_col)
    fields = StructType([marked.schema["conv"], *[StructField(c, LongType()) for c in COUNTS], StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    schema = to_arrow_schema(fields)
    return marked.mapInArrow(lambda batches: _together(each(batches), schema), fields).withColumnRenamed("conv", conv_col)


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: the id, place (from 0), edit (K, R or I), role and text of each turn that is left."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, rows in _conversations(batches):
            place = 0
            for edit, role, text in _pieces(rows, dict.fromkeys(COUNTS, 0)):
                if edit != "D":
                    yield {"conv": conv, "place": place, "edit": edit, "role": role, "text": text}
                    place += 1

    marked = _marked(df, conv_col, turn_col, role_col, text_col)
    fields = StructType([marked.schema["conv"], StructField("place", LongType()), *[StructField(c, StringType()) for c in ("edit", "role", "text")]])
    schema = to_arrow_schema(fields)
    return marked.mapInArrow(lambda batches: _together(each(batches), schema), fields).withColumnRenamed("conv", conv_col)


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after a damage that crc32 of ``conv_id:turn`` chooses; nulls are one space there."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    rows = df.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"), kind.alias("kind"))
    copies: Column = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.where("kind <> 0").select("conv_id", "turn", "role", "text", copies).drop("copy")


def query(df: DataFrame) -> DataFrame:
    """``report`` of the damaged conversations, with every id that they had before."""
    found = report(damaged(df)).withColumnRenamed("conv_id", "own")
    every = df.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    return out.fillna(0, COUNTS).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})


def _then(key: str, cost: str | int, edit: str) -> str:
    """SQL: a state's key (nine digits of cost, then the audit) after one more edit."""
    return f"(lpad(CAST(CAST(substr({key}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({key}, 10) || '{edit}')"


_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, 8 * length(k)), lambda j: CAST((ascii(substr(k, CAST(j // 8 AS INT) + 1, 1)) >> CAST(j % 8 AS INT)) & 1 AS BIGINT))),
      lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""
SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), kinds AS (SELECT *, {_CRC} % 20 AS kind FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(0, 2) AS copies(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body FROM hurt
), faulty AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS two FROM placed
), turns AS (SELECT *, substr(role, 1, 1) AS c, fault IN ('blank', 'duplicate') AS bad, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM faulty
), layers(conv_id, i, n, s, u, a) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), '000000003I', '000000006II' FROM turns
  UNION ALL
  SELECT conv_id, i, n, s, u2, least(a1, {_then("u2", 3, "I")}) FROM (
    SELECT *, least(u1, {_then("least(n, s, a1)", 3, "I")}) AS u2 FROM (
      SELECT t.conv_id, t.i, {_then("l.n", 4, "D")} AS n,
        least({_then("l.s", 4, "D")}, CASE WHEN NOT t.bad AND t.c = 's' THEN {_then("l.n", "t.extra", "K")} END) AS s,
        least({_then("l.u", 4, "D")}, CASE WHEN NOT t.bad AND t.c = 'u' THEN {_then("least(l.n, l.s, l.a)", "t.extra", "K")} END, CASE WHEN NOT t.bad THEN {_then("least(l.n, l.s, l.a)", "t.extra + 3", "R")} END) AS u1,
        least({_then("l.a", 4, "D")}, CASE WHEN NOT t.bad AND t.c = 'a' THEN {_then("l.u", "t.extra", "K")} END, CASE WHEN NOT t.bad THEN {_then("l.u", "t.extra + 3", "R")} END) AS a1
      FROM layers l JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i + 1))
), best AS (SELECT conv_id, arg_max(least(n, a), i) AS k FROM layers GROUP BY conv_id
), edits AS (SELECT conv_id, substr(k, 10) AS audit, j, substr(k, CAST(9 + j AS INT), 1) AS e FROM best, unnest(range(1, length(k) - 8)) AS x(j)
), steps AS (
  SELECT conv_id, j, e, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS place FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), rows_out AS (
  SELECT s.*, t.role, t.text, max(CASE WHEN s.place = 1 AND s.e = 'K' AND t.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS system
  FROM steps s LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i AND s.e <> 'I' WHERE s.e <> 'D'
), texts AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (place + system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j)) AS h FROM rows_out GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  CAST(coalesce(substr(b.k, 1, 9), '0') AS BIGINT) AS cost, coalesce(substr(b.k, 10), '') AS audit, coalesce(t.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
