"""Content-defined line chunks and removal of repeated ones (operator 10); DataFrame functions only.

A rolling hash over the digests of the last ``WINDOW`` lines ends a chunk after one line in ``DIVISOR`` on average, so
an insertion moves only the boundaries next to it. A unit is a chunk with two or more lines, or a chunk of one line with
the chunk after it. A unit with two or more lines that hold a word, which occurs again anywhere in the corpus, is removed
from all places but the first (smallest id, then place); what of it stays in the first place is only removed as part of
another unit with a still earlier place, so no line vanishes from the corpus. Units meet by digest, and only those whose
digest occurs twice are read again and compared byte by byte.

Defined results: null text stays null and has no line; an empty text has one empty line; repeated rows (same id and
text) count as places of their own but share one decision, so a chunk is never removed from every place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import row_key

WINDOW = 2
DIVISOR = 2


def _chunk_ends(window: int, divisor: int) -> Column:
    """The last line of each chunk, from the line digests in ``__digest``."""

    def last(i: Column) -> Column:
        rolled = F.md5(F.concat(*[F.when(i >= k, F.element_at("__digest", F.greatest(i - k, F.lit(0)) + 1)).otherwise("") for k in range(window - 1, -1, -1)]))
        return (F.conv(F.substring(rolled, 1, 8), 16, 10).cast("long") % divisor == 0) | (i == F.size("__digest") - 1)

    return F.filter(F.sequence(F.lit(0), F.size("__digest") - 1), last)


def _with_chunks(docs: DataFrame, window: int, divisor: int) -> DataFrame:
    """Adds ``chunks``: the chunk texts, in order."""
    lined = docs.withColumn("__lines", F.split("__text", "\n", -1)).withColumn("__digest", F.transform("__lines", F.md5)).withColumn("__ends", _chunk_ends(window, divisor))

    def chunk(end: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.element_at("__ends", F.greatest(k, F.lit(1))) + 1)
        return F.array_join(F.slice("__lines", start + 1, F.least(end - start + 1, F.size("__lines"))), "\n")  # two uses, so that the split stays outside the loop

    return lined.withColumn("chunks", F.transform("__ends", chunk)).drop("__digest", "__ends")


def _units(chunks: str) -> Column:
    """(place, span, unit) of the units of a text's chunks with two or more lines that hold a word."""
    one = lambda c: ~c.contains("\n")

    def unit(c: Column, i: Column) -> Column:
        after = F.get(F.col(chunks), i + 1)
        joined = one(c) & after.isNotNull()
        return F.struct(i.alias("place"), F.when(joined, 2).otherwise(1).alias("span"), F.when(joined, F.concat(c, F.lit("\n"), after)).otherwise(c).alias("unit"))

    return F.filter(F.transform(F.col(chunks), unit), lambda x: F.size(F.filter(F.split(x["unit"], "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))) > 1)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """``df`` with its text rewritten, and n_lines, n_removed_lines, n_chunks and n_removed_chunks added.

    Columns of these names, and those that start with two underscores, are replaced.
    """
    added = ["n_lines", "n_removed_lines", "n_chunks", "n_removed_chunks"]
    keys = [k for k in ("k1", "k2") if k in df.columns]
    rest = [c for c in df.columns if c not in (text_col, id_col, *added) and c not in keys and not c.startswith("__")]
    carried = [F.struct(*[F.col(f"`{c}`") for c in [*rest, *keys]]).alias("__rest")] if rest or keys else []
    docs = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *carried)
    docs = docs.select(*row_key("__id", "__text"), "__id", "__text", *["__rest"] * len(carried))
    # Digests first; the bytes of a chunk are read only where its digest occurs twice. Both joins below read one and
    # the same shuffle of the texts if there are no other columns. (The outer form of explode keeps Spark from
    # repeating the whole chunking in a filter of its own.)
    own = _with_chunks(docs.where("__text IS NOT NULL"), window, divisor).select("k1", "k2", F.explode_outer(F.transform(_units("chunks"), lambda x: F.struct(x["place"].alias("place"), F.md5(x["unit"]).alias("digest")))).alias("x")).select("k1", "k2", "x.*")
    twice = own.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1 AND digest IS NOT NULL").select("digest")
    some = own.join(twice, "digest", "left_semi").groupBy("k1", "k2").agg(F.collect_set("place").alias("some"))
    asked = _with_chunks(docs.join(some, ["k1", "k2"], "left"), window, divisor).withColumn("chunks", F.when(F.col("some").isNotNull(), F.col("chunks")))
    found = asked.select("k1", "k2", "__id", F.explode_outer(F.filter(_units("chunks"), lambda x: F.array_contains("some", x["place"]))).alias("x")).select("k1", "k2", "__id", "x.*").where("unit IS NOT NULL")
    place = F.struct("__id", "k1", "k2", "place")
    first = found.groupBy("unit").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    again = found.join(first, "unit").where(F.col("first") < place)
    gone = again.select("k1", "k2", F.explode(F.sequence("place", F.col("place") + F.col("span") - 1)).alias("place")).groupBy("k1", "k2").agg(F.collect_set("place").alias("gone"))
    both = _with_chunks(docs.join(gone, ["k1", "k2"], "left"), window, divisor)
    none = F.coalesce("gone", F.array().cast("array<int>"))
    kept = F.filter("chunks", lambda c, i: ~F.array_contains(none, i))
    count = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.size(F.split(x, "\n", -1)))
    out = both.select("__id", "__text", *["__rest"] * len(carried), "chunks", "__lines", F.when(F.size(none) > 0, kept).otherwise(F.col("chunks")).alias("kept"))
    out = out.select(
        F.col("__id").alias(id_col),
        F.when(F.size("kept") == F.size("chunks"), F.col("__text")).otherwise(F.array_join("kept", "\n")).alias(text_col),
        *[F.col("__rest").getField(c).alias(c) for c in [*rest, *keys]],
        F.coalesce(F.size("__lines").cast("long"), F.lit(0)).alias("n_lines"),
        F.when(F.size("kept") == F.size("chunks"), F.lit(0)).otherwise(F.size("__lines") - count("kept")).cast("long").alias("n_removed_lines"),
        F.coalesce(F.size("chunks").cast("long"), F.lit(0)).alias("n_chunks"),
        F.coalesce((F.size("chunks") - F.size("kept")).cast("long"), F.lit(0)).alias("n_removed_chunks"),
    )
    return out


SQL = """
WITH lines AS (
  SELECT doc_id, u.i AS i, list_extract(ls, u.i) AS line, len(ls) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), unnest(range(1, len(ls) + 1)) AS u(i)
), rolled AS (
  SELECT *, md5(concat(coalesce(lag(md5(line)) OVER w, ''), md5(line))) AS h FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ended AS (
  SELECT doc_id, i, line, n, CASE WHEN i = n OR CAST('0x' || substr(h, 1, 8) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS e FROM rolled
), numbered AS (
  SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM ended
), chunks AS (
  SELECT doc_id, place, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n, sum(CASE WHEN regexp_matches(line, '[^\\x20\\x09-\\x0D]') THEN 1 ELSE 0 END) AS m
  FROM numbered GROUP BY doc_id, place
), units AS (
  SELECT doc_id, place, CASE WHEN n = 1 AND after IS NOT NULL THEN chunk || chr(10) || after ELSE chunk END AS unit, CASE WHEN n = 1 AND after IS NOT NULL THEN 2 ELSE 1 END AS span,
    m + CASE WHEN n = 1 THEN coalesce(after_m, 0) ELSE 0 END AS worded
  FROM (SELECT *, lead(chunk) OVER w AS after, lead(m) OVER w AS after_m FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY place))
), again AS (
  SELECT doc_id, place, span FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, place) AS nth FROM units WHERE worded >= 2) WHERE nth > 1
), judged AS (
  SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM again a WHERE a.doc_id = c.doc_id AND (a.place = c.place OR (a.span = 2 AND a.place + 1 = c.place))) THEN 1 ELSE 0 END AS gone FROM chunks c
)
SELECT d.doc_id, CAST(coalesce(sum(j.n), 0) AS BIGINT) AS n_lines, CAST(coalesce(sum(CASE WHEN gone = 1 THEN j.n ELSE 0 END), 0) AS BIGINT) AS n_removed_lines,
  CAST(count(j.place) AS BIGINT) AS n_chunks, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed_chunks,
  md5(coalesce(string_agg(CASE WHEN gone = 0 THEN j.chunk END, chr(10) ORDER BY j.place), '')) AS kept_md5
FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""
