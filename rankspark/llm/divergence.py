"""Source divergence audit (operator 13): how far the sources of a language use its kept terms differently.

Plain relational steps. Terms are counted by (language, source, term) before anything is shuffled. A language keeps the
terms of at least ``LEAST`` of its rows. Every source of the language meets every kept term, with a count of 0 where it
never uses it, and gives it the share 1 + floor(10^9 * (count + 2) / (total + 2 * V)). The dense table is joined with
itself on language and term for pairs of sources, and held against the shares of the whole language for single terms.

Pairs are symmetric, so each is summed once, with partial sums before the shuffle. Sources meet kept terms in as many
parts of a language as there are shuffle partitions, so that a common language is no hot key; only the ten best terms of
a group pass through its window.

Defined results: null text, language and source are ''; each row is a document, repeated rows too; a group without a kept
term has pairs of value 0 and no term; a language of one source has no pair; equal values rank by the item's bytes; other
columns are left out, whatever their names; no row gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import shuffle_partitions, stored

#: Documents of its language that a kept term is in, at least; ranks of part ``term`` that are returned.
LEAST, TOP = 10, 10
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(df: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, count, docs): occurrences, and rows in which the term occurs."""
    named = lambda c, n: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
    text = F.coalesce(F.col(text_col), F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    # What lies between the matches of all other characters. In the sorted list, a term's first place stands for its row.
    terms = df.select(named(lang_col, "lang"), named(source_col, "source"), F.sort_array(F.split(lower, BETWEEN)).alias("terms"))
    each = terms.select("lang", "source", F.explode(F.arrays_zip("terms", F.concat(F.array(F.lit("")), "terms").alias("before"))).alias("x")).where("x.terms <> ''")
    first = F.when(F.col("x.terms") == F.col("x.before"), 0).otherwise(1)
    return each.groupBy("lang", "source", F.col("x.terms").alias("term")).agg(F.count("*").alias("count"), F.sum(first).alias("docs"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), in exact decimals."""
    exact = lambda c: c.cast("decimal(18,0)")
    return _div(exact(F.col(count) + 2) * F.lit(10**9).cast("decimal(10,0)"), exact(F.col(total) + 2 * F.col(terms))).cast("long") + 1


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); p and q are at most 10^9 + 1, so the square fits a long."""
    return _div((F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(p) + F.col(q))


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of parts ``pair`` (item: another source) and ``term`` (item: a term)."""
    named = lambda c, n: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
    parts = shuffle_partitions(df.sparkSession)
    counts = stored(term_counts(df, text_col, lang_col, source_col))
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"))
    used = counts.join(kept, ["lang", "term"]).groupBy("lang", "source").agg(F.sum("count").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_count").alias("lang_total"))
    groups = df.select(named(lang_col, "lang"), named(source_col, "source")).distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.fillna(0, ["total", "terms", "lang_total"]))

    part = F.pmod(F.xxhash64("term"), F.lit(parts))
    each = groups.where("terms > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    dense = each.join(kept.withColumn("part", part), ["lang", "part"]).join(counts.drop("docs"), ["lang", "source", "term"], "left").fillna(0, ["count"])
    dense = stored(dense.select("lang", "source", "term", "count", share("count", "total", "terms").alias("p"), share("lang_count", "lang_total", "terms").alias("q")))

    below, above = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    sums = below.join(above, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(divergence("p", "q")).alias("value"))
    bare = groups.where("terms = 0").select("lang", "source")
    zeros = bare.join(bare.withColumnRenamed("source", "item"), "lang").where(F.col("source") < F.col("item")).withColumn("value", F.lit(0).cast("long"))
    once = sums.unionByName(zeros)
    both = once.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.*", "value")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(best))
    pairs = ranked(both).withColumn("part", F.lit("pair"))
    terms = dense.where((F.col("count") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))
    terms = ranked(terms).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


_P = "1 + (1000000000 * (CAST({} AS HUGEINT) + 2)) // ({} + 2 * v)"
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), occ AS (SELECT r, lang, source, unnest(ts) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS lc FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}
), vocab AS (SELECT lang, count(*) AS v, sum(lc) AS ln FROM kept GROUP BY lang
), grp AS (SELECT DISTINCT lang, source FROM d
), cnt AS (SELECT o.lang, o.source, o.term, count(*) AS c FROM occ o SEMI JOIN kept k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL
), tot AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {_P.format("coalesce(c.c, 0)", "coalesce(t.n, 0)")} AS p, {_P.format("k.lc", "w.ln")} AS q
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN vocab w ON w.lang = g.lang
  LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN tot t ON t.lang = g.lang AND t.source = g.source
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM dense WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
