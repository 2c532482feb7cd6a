"""Registered queries on draws by permutations, each with its DuckDB text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from rankspark.operators import draws, tasks
from rankspark.plans.registry import POS, SUPPLIERS, positives, query, suppliers, table


def drawn_sql(p: str, wants: str, pools: str, barred: str, keys: Sequence[str], seed: str, attempts: int = 10) -> str:
    """CTEs that end in ``p``: keys, tcr, draw. ``wants``: keys, pool, k; ``pools``: pool, tcr; ``barred``: peptide, tcr."""
    own = ", ".join(keys)
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys)
    name = " || ':' || ".join([f"'{seed}'", *[f"CAST(w.{k} AS VARCHAR)" for k in keys]])
    word = lambda r, half: f"CAST('0x' || substr(md5(name || ':{r}:' || {half}), 1, 8) AS BIGINT)"
    turns = []
    for r in range(draws.ROUNDS):
        l, h = (f"(l + {word(r, 'r')}) % wide", "r") if r % 2 == 0 else ("l", f"(r + {word(r, 'l')}) % high")
        turns.append(f"{p}_{r + 1} AS (SELECT {own}, name, n, wide, high, tries, x, {l} AS l, {h} AS r FROM {p}_{r})")
    return f"""{p}_pool AS (SELECT pool, tcr, row_number() OVER (PARTITION BY pool ORDER BY md5('{seed}:' || tcr), tcr) - 1 AS place, count(*) OVER (PARTITION BY pool) AS n FROM (SELECT DISTINCT pool, tcr FROM ({pools}))
), {p}_barred AS (SELECT DISTINCT peptide, tcr FROM ({barred})
), {p}_size AS (SELECT pool, max(n) AS n, CAST(greatest(1, ceil(sqrt(max(n)))) AS BIGINT) AS wide FROM {p}_pool GROUP BY pool
), {p}_want AS (
  SELECT w.*, z.n, z.wide, CAST(greatest(1, ceil(z.n / z.wide)) AS BIGINT) AS high, {name} AS name, least(w.k * {attempts}, w.k + coalesce(b.c, 0), z.n) AS tries
  FROM ({wants}) w JOIN {p}_size z ON w.pool = z.pool LEFT JOIN (SELECT peptide, count(*) AS c FROM {p}_barred GROUP BY peptide) b ON b.peptide = w.peptide
), {p}_0 AS (SELECT {own}, name, n, wide, high, tries, x, x % wide AS l, x // wide AS r FROM {p}_want, unnest(range(0, wide * high)) AS u(x)
), {', '.join(turns)}, {p}_perm AS (SELECT {own}, n, tries, x, r * wide + l AS y FROM {p}_{draws.ROUNDS}
), {p}_walk AS (
  SELECT {own}, n, x AS attempt, y, 0 AS steps FROM {p}_perm WHERE x < tries
  UNION ALL SELECT {of('w')}, w.n, w.attempt, q.y, w.steps + 1 FROM {p}_walk w JOIN {p}_perm q ON {same('w', 'q')} AND q.x = w.y WHERE w.y >= w.n AND w.steps < {draws.WALKS}
), {p} AS (
  SELECT {own}, tcr, draw FROM (
    SELECT {of('t')}, o.tcr, t.k, row_number() OVER (PARTITION BY {of('t')} ORDER BY w.attempt) AS draw
    FROM {p}_want t JOIN {p}_walk w ON {same('t', 'w')} AND w.y < w.n JOIN {p}_pool o ON o.pool = t.pool AND o.place = w.y
    WHERE NOT EXISTS (SELECT 1 FROM {p}_barred b WHERE b.peptide = t.peptide AND b.tcr = o.tcr)) WHERE draw <= k)"""


KEYS = "(SELECT DISTINCT peptide FROM pos)"
ALL = "SELECT '' AS pool, tcr FROM pos"
FIRST = "(SELECT peptide, tcr, row_number() OVER (PARTITION BY peptide ORDER BY md5('{}:' || peptide || ':' || tcr), tcr) AS rn FROM (SELECT DISTINCT peptide, tcr FROM pos))"
HALVES = "SELECT CASE WHEN tcr % 2 = 0 THEN 'background' ELSE 'reshuffling' END AS pool, tcr FROM pos"


def halves(spark, sf_dir):
    return positives(spark, sf_dir).select(F.when(F.col("tcr") % 2 == 0, "background").otherwise("reshuffling").alias("pool"), "tcr")


_KSHOT = f"WITH RECURSIVE {POS}, " + drawn_sql("d", f"SELECT peptide, '' AS pool, 2 AS k FROM {KEYS}", ALL, "SELECT * FROM pos", ["peptide"], "kd") + f""", kshot AS (
SELECT peptide, tcr, 1 AS label FROM {FIRST.format('kd')} WHERE rn <= 2 UNION ALL SELECT peptide, tcr, 0 FROM d)"""


@query(f"{_KSHOT} SELECT peptide, tcr, label FROM kshot")
def kshot_draws(spark, sf_dir):
    pos = positives(spark, sf_dir)
    return draws.drawn_support(pos, pos, "peptide", "tcr", 2, "kd")


@query(f"WITH RECURSIVE {POS}, " + drawn_sql("d", f"SELECT peptide, CAST(round AS INT) AS round, CASE WHEN round % 2 = 0 THEN 'background' ELSE 'reshuffling' END AS pool, 2 AS k FROM {KEYS}, (SELECT unnest(range(0, 5)) AS round)", HALVES, "SELECT * FROM pos", ["peptide", "round"], "md") + f"""
SELECT peptide, CAST(round AS INT) AS round, tcr, 1 AS label, 'positive' AS source FROM {FIRST.format('md')}, (SELECT unnest(range(0, 5)) AS round) WHERE rn <= 2
UNION ALL SELECT peptide, round, tcr, 0, CASE WHEN round % 2 = 0 THEN 'background' ELSE 'reshuffling' END FROM d""")
def multi_round_draws(spark, sf_dir):
    pos = positives(spark, sf_dir)
    return draws.drawn_rounds(pos, pos.where("tcr % 2 = 0"), pos.where("tcr % 2 = 1"), "peptide", "tcr", 2, 5, "md")


EPOCHS = 20
_TASKS = f"fit AS (SELECT peptide FROM pos GROUP BY peptide HAVING count(*) >= 8), task AS (SELECT peptide, CAST(epoch AS INT) AS epoch, CASE WHEN epoch % 2 = 1 THEN 'background' ELSE 'reshuffling' END AS pool, 8 AS k FROM fit, (SELECT unnest(range(0, {EPOCHS})) AS epoch))"


@query(f"WITH RECURSIVE {POS}, {_TASKS}, " + drawn_sql("yes", "SELECT peptide, epoch, CAST(peptide AS VARCHAR) AS pool, k FROM task", "SELECT CAST(peptide AS VARCHAR) AS pool, tcr FROM pos", "SELECT * FROM pos WHERE false", ["peptide", "epoch"], "ad+", 100)
    + ", " + drawn_sql("no", "SELECT * FROM task", HALVES, "SELECT * FROM pos", ["peptide", "epoch"], "ad", 100)
    + " SELECT peptide, epoch, CASE WHEN draw <= 3 THEN 'support' ELSE 'query' END AS role, tcr, label FROM (SELECT *, 1 AS label FROM yes UNION ALL SELECT *, 0 FROM no)")
def alternating_draws(spark, sf_dir):
    """Tasks of twenty epochs in one plan; odd epochs draw negatives from the background, even ones from the reshuffled pool."""
    pos = positives(spark, sf_dir)
    epochs = spark.range(EPOCHS).select(F.col("id").cast("int").alias("epoch"), F.when(F.col("id") % 2 == 1, "background").otherwise("reshuffling").alias("pool"))
    return draws.drawn_tasks(pos, halves(spark, sf_dir), "peptide", "tcr", 3, 5, epochs, "ad", 100)


@query(f"{_KSHOT}, " + drawn_sql("more", "SELECT peptide, '' AS pool, 6 - sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS k FROM kshot GROUP BY peptide", ALL, "SELECT peptide, tcr FROM kshot UNION SELECT * FROM pos", ["peptide"], "ud")
    + " SELECT peptide, tcr, label FROM kshot UNION ALL SELECT peptide, tcr, 0 FROM more")
def support_top_up_draws(spark, sf_dir):
    pos = positives(spark, sf_dir)
    return draws.drawn_top_up(kshot_draws(spark, sf_dir), pos, pos, "peptide", "tcr", 6, "ud")


@query(f"WITH RECURSIVE {POS}, " + drawn_sql("d", "SELECT peptide, '' AS pool, CAST(floor(count(DISTINCT tcr) * 1.5) AS BIGINT) AS k FROM pos GROUP BY peptide", "SELECT '' AS pool, p_partkey AS tcr FROM part", "SELECT * FROM pos", ["peptide"], "rd")
    + " SELECT DISTINCT peptide, tcr, 1 AS label FROM pos UNION ALL SELECT peptide, tcr, 0 FROM d")
def negatives_at_ratio(spark, sf_dir):
    pool = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tcr"))
    return draws.drawn_ratio(positives(spark, sf_dir), pool, "peptide", "tcr", 1.5, "rd")


@query(f"WITH RECURSIVE {POS}, " + drawn_sql("d", f"SELECT peptide, '' AS pool, 8 AS k FROM {KEYS}", ALL, "SELECT * FROM pos", ["peptide"], "ld") + """
SELECT peptide, CAST(round AS INT) AS round, tcr, CAST(CASE WHEN draw <= 2 THEN draw ELSE 3 + (draw - 3) % 2 END AS INT) AS place FROM d, (SELECT unnest(range(0, 3)) AS round) WHERE draw <= 2 OR (draw - 3) // 2 = round""")
def support_slices_drawn(spark, sf_dir):
    """Two fixed and two random rows a round."""
    pos = positives(spark, sf_dir)
    return draws.drawn_slices(pos, pos, "peptide", "tcr", 2, 2, 3, "ld")


@query(f"WITH RECURSIVE {POS}, " + drawn_sql("d", f"SELECT peptide, CAST(peptide AS VARCHAR) AS pool, 5 AS k FROM {KEYS}", f"SELECT CAST(k.peptide AS VARCHAR) AS pool, o.tcr FROM {KEYS} k JOIN pos o ON o.tcr % 11 = k.peptide % 11", "SELECT * FROM pos", ["peptide"], "nd") + " SELECT peptide, tcr, CAST(draw AS INT) AS draw FROM d")
def own_pool_draws(spark, sf_dir):
    """Negatives from a pool that each key has of its own."""
    pos = positives(spark, sf_dir)
    keys = pos.select("peptide").distinct()
    own = keys.join(pos.select("tcr", (F.col("tcr") % 11).alias("part")), F.col("peptide") % 11 == F.col("part")).select(F.col("peptide").cast("string").alias("pool"), "tcr")
    wants = keys.select("peptide", F.col("peptide").cast("string").alias("pool"), F.lit(5).alias("__k"))
    return draws.drawn(wants, own, pos, ["peptide"], "tcr", "nd")


def supplier_draws_sql(wants: str, pools: str, keys: list[str], seed: str) -> str:
    """``drawn_sql`` with files and suppliers in the places of keys and items."""
    return drawn_sql("d", wants, pools, "SELECT file AS peptide, cdr3 AS tcr FROM sup WHERE false", ["peptide", *keys], seed)


@query(f"WITH RECURSIVE {SUPPLIERS}, z AS (SELECT file, sum(label) AS p, sum(1 - label) AS q FROM sup GROUP BY file), " + supplier_draws_sql(
    "SELECT file AS peptide, CAST(sample AS INT) AS sample, label, file || ':' || label AS pool, CASE WHEN p = 0 THEN least(q, 1000) WHEN q = 0 THEN p ELSE least(p, q) END AS k FROM z, (SELECT unnest(range(0, 100)) AS sample), (SELECT unnest([0, 1]) AS label)",
    "SELECT file || ':' || label AS pool, cdr3 AS tcr FROM sup", ["sample", "label"], "bd") + " SELECT peptide AS file, sample, tcr AS cdr3, label FROM d")
def balanced_draws(spark, sf_dir):
    return draws.drawn_balanced(suppliers(spark, sf_dir), "file", "label", "cdr3", 100, "bd")


@query(f"WITH RECURSIVE {SUPPLIERS}, c AS (SELECT file, count(*) AS p FROM sup WHERE label = 1 GROUP BY file), fit AS (SELECT file, cdr3 FROM sup SEMI JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) a ON cdr3 = a.s_suppkey WHERE label = 0), " + supplier_draws_sql(
    "SELECT f.file AS peptide, CAST(sample AS INT) AS sample, CAST(f.file AS VARCHAR) AS pool, coalesce(c.p, 10000) AS k FROM (SELECT DISTINCT file FROM fit) f LEFT JOIN c ON c.file = f.file, (SELECT unnest(range(0, 100)) AS sample)",
    "SELECT CAST(file AS VARCHAR) AS pool, cdr3 AS tcr FROM fit", ["sample"], "sd") + " SELECT peptide AS file, sample, tcr AS cdr3, 0 AS label FROM d UNION ALL SELECT file, CAST(sample AS INT), cdr3, 1 FROM sup, (SELECT unnest(range(0, 100)) AS sample) WHERE label = 1")
def shuffling_draws(spark, sf_dir):
    allowed = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("cdr3"))
    return draws.drawn_shuffled(suppliers(spark, sf_dir), allowed, "file", "label", "cdr3", 100, "sd")


_PART_ROWS = "r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_partkey, CAST(p_size % 2 AS INT) AS label FROM part)"


@query(f"WITH RECURSIVE {_PART_ROWS}, z AS (SELECT p_brand, sum(label) AS p, sum(1 - label) AS q FROM r GROUP BY p_brand), " + drawn_sql(
    "d", "SELECT p_brand AS peptide, CAST(sample AS INT) AS sample, label, p_brand || ':' || label AS pool, CASE WHEN p = 0 THEN least(q, 1000) WHEN q = 0 THEN p ELSE least(p, q) END AS k FROM z, (SELECT unnest(range(0, 100)) AS sample), (SELECT unnest([0, 1]) AS label)",
    "SELECT p_brand || ':' || label AS pool, pos AS tcr FROM r", "SELECT p_brand AS peptide, pos AS tcr FROM r WHERE false", ["peptide", "sample", "label"], "id")
    + " SELECT r.p_brand || '.csv' AS original_file, d.sample AS sample_index, r.pos, r.p_partkey, r.label FROM d JOIN r ON r.p_brand = d.peptide AND r.pos = d.tcr")
def apply_drawn_samples(spark, sf_dir):
    """A hundred balanced samples of each file as records of positions, applied to the files' rows."""
    from rankspark.plans.tasks import part_rows

    rows = part_rows(spark, sf_dir).withColumn("label", F.col("label").cast("int"))
    brand = rows.withColumn("brand", tasks.stem("file"))
    drawn = draws.drawn_balanced(brand, "brand", "label", "pos", 100, "id")
    lists = lambda label: F.collect_list(F.when(F.col("label") == label, F.col("pos")))
    records = drawn.groupBy(F.concat("brand", F.lit(".csv")).alias("original_file"), F.col("sample").alias("sample_index")).agg(lists(1).alias("label_1_indices"), lists(0).alias("label_0_indices"))
    return tasks.apply_indices(records, rows, "file", "pos").select("original_file", "sample_index", "pos", "p_partkey", "label")
