"""Registered queries on trained layers and memories, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.operators import adaptation, external, pair_tables, pairs
from rankspark.plans.draws import _KSHOT, kshot_draws
from rankspark.sources import positions
from rankspark.plans.registry import GRID, LABEL, POS, R6, labelled, near, query, table

STEPS, RATE, CLIP = 4, 0.05, 0.4


def _steps_sql() -> str:
    out = ["s AS (SELECT k.peptide, k.label AS y, CASE WHEN k.label = 1 THEN 1.0 ELSE 2.0 END AS c, list_append(CAST(e.embedding AS DOUBLE[]), 1.0) AS x FROM kshot k JOIN embeddings e ON e.vec_id = k.tcr)",
           "st0 AS (SELECT DISTINCT peptide, list_transform(range(0, 65), lambda i: CAST(0 AS DOUBLE)) AS v, list_transform(range(0, 65), lambda i: CAST(0 AS DOUBLE)) AS best, CAST('inf' AS DOUBLE) AS best_loss FROM s)"]
    for k in range(STEPS):
        better = f"a.loss < t.best_loss{' - 0.0001' if k else ''}"
        moved = f"list_transform(range(1, 66), lambda i: t.v[i] - 2 * {RATE} * a.coef * a.g[i])"
        out += [
            f"z{k} AS (SELECT s.*, list_inner_product(s.x, t.v) AS z FROM s JOIN st{k} t ON s.peptide = t.peptide)",
            f"g{k} AS (SELECT peptide, list(g ORDER BY i) AS g, sqrt(2 * sum(g * g)) AS norm FROM (SELECT peptide, i, sum(c * (1 / (1 + exp(-z)) - y) * x[i]) / sum(c) AS g FROM z{k}, unnest(range(1, 66)) AS u(i) GROUP BY peptide, i) GROUP BY peptide)",
            f"a{k} AS (SELECT g.*, least(1.0, {CLIP} / (norm + 1e-6)) AS coef, l.loss FROM g{k} g JOIN (SELECT peptide, sum(c * (greatest(z, 0) - z * y + ln(1 + exp(-abs(z))))) / sum(c) AS loss FROM z{k} GROUP BY peptide) l ON l.peptide = g.peptide)",
            f"st{k + 1} AS (SELECT t.peptide, {moved} AS v, CASE WHEN {better} THEN {'t.v' if k else moved} ELSE t.best END AS best, CASE WHEN {better} THEN a.loss ELSE t.best_loss END AS best_loss FROM st{k} t JOIN a{k} a ON a.peptide = t.peptide)",
        ]
    return ", ".join(out)


def adapted(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tcr"), "embedding")
    drawn = kshot_draws(spark, sf_dir)
    return drawn, vectors, adaptation.adapt(drawn.join(vectors, "tcr"), "peptide", "embedding", "label", 64, RATE, STEPS, clip=CLIP, class_weights=(2.0, 1.0))


@query(f"{_KSHOT}, {_steps_sql()}, {GRID.removeprefix(POS + ", ")}, {LABEL} SELECT l.peptide, l.tcr, {R6.format('1 / (1 + exp(-list_inner_product(list_append(CAST(e.embedding AS DOUBLE[]), 1.0), t.best)))')} AS score FROM labelled l JOIN embeddings e ON e.vec_id = l.tcr JOIN st{STEPS} t ON t.peptide = l.peptide WHERE NOT EXISTS (SELECT 1 FROM kshot s WHERE s.peptide = l.peptide AND s.tcr = l.tcr)")
def last_layer_scores(spark, sf_dir):
    drawn, vectors, best = adapted(spark, sf_dir)
    rest = pairs.without_support(labelled(spark, sf_dir), drawn, "peptide", "tcr").select("peptide", "tcr").join(vectors, "tcr")
    return adaptation.adapted_scores(rest, best, "peptide", "embedding").select("peptide", "tcr", near("score").alias("score"))


@query(f"{_KSHOT}, {_steps_sql()} " + " UNION ALL ".join(f"SELECT peptide, CAST({k} AS INT) AS step, {R6.format('loss')} AS loss FROM a{k}" for k in range(STEPS)))
def last_layer_losses(spark, sf_dir):
    return adaptation.step_losses(adapted(spark, sf_dir)[2], "peptide").withColumn("loss", near("loss"))


@query(f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
k AS (SELECT label, list(x ORDER BY i) AS q FROM (SELECT label, i, avg(v[i]) + 1e-16 AS x FROM e, unnest(range(1, 65)) AS u(i) GROUP BY label, i) GROUP BY label),
m AS (SELECT a.vec_id AS slot, list_transform(b.v, lambda x: x + 1e-16) AS address, list_append(a.v, a.vec_id * 0.125) AS layer FROM e a JOIN e b ON b.vec_id = a.vec_id + 16 WHERE a.vec_id < 16),
c AS (SELECT k.label, m.slot, list_inner_product(k.q, m.address) / sqrt(list_inner_product(k.q, k.q)) / sqrt(list_inner_product(m.address, m.address)) AS c FROM k, m),
r AS (SELECT label, slot, exp(c) / sum(exp(c)) OVER (PARTITION BY label) AS r FROM c)
SELECT e.vec_id, e.label, {R6.format('sum(r.r / (1 + exp(-list_inner_product(list_append(e.v, 1.0), m.layer))))')} AS score FROM e JOIN r ON r.label = e.label JOIN m ON m.slot = r.slot GROUP BY e.vec_id, e.label""")
def memory_read_scores(spark, sf_dir):
    """Keys are labels with their mean vector; sixteen vectors are the layers of the slots, sixteen others their addresses."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    means = e.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    keys = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("mean"))
    layer = F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(F.col("vec_id") * 0.125))
    slots = e.where("vec_id < 16").select("vec_id", layer.alias("layer")).join(e.where("vec_id >= 16 AND vec_id < 32").select((F.col("vec_id") - 16).alias("vec_id"), F.col("embedding").alias("address")), "vec_id")
    out = adaptation.memory_scores(keys, e, adaptation.memory(slots, "vec_id", "address", "layer"), "label", "mean", "embedding")
    return out.select("vec_id", "label", near("score").alias("score"))


@external.scorer("price_per_unit")
def _price_per_unit():
    def score(rows):
        quantity = rows["l_quantity"].to_numpy()
        if (quantity == 13).any():
            raise ValueError("no price for 13")
        return rows["l_extendedprice"].to_numpy() / quantity

    return score


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity = 13 THEN 0.0 ELSE {R6.format('l_extendedprice / l_quantity')} END AS score, CASE WHEN l_quantity = 13 THEN 'ValueError: no price for 13' END AS error FROM lineitem")
def external_batch_scores(spark, sf_dir):
    """A foreign model that fails on some rows, in batches of 1000."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").cast("double").alias("l_extendedprice"))
    out = external.score_external(line, "price_per_unit", ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", near("score").alias("score"), "error")


@query("""WITH a AS (SELECT row_number() OVER () - 1 AS pos, c_custkey, c_acctbal FROM customer), b AS (SELECT row_number() OVER () - 1 AS pos, p_partkey FROM part)
SELECT a.pos, c_custkey, c_acctbal, p_partkey FROM a JOIN b ON a.pos = b.pos""")
def zip_by_position(spark, sf_dir):
    """Rows of two files side by side, by their places in the files."""
    a = positions.with_positions(spark, f"{sf_dir}/customer.parquet", "parquet").select("file_name", "pos", "c_custkey", "c_acctbal")
    b = positions.with_positions(spark, f"{sf_dir}/part.parquet", "parquet").select("file_name", "pos", "p_partkey")
    return positions.zipped_by_position(a, b).drop("file_name")


@query(f"""SELECT peptide, tcr, {R6.format('score')} AS score, place FROM (SELECT label AS peptide, vec_id AS tcr, CAST(embedding[1] AS DOUBLE) AS score, row_number() OVER (PARTITION BY label ORDER BY CAST(embedding[1] AS DOUBLE) DESC, vec_id) AS place FROM embeddings) WHERE place <= 10""")
def pair_table_first_ten(spark, sf_dir):
    """A builder of pair tables by name, run through SQL as a table function."""
    pair_tables.register(spark)
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("peptide"), F.col("vec_id").alias("tcr"), F.col("embedding")[0].cast("double").alias("score"))
    out = spark.sql("SELECT * FROM build_pairs(TABLE({rows}) PARTITION BY peptide ORDER BY (score DESC, tcr), 'first_ten')", rows=rows)
    return out.withColumn("score", near("score"))
