"""Registered queries on task data, features, sources' layouts and summaries, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions.encode import FACTORS, encoded, position_code
from rankspark.operators import features, metrics, pairs, scoring, tasks
from rankspark.operators.spread import spread
from rankspark.plans.registry import AUCS, BEDROC, GROUP, NEG, ORACLES, R6, SUPPORT, aucs, kshot_support, near, positives, query, ranks, table
from rankspark.sources import tables

_FACTOR_ROWS = ", ".join(f"('{a}', {j}, CAST({v} AS DOUBLE))" for a, row in FACTORS.items() for j, v in enumerate(row))
_CODE_ROWS = ", ".join(f"({p}, {j}, CAST({v!r} AS DOUBLE))" for p, row in enumerate(position_code(25)) for j, v in enumerate(row))
TABLES = f"f(a, j, v) AS (VALUES {_FACTOR_ROWS}), c(p, j, v) AS (VALUES {_CODE_ROWS})"
LETTERS = "".join(sorted(FACTORS))
#: Residues of an encoded item.
LENGTH = 25


def encoding_sql(source: str, column: str, length: int) -> str:
    """(column, pos, value) of the encoding of a column's distinct values."""
    return f"""SELECT r.s AS {column}, CAST((r.i - 1) * 5 + j.j AS INT) AS pos, coalesce(f.v + c.v, 0.0) AS value
    FROM (SELECT s, i, substr(s, CAST(i AS INT), 1) AS a, length(regexp_replace(substr(s, 1, CAST(i AS INT) - 1), '[^{LETTERS}]', '', 'g')) AS before FROM (SELECT DISTINCT {column} AS s FROM {source}), (SELECT unnest(range(1, {length + 1})) AS i)) r
    CROSS JOIN (SELECT unnest(range(0, 5)) AS j) j LEFT JOIN f ON f.a = r.a AND f.j = j.j LEFT JOIN c ON c.p = r.before AND c.j = j.j"""


def part_rows(spark, sf_dir):
    """Parts as rows of files: the file is the brand, the position the place by key."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(".parquet")).alias("file"), place.cast("long").alias("pos"), "p_partkey", (F.col("p_size") % 2).alias("label"))


@query("""WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_partkey, p_size % 2 AS label FROM part), n AS (SELECT unnest(range(0, 3)) AS sample_index),
d AS (SELECT p_brand, sample_index, p_partkey, label, row_number() OVER (PARTITION BY p_brand, sample_index ORDER BY label DESC, md5('i' || sample_index || ':' || pos), pos) - 1 AS place FROM r, n WHERE pos % 3 = sample_index)
SELECT p_brand || '.csv' AS original_file, CAST(sample_index AS INT) AS sample_index, CAST(place AS INT) AS place, p_partkey, CAST(label AS INT) AS label FROM d""")
def apply_sample_indices(spark, sf_dir):
    rows = part_rows(spark, sf_dir)
    many = rows.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(F.col("pos") % 3 == F.col("sample_index"))
    drawn = F.struct(F.md5(F.concat(F.lit("i"), F.col("sample_index").cast("string"), F.lit(":"), F.col("pos").cast("string"))).alias("h"), "pos")
    lists = lambda label: F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == label, drawn))), lambda x: x["pos"])
    records = many.groupBy(F.regexp_replace("file", "parquet$", "csv").alias("original_file"), "sample_index").agg(lists(1).alias("label_1_indices"), lists(0).alias("label_0_indices"))
    return tasks.apply_indices(records, rows, "file", "pos").select("original_file", "sample_index", "place", "p_partkey", F.col("label").cast("int").alias("label"))


def lookups(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("seq"))
    dictionary = spread(part.where("p_partkey % 2 = 0").select("seq").distinct(), "seq").select("seq", encoded("seq", LENGTH).alias("encoding"))
    return part, dictionary, features.with_encoding(spread(part, "p_partkey"), dictionary, "seq", LENGTH)


@query(f"""WITH {TABLES}, p AS (SELECT p_partkey, upper(p_name) AS seq FROM part), e AS ({encoding_sql('p', 'seq', LENGTH)}), k AS (SELECT DISTINCT seq FROM p WHERE p_partkey % 2 = 0)
SELECT p.p_partkey, e.pos, {R6.format('e.value')} AS value, p.seq IN (SELECT seq FROM k) AS hit FROM p JOIN e ON p.seq = e.seq""")
def encoding_lookup_fallback(spark, sf_dir):
    # No encoding is empty; outer, so that no filter on its size makes it twice.
    return lookups(spark, sf_dir)[2].select("p_partkey", "hit", F.posexplode_outer("encoding").alias("pos", "value")).withColumn("value", near("value"))


@query(f"""WITH p AS (SELECT p_partkey, upper(p_name) AS seq FROM part), k AS (SELECT DISTINCT seq FROM p WHERE p_partkey % 2 = 0)
SELECT count(*) AS n, CAST(sum(CASE WHEN seq IN (SELECT seq FROM k) THEN 1 ELSE 0 END) AS BIGINT) AS hits, {R6.format('avg(CASE WHEN seq IN (SELECT seq FROM k) THEN 1.0 ELSE 0.0 END)')} AS hit_ratio FROM p""")
def encoding_hit_ratio(spark, sf_dir):
    return features.hit_ratio(lookups(spark, sf_dir)[2]).withColumn("hit_ratio", near("hit_ratio"))


@query("SELECT seq FROM (SELECT DISTINCT upper(p_name) AS seq FROM part) WHERE seq NOT IN (SELECT upper(p_name) FROM part WHERE p_partkey % 50 = 0) ORDER BY seq LIMIT 10")
def missing_key_report(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("seq"))
    dictionary = part.where("p_partkey % 50 = 0").select("seq", encoded("seq", LENGTH).alias("encoding"))
    return features.missing_keys(part, dictionary, "seq")


TYPES = f"t AS (SELECT DISTINCT p_type AS raw, regexp_replace(upper(p_type), '[^{LETTERS}]', '', 'g') AS tcr, regexp_replace(upper(split_part(p_type, ' ', 1)), '[^{LETTERS}]', '', 'g') AS peptide FROM part)"


def types(spark, sf_dir):
    only = lambda c: F.regexp_replace(F.upper(c), f"[^{LETTERS}]", "")
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("raw"), only(F.col("p_type")).alias("tcr"), only(F.split("p_type", " ")[0]).alias("peptide")).distinct()


_PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]
_CHEMISTRY = "chem AS (SELECT a, j, v FROM f UNION ALL " + " UNION ALL ".join(f"SELECT x.a, {5 + k}, x.v * y.v FROM f x JOIN f y ON x.a = y.a WHERE x.j = {i} AND y.j = {j}" for k, (i, j) in enumerate(_PAIRS)) + ")"


@query(f"""WITH f(a, j, v) AS (VALUES {_FACTOR_ROWS}), {_CHEMISTRY}, {TYPES}, s AS (SELECT raw, lpad(tcr || peptide, 29, 'X') AS s FROM t), r AS (SELECT raw, i, substr(s, CAST(i AS INT), 1) AS a FROM s, (SELECT unnest(range(1, 30)) AS i))
SELECT raw, CAST((i - 1) * 20 + j AS INT) AS pos, CASE WHEN instr('{LETTERS}', a) = j + 1 THEN 1.0 ELSE 0.0 END AS value FROM r, (SELECT unnest(range(0, 20)) AS j)
UNION ALL SELECT r.raw, CAST(580 + (i - 1) * 20 + j.j AS INT), {R6.format('coalesce(c.v, 0.0)')} FROM r CROSS JOIN (SELECT unnest(range(0, 20)) AS j) j LEFT JOIN chem c ON c.a = r.a AND c.j = j.j""")
def onehot_chem_encode(spark, sf_dir):
    """58 x 20 numbers a pair; the chemistry is the five factors and their products, in place of a user's own table."""
    chemistry = features.with_products(FACTORS)
    return types(spark, sf_dir).select("raw", F.posexplode(features.onehot_chemical("tcr", "peptide", chemistry)).alias("pos", "value")).withColumn("value", near("value"))


@query(f"""WITH f(a, j, v) AS (VALUES {_FACTOR_ROWS}), {TYPES}, r AS (SELECT raw, i, substr(tcr, CAST(i AS INT), 1) AS a, length(tcr) AS n FROM t, (SELECT unnest(range(1, 21)) AS i))
SELECT r.raw, CAST((i - 1) * 6 + j.j AS INT) AS pos, CASE WHEN j.j = 5 THEN CASE WHEN i > n THEN 1.0 ELSE 0.0 END ELSE {R6.format('coalesce(f.v, 0.0)')} END AS value FROM r CROSS JOIN (SELECT unnest(range(0, 6)) AS j) j LEFT JOIN f ON f.a = r.a AND f.j = j.j""")
def pca_encode(spark, sf_dir):
    return types(spark, sf_dir).select("raw", F.posexplode(features.padded_rows("tcr", FACTORS)).alias("pos", "value")).withColumn("value", near("value"))


@query(f"""WITH {TYPES} SELECT raw, CASE WHEN length(raw) % 3 = 0 OR length(raw) % 5 = 0 THEN 3 ELSE 0 END AS error, CASE WHEN length(raw) % 3 = 0 OR length(raw) % 5 = 0 THEN -1 ELSE 240 END AS width FROM t""")
def chain_feature_dispatch(spark, sf_dir):
    n = F.length("raw")
    df = types(spark, sf_dir).select("raw", F.when(n % 3 != 0, F.col("tcr")).alias("alpha"), F.when(n % 5 != 0, F.col("tcr")).alias("beta"), "peptide")
    out = features.chain_features(df, "AB", "alpha", "beta", "peptide", FACTORS)
    return out.select("raw", "error", F.coalesce(F.size("alpha_features"), F.lit(-1)).alias("width"))


def _padded_sql(column: str, shift: int) -> str:
    return f"""SELECT r.raw, CAST({shift} + (i - 1) * 6 + j.j AS INT) AS pos, CASE WHEN j.j = 5 THEN CASE WHEN i > length({column}) THEN 1.0 ELSE 0.0 END ELSE {R6.format('coalesce(f.v, 0.0)')} END AS value
    FROM (SELECT raw, {column}, i, substr({column}, CAST(i AS INT), 1) AS a FROM t, (SELECT unnest(range(1, 21)) AS i)) r CROSS JOIN (SELECT unnest(range(0, 6)) AS j) j LEFT JOIN f ON f.a = r.a AND f.j = j.j"""


@query(f"""WITH f(a, j, v) AS (VALUES {_FACTOR_ROWS}), {TYPES}, x AS ({_padded_sql('tcr', 0)} UNION ALL {_padded_sql('peptide', 120)})
SELECT t.raw, CASE WHEN length(t.raw) % 3 = 0 OR length(t.raw) % 5 = 0 THEN 3 ELSE 0 END AS error, x.pos, x.value FROM t LEFT JOIN x ON x.raw = t.raw AND length(t.raw) % 3 <> 0 AND length(t.raw) % 5 <> 0""")
def chain_feature_values(spark, sf_dir):
    """The numbers of the dispatched features themselves, and the error code of the rows that have none."""
    n = F.length("raw")
    df = types(spark, sf_dir).select("raw", F.when(n % 3 != 0, F.col("tcr")).alias("alpha"), F.when(n % 5 != 0, F.col("tcr")).alias("beta"), "peptide")
    out = features.chain_features(df, "AB", "alpha", "beta", "peptide", FACTORS)
    return out.select("raw", "error", F.posexplode_outer("alpha_features").alias("pos", "value")).withColumn("value", near("value"))


@query(f"""WITH {TABLES}, {TYPES}, k AS ({encoding_sql('t', 'peptide', 15)}), i AS ({encoding_sql('t', 'tcr', 25)})
SELECT t.raw, CASE WHEN length(raw) % 2 = 0 THEN 'support' ELSE 'query' END AS role, k.pos, {R6.format('k.value')} AS value FROM t JOIN k ON t.peptide = k.peptide
UNION ALL SELECT t.raw, CASE WHEN length(raw) % 2 = 0 THEN 'support' ELSE 'query' END, i.pos + 75, {R6.format('i.value')} FROM t JOIN i ON t.tcr = i.tcr""")
def task_pair_features(spark, sf_dir):
    t = types(spark, sf_dir)
    out = features.task_embedding(t.where(F.length("raw") % 2 == 0), t.where(F.length("raw") % 2 == 1), "peptide", "tcr")
    named = out.join(t, ["peptide", "tcr"]).select("raw", "role", F.posexplode("feature").alias("pos", "value"))
    return named.withColumn("value", near("value"))


@query("SELECT p_partkey, p_brand AS top FROM part WHERE p_size % 4 <> 0")
def merge_first_level_dir(spark, sf_dir):
    inner = F.concat_ws("/", "p_brand", F.regexp_replace("p_type", " ", "/"))
    files = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, "").otherwise(inner).alias("directory"))
    return tables.first_level(files).select("p_partkey", "top")


@query("SELECT p_brand AS directory FROM part GROUP BY p_brand ORDER BY p_brand")
def data_directories(spark, sf_dir):
    return tables.data_directories(table(spark, sf_dir, "part").select(F.col("p_brand").alias("directory")))


@query("SELECT DISTINCT '''' || p_brand || '.csv''' AS value FROM part")
def file_name_list(spark, sf_dir):
    return tables.file_names(table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(".csv")).alias("file_name")))


@query("SELECT k.label AS peptide, i.vec_id AS tcr, 0 AS label FROM (SELECT DISTINCT label FROM embeddings) k CROSS JOIN (SELECT DISTINCT vec_id FROM embeddings) i")
def pair_generation_classic(spark, sf_dir):
    pos = positives(spark, sf_dir)
    return pos.select("peptide").distinct().crossJoin(pos.select("tcr").distinct()).withColumn("label", F.lit(0))


def task_sql(seed: str, pool: str = "TRUE") -> str:
    place = f"row_number() OVER (PARTITION BY peptide ORDER BY md5('{seed}:' || peptide || ':' || tcr), tcr)"
    return f"""SELECT peptide, CASE WHEN place <= 3 THEN 'support' ELSE 'query' END AS role, tcr, label FROM (
    SELECT peptide, tcr, 1 AS label, {place} AS place FROM (SELECT DISTINCT peptide, tcr FROM fit) UNION ALL SELECT peptide, tcr, 0, {place} FROM neg WHERE peptide IN (SELECT peptide FROM fit) AND {pool}) WHERE place <= 8"""


FIT = NEG + ", fit AS (SELECT * FROM pos WHERE peptide IN (SELECT peptide FROM pos GROUP BY peptide HAVING count(*) >= 8))"


@query(f"WITH {FIT} {task_sql('t')}")
def task_sampler_mode2(spark, sf_dir):
    pos = positives(spark, sf_dir)
    return tasks.task_sample(pos, pos, "peptide", "tcr", 3, 5, "t")


@query(f"WITH {FIT} " + " UNION ALL ".join(f"SELECT *, {e} AS epoch FROM ({task_sql(f'a{e}', f'tcr % 2 = {1 - e % 2}')})" for e in range(4)))
def task_sampler_alternating(spark, sf_dir):
    pos = positives(spark, sf_dir)
    return tasks.alternating_tasks(pos, pos.where("tcr % 2 = 0"), pos.where("tcr % 2 = 1"), "peptide", "tcr", 3, 5, 4, "a")


@query(f"WITH {NEG} SELECT peptide, tcr, row_number() OVER (PARTITION BY peptide ORDER BY md5('k:' || peptide || ':' || tcr), tcr) AS place FROM neg")
def task_sampler_ranking(spark, sf_dir):
    pos = positives(spark, sf_dir)
    return tasks.shuffled_negatives(pos, pos, "peptide", "tcr", "k")


@query("""WITH p AS (SELECT vec_id AS tcr, row_number() OVER (ORDER BY md5('o:' || vec_id), vec_id) AS place, count(*) OVER () AS n FROM embeddings),
d AS (SELECT label AS peptide, draw FROM (SELECT DISTINCT label FROM embeddings), (SELECT unnest(range(1, 9)) AS draw))
SELECT d.peptide, CAST(d.draw AS INT) AS draw, p.tcr FROM d JOIN p ON p.place = CAST('0x' || substr(md5('o:' || d.peptide || ':' || d.draw), 1, 8) AS BIGINT) % p.n + 1""")
def task_sampler_old(spark, sf_dir):
    pos = positives(spark, sf_dir)
    return tasks.drawn_with_replacement(pos, pos, "peptide", "tcr", 8, "o")


@query("""WITH w AS (SELECT p_partkey AS pos, p_name, p_type, p_brand FROM part), l AS (SELECT pos, 'p_name' AS key, p_name AS item FROM w UNION ALL SELECT pos, 'p_type', p_type FROM w UNION ALL SELECT pos, 'p_brand', p_brand FROM w),
z AS (SELECT *, pos // 10 AS epoch, pos % 10 AS at_, pos % 5 AS inner_ FROM l)
SELECT key, epoch, CASE WHEN inner_ < 2 THEN 'support' ELSE 'query' END AS role, CASE WHEN at_ < 5 THEN 1 ELSE 0 END AS label,
CASE WHEN inner_ < 2 THEN CASE WHEN at_ < 5 THEN 0 ELSE 2 END + inner_ ELSE 4 + CASE WHEN at_ < 5 THEN 0 ELSE 3 END + inner_ - 2 END AS place, item FROM z WHERE epoch < (SELECT (max(pos) + 1) // 10 FROM w)""")
def replay_epoch_blocks(spark, sf_dir):
    wide = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), "p_name", "p_type", "p_brand")
    return tasks.replayed(wide, "pos", ["p_name", "p_type", "p_brand"], 2, 3)


@query(f"""WITH {SUPPORT}, have AS (SELECT peptide, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS h FROM support GROUP BY peptide),
more AS (SELECT n.peptide, n.tcr, row_number() OVER (PARTITION BY n.peptide ORDER BY md5('u:' || n.peptide || ':' || n.tcr), n.tcr) AS rn, 6 - h AS k FROM neg n ANTI JOIN support s ON n.peptide = s.peptide AND n.tcr = s.tcr JOIN have ON n.peptide = have.peptide)
SELECT peptide, tcr, label FROM support UNION ALL SELECT peptide, tcr, 0 FROM more WHERE rn <= k""")
def support_top_up(spark, sf_dir):
    pos = positives(spark, sf_dir)
    return tasks.topped_up(kshot_support(spark, sf_dir), pairs.negatives(pos, pos, "peptide", "tcr"), "peptide", "tcr", 6, "u")


@query(f"""WITH {NEG}, e AS (SELECT peptide, tcr, row_number() OVER (PARTITION BY peptide ORDER BY md5('e:' || peptide || ':' || tcr), tcr) - 1 AS pos FROM neg), n AS (SELECT unnest(range(0, 3)) AS round)
SELECT peptide, CAST(round AS INT) AS round, pos, tcr FROM e, n WHERE pos < 2 OR (pos >= 2 + round * 2 AND pos < 4 + round * 2)""")
def support_slices(spark, sf_dir):
    pos = positives(spark, sf_dir)
    expanded = tasks.shuffled_negatives(pos, pos, "peptide", "tcr", "e").withColumn("pos", F.col("place") - 1)
    return tasks.support_slices(expanded, "peptide", "pos", 2, 3).select("peptide", "round", "pos", "tcr")


def finetune(spark, sf_dir):
    from rankspark.plans.registry import majority_finetune

    return majority_finetune(spark, sf_dir)


@query(f"SELECT *, CASE WHEN known_label = 'Unknown' THEN 'query' ELSE 'support' END AS role FROM ({ORACLES['majority_finetune']})")
def query_support_routing(spark, sf_dir):
    return tasks.routed(finetune(spark, sf_dir), "known_label")


@query(f"""WITH a AS ({ORACLES['majority_finetune']}) SELECT peptide, CAST(count(*) AS INT) AS n, coalesce(string_agg(CASE WHEN set = 'train' THEN tcr || ':' || label END, ' ' ORDER BY tcr, label), '') AS train,
coalesce(string_agg(CASE WHEN set = 'val' THEN tcr || ':' || label END, ' ' ORDER BY tcr, label), '') AS val, coalesce(string_agg(CASE WHEN set = 'test' THEN tcr || ':' || label END, ' ' ORDER BY tcr, label), '') AS test FROM a GROUP BY peptide""")
def finetune_set_lists(spark, sf_dir):
    lists = tasks.set_lists(finetune(spark, sf_dir), "peptide", "tcr", "label")
    text = lambda s: F.array_join(F.zip_with(f"{s}_items", f"{s}_labels", lambda i, n: F.concat(i.cast("string"), F.lit(":"), n.cast("string"))), " ").alias(s)
    return lists.select("peptide", "n", text("train"), text("val"), text("test"))


@query(f"""WITH a AS ({ORACLES['majority_finetune']}), p AS (SELECT peptide, set, (row_number() OVER (PARTITION BY peptide, set ORDER BY tcr, label) - 1) // 64 AS block, tcr, label FROM a)
SELECT peptide, set, block, string_agg(tcr, ' ' ORDER BY tcr, label) AS items, string_agg(label, ' ' ORDER BY tcr, label) AS labels FROM p GROUP BY peptide, set, block""")
def finetune_set_blocks(spark, sf_dir):
    blocks = tasks.set_blocks(finetune(spark, sf_dir), "peptide", "tcr", "label", 64)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return blocks.select("peptide", "set", "block", text("items"), text("labels"))


@query(f"WITH {SUPPORT} SELECT p.peptide, p.tcr, EXISTS (SELECT 1 FROM support s WHERE s.peptide = p.peptide AND s.tcr = p.tcr) AS selected FROM pos p")
def selected_flags(spark, sf_dir):
    return tasks.flagged(positives(spark, sf_dir), kshot_support(spark, sf_dir), ["peptide", "tcr"])


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_discount * 8 + (1 - l_tax * 9) + (1 - l_quantity / 60)) / 3 AS a, (l_discount * 8 + l_tax * 9 + l_quantity / 60) / 3 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN {R6.format('a')} > 0.5 THEN 'negative' ELSE 'positive' END AS alpha, CASE WHEN {R6.format('b')} > 0.5 THEN 'negative' ELSE 'positive' END AS beta, CASE WHEN {R6.format('a')} <= 0.5 AND {R6.format('b')} <= 0.5 THEN 'positive' ELSE 'negative' END AS verdict FROM p""")
def paired_chain_verdict(spark, sf_dir):
    models = F.col("l_discount") * 8, F.col("l_tax") * 9, F.col("l_quantity") / 60
    sides = {}
    for name, swapped in (("alpha", (1, 2)), ("beta", ())):  # the mean is rounded, so that both engines cut alike
        sides[name] = scoring.mean_verdict(near(1 - scoring.mean_verdict(*models, swapped=swapped)[0]))[1]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in sides.items()], scoring.both_chains(*sides.values()).alias("verdict"))


@query(f"SELECT vec_id, {R6.format('CAST(embedding[1] AS DOUBLE) * 0.59 + CAST(embedding[2] AS DOUBLE) * 0.41')} AS score FROM embeddings")
def chain_scores_zip(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    part = lambda k, name: e.select("vec_id", F.col("embedding")[k].cast("double").alias(name))
    both = scoring.zipped(part(0, "alpha"), part(1, "beta"), "vec_id")
    return scoring.weighted_chains(both, "majority", "alpha", "beta").select("vec_id", near("score").alias("score"))


@query(f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id, {R6.format('list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v))')} AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def neighbour_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    both = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return both.select("vec_id", near(scoring.cosine("a", "b")).alias("cosine"))


@query(ORACLES["auc_folder_summary"])
def auc_summary_sorted(spark, sf_dir):
    """Byte order: the summary row comes after digits and capitals, before small letters."""
    return metrics.with_summary(aucs(spark, sf_dir), "directory", "file").withColumns({c: near(c) for c in ("roc_auc", "pr_auc")}).orderBy("directory", "file")


@query(f"""WITH {BEDROC}, m AS (SELECT directory, avg(bedroc) AS x, stddev_samp(bedroc) AS s, count(*) AS n FROM bed GROUP BY directory)
SELECT directory, {R6.format('x')} AS bedroc_mean, {R6.format('s')} AS bedroc_std, n AS file_count, {R6.format('(SELECT avg(x) FROM m)')} AS overall FROM m ORDER BY {R6.format('x')} DESC, directory LIMIT 10""")
def bedroc_top10(spark, sf_dir):
    each = metrics.bedroc(ranks(spark, sf_dir), GROUP, "label").groupBy("directory").agg(F.avg("bedroc").alias("x"), F.stddev_samp("bedroc").alias("s"), F.count("*").alias("file_count"))
    top = each.select("directory", near("x").alias("bedroc_mean"), near("s").alias("bedroc_std"), "file_count").orderBy(F.desc("bedroc_mean"), "directory").limit(10)
    return top.join(F.broadcast(each.agg(near(F.avg("x")).alias("overall"))), F.lit(True))  # one row


EVENTS = "e AS (SELECT event_id % 5 AS epoch, user_id % 4 AS step, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS ok FROM events), a AS (SELECT epoch, step, avg(ok) AS accuracy FROM e GROUP BY epoch, step)"


def step_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("epoch"), (F.col("user_id") % 4).alias("step"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("ok"))
    return metrics.step_accuracy(e, "epoch", "step", F.col("ok"))


@query(f"WITH {EVENTS} SELECT epoch, step, {R6.format('accuracy')} AS accuracy FROM a")
def step_accuracy(spark, sf_dir):
    return step_rows(spark, sf_dir).withColumn("accuracy", near("accuracy"))


@query(f"WITH {EVENTS} SELECT epoch, {R6.format('arg_max(accuracy, step)')} AS last_accuracy, {R6.format('avg(accuracy)')} AS mean_accuracy FROM a GROUP BY epoch")
def epoch_accuracy(spark, sf_dir):
    return metrics.epoch_accuracy(step_rows(spark, sf_dir), "epoch", "step").withColumns({c: near(c) for c in ("last_accuracy", "mean_accuracy")})


@query("SELECT user_id, string_agg(event_type, ' ' ORDER BY first, event_type) AS items FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def merged_key_lists(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return tasks.merged_lists([e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")], "user_id", "event_type", "event_id").select("user_id", F.array_join("items", " ").alias("items"))
