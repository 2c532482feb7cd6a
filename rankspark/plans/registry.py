"""Registered queries over the driver's tables, each with its DuckDB text.

directory is a part brand, file a part key modulo five, score a price or a quantity (with ties) and label a returned
line; keys and items of pairs are the labels and ids of embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions.encode import FACTORS, encoded, position_code
from rankspark.operators import features, metrics, pairs, ranking, sampling, scoring
from rankspark.operators.spread import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Shares of the curve at which partial areas are taken.
CUTOFFS = [0.0001, 0.001, 0.01, 0.05, 0.1, 0.2, 1.0]
TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_linestatus"]
GROUP = ["directory", "file"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near(c: str | Column) -> Column:
    """Six decimals, with a nudge that keeps exact halves on one side in both engines."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6) + F.lit(0.0)  # no negative zero


def scored(spark: SparkSession, sf_dir: str, score: str = "l_extendedprice") -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("directory"))
    line = table(spark, sf_dir, "lineitem").select(*TIES, F.col(score).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return line.join(part, line.l_partkey == part.p_partkey).withColumn("file", (F.col("p_partkey") % 5).cast("long"))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(scored(spark, sf_dir).select(*GROUP, "score", "label", *TIES), GROUP, "score", TIES, ["label"])


def positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("peptide"), F.col("vec_id").alias("tcr"))


SCORED = """scored AS (
  SELECT p_brand AS directory, CAST(p_partkey % 5 AS BIGINT) AS file, l_extendedprice AS score, l_quantity AS tied, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate, l_linestatus
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
RANKS = SCORED + """, ranks AS (
  SELECT *, row_number() OVER (PARTITION BY directory, file ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate, l_linestatus) AS rank,
    count(*) OVER (PARTITION BY directory, file) AS n FROM scored)"""
CURVE = RANKS + """, hits AS (
  SELECT *, sum(label) OVER (PARTITION BY directory, file ORDER BY rank) AS hits, sum(label) OVER (PARTITION BY directory, file) AS total FROM ranks
), curve AS (
  SELECT directory, rank AS top_k, avg(CAST(hits AS DOUBLE) / total) AS success_rate, avg(CAST(hits AS DOUBLE) / rank) AS hit_rate
  FROM hits WHERE total > 0 AND rank <= greatest(1, CAST(floor(n * 0.5) AS BIGINT)) GROUP BY directory, rank)"""
R6 = "(round({} + 1e-9, 6) + 0.0)"


@query(f"WITH {RANKS} SELECT directory, file, rank, n, score, label FROM ranks")
def rank_sorted(spark, sf_dir):
    return ranks(spark, sf_dir).select("directory", "file", "rank", "n", "score", "label")


@query(f"""WITH {RANKS}, p AS (SELECT directory, file, CAST(rank - 1 AS DOUBLE) / n AS position, row_number() OVER (PARTITION BY directory, file ORDER BY rank) AS ordinal FROM ranks WHERE label = 1)
SELECT g.directory, g.file, {R6.format('coalesce(position, -1.0)')} AS position, coalesce(ordinal, 0) AS ordinal FROM (SELECT DISTINCT directory, file FROM ranks) g LEFT JOIN p ON g.directory = p.directory AND g.file = p.file""")
def positive_positions(spark, sf_dir):
    return ranking.positive_positions(ranks(spark, sf_dir), GROUP, "label").withColumn("position", near("position"))


def curve(spark, sf_dir):
    return ranking.rate_curve(ranks(spark, sf_dir), GROUP, "directory", "label", 0.5)


@query(f"WITH {CURVE} SELECT directory, top_k, {R6.format('success_rate')} AS success_rate, {R6.format('hit_rate')} AS hit_rate FROM curve")
def success_hit_curve(spark, sf_dir):
    return curve(spark, sf_dir).select("directory", "top_k", near("success_rate").alias("success_rate"), near("hit_rate").alias("hit_rate"))


def area_sql(y: str, fill: bool) -> str:
    value = f"CASE WHEN {y} = 0 THEN coalesce(min(CASE WHEN {y} > 0 THEN {y} END) OVER (PARTITION BY directory) / 10, 1e-10) ELSE {y} END" if fill else y
    columns = ", ".join(f"{R6.format(f'max(CASE WHEN cutoff = {c} THEN area END)')} AS \"{metrics.cutoff_label(c)}\"" for c in CUTOFFS)
    return f"""WITH {CURVE}, filled AS (SELECT directory, CAST(top_k AS DOUBLE) AS x, {value} AS y FROM curve),
    t AS (SELECT directory, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, min(x) OVER (PARTITION BY directory) AS mn, max(x) OVER (PARTITION BY directory) AS mx, count(*) OVER (PARTITION BY directory) AS n FROM filled WINDOW w AS (PARTITION BY directory ORDER BY x)),
    s AS (SELECT *, mn + cutoff * (mx - mn) AS xc FROM t, (SELECT unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in CUTOFFS)}]) AS cutoff)),
    a AS (SELECT directory, cutoff, max(n) AS n_rows, CASE WHEN sum(CASE WHEN x <= xc THEN 1 ELSE 0 END) < 2 THEN NULL ELSE sum(CASE WHEN x1 IS NULL OR x >= xc THEN 0 WHEN x1 <= xc THEN (x1 - x) * (y + y1) / 2
      ELSE (xc - x) * (y + (y + (xc - x) / (x1 - x) * (y1 - y))) / 2 END) / max(mx - mn) END AS area FROM s GROUP BY directory, cutoff)
    SELECT directory, max(n_rows) AS n_rows, {columns} FROM a GROUP BY directory"""


def areas(spark, sf_dir, y: str, fill: bool):
    points = curve(spark, sf_dir)
    points = metrics.zero_filled(points, "directory", y) if fill else points
    out = metrics.pivoted(metrics.partial_areas(points, "directory", "top_k", y, CUTOFFS), "directory", CUTOFFS)
    return out.select("directory", "n_rows", *[near(metrics.cutoff_label(c)).alias(metrics.cutoff_label(c)) for c in CUTOFFS])


@query(area_sql("success_rate", False))
def partial_auc(spark, sf_dir):
    return areas(spark, sf_dir, "success_rate", False)


@query(area_sql("hit_rate", True))
def partial_auc_hit_zero_fill(spark, sf_dir):
    return areas(spark, sf_dir, "hit_rate", True)


AUCS = SCORED + """, steps AS (SELECT directory, file, tied AS s, CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS c FROM scored GROUP BY directory, file, tied
), runs AS (SELECT *, sum(p) OVER w AS tp, sum(c) OVER w AS k, sum(p) OVER (PARTITION BY directory, file) AS m, sum(c) OVER (PARTITION BY directory, file) AS n FROM steps WINDOW w AS (PARTITION BY directory, file ORDER BY s DESC)
), points AS (SELECT *, tp / nullif(m, 0) AS rec, tp / k AS prec, lag(tp / nullif(m, 0), 1, 0.0) OVER w AS rec0, lag(tp / k, 1, 1.0) OVER w AS prec0 FROM runs WINDOW w AS (PARTITION BY directory, file ORDER BY s DESC)
), sums AS (SELECT directory, file, max(m) AS m, max(n) AS n, sum(p * ((n - m) - (k - tp) + (c - p) / 2)) AS won, sum((rec - rec0) * (prec + prec0) / 2) AS area FROM points GROUP BY directory, file
), aucs AS (SELECT directory, file, CASE WHEN m > 0 AND m < n THEN won / (m * (n - m)) END AS roc_auc, CASE WHEN m > 0 AND m < n THEN area END AS pr_auc, CASE WHEN m > 0 AND m < n THEN 'success' ELSE 'insufficient samples' END AS status FROM sums)"""


def aucs(spark, sf_dir):
    return metrics.auc_by_group(scored(spark, sf_dir, "l_quantity"), GROUP, "score", "label")


@query(f"WITH {AUCS} SELECT directory, file, {R6.format('roc_auc')} AS roc_auc, {R6.format('pr_auc')} AS pr_auc, status FROM aucs")
def roc_pr_auc(spark, sf_dir):
    return aucs(spark, sf_dir).withColumns({c: near(c) for c in ("roc_auc", "pr_auc")})


@query(f"""WITH {AUCS} SELECT directory, CAST(file AS VARCHAR) AS file, {R6.format('roc_auc')} AS roc_auc, {R6.format('pr_auc')} AS pr_auc, status FROM aucs
UNION ALL SELECT directory, '[FOLDER_SUMMARY]', {R6.format('avg(roc_auc)')}, {R6.format('avg(pr_auc)')}, 'success (averaged over ' || count(*) || ' files)' FROM aucs WHERE status = 'success' GROUP BY directory""")
def auc_folder_summary(spark, sf_dir):
    return metrics.with_summary(aucs(spark, sf_dir), "directory", "file").withColumns({c: near(c) for c in ("roc_auc", "pr_auc")})


BEDROC = RANKS + """, b AS (SELECT directory, file, sum(CASE WHEN label = 1 THEN exp(-20.0 * rank / n) ELSE 0 END) AS s, CAST(sum(label) AS DOUBLE) AS m, CAST(max(n) AS DOUBLE) AS n FROM ranks GROUP BY directory, file
), bed AS (SELECT directory, file, CASE WHEN m = 0 THEN 0.0 WHEN m = n THEN 1.0 ELSE (s / (m / n * (1 - exp(-20.0)) / (exp(20.0 / n) - 1)) - (1 - exp(20.0 * m / n)) / (m / n * (1 - exp(20.0))))
  / ((1 - exp(-20.0 * m / n)) / (m / n * (1 - exp(-20.0))) - (1 - exp(20.0 * m / n)) / (m / n * (1 - exp(20.0)))) END AS bedroc FROM b)"""


@query(f"WITH {BEDROC} SELECT directory, file, {R6.format('bedroc')} AS bedroc FROM bed")
def bedroc(spark, sf_dir):
    return metrics.bedroc(ranks(spark, sf_dir), GROUP, "label").withColumn("bedroc", near("bedroc"))


@query(f"WITH {BEDROC} SELECT directory, {R6.format('avg(bedroc)')} AS bedroc_mean, {R6.format('stddev_samp(bedroc)')} AS bedroc_std, count(*) AS file_count FROM bed GROUP BY directory")
def bedroc_summary(spark, sf_dir):
    return metrics.bedroc(ranks(spark, sf_dir), GROUP, "label").groupBy("directory").agg(near(F.avg("bedroc")).alias("bedroc_mean"), near(F.stddev_samp("bedroc")).alias("bedroc_std"), F.count("*").alias("file_count"))


@query(f"""WITH {SCORED}, st AS (SELECT directory, file, tied AS s, CAST(sum(label) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS c FROM scored GROUP BY directory, file, tied),
r AS (SELECT *, rank() OVER w AS lo, sum(c) OVER (PARTITION BY directory, file) AS n, coalesce(sum(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM st WINDOW w AS (PARTITION BY directory, file ORDER BY s DESC)),
b AS (SELECT directory, file, sum(p / c * (SELECT sum(exp(-20.0 * (k + j) / n)) FROM unnest(range(1, CAST(c AS BIGINT) + 1)) AS u(j))) AS s, sum(p) AS m, max(n) AS n FROM r GROUP BY directory, file), {BEDROC.split("), bed AS", 1)[1].join(["bed AS", ""])}
SELECT directory, file, {R6.format('bedroc')} AS bedroc FROM bed""")
def bedroc_of_ties(spark, sf_dir):
    return metrics.bedroc_of_steps(metrics.auc_steps(scored(spark, sf_dir, "l_quantity"), GROUP, "score", "label"), GROUP).withColumn("bedroc", near("bedroc"))


@query(f"WITH {SCORED} SELECT directory, {R6.format('avg(CASE WHEN (tied / 50 > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n FROM scored GROUP BY directory")
def accuracy_at_half(spark, sf_dir):
    return metrics.accuracy(scored(spark, sf_dir, "l_quantity"), ["directory"], F.col("score") / 50, "label").withColumn("accuracy", near("accuracy"))


@query(f"""SELECT DISTINCT w AS raw, CASE WHEN regexp_matches(upper(trim(w)), '^[{pairs.ALPHABET}]+$') THEN upper(trim(w)) END AS cleaned, CASE WHEN regexp_matches(w, '^[{pairs.ALPHABET}]+$') THEN w END AS strict
FROM (SELECT r_name AS w FROM region UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT p_type FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part)""")
def validate_sequences(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    words = t("region").select("r_name").union(t("customer").select("c_mktsegment")).union(t("part").select("p_type")).union(t("part").select(F.explode(F.split("p_name", " ")))).toDF("raw")
    return words.distinct().select("raw", pairs.clean_sequence("raw").alias("cleaned"), pairs.clean_sequence("raw", strict=True).alias("strict"))


POS = "pos AS (SELECT label AS peptide, vec_id AS tcr FROM embeddings)"
GRID = POS + ", grid AS (SELECT k.peptide, i.tcr FROM (SELECT DISTINCT peptide FROM pos) k CROSS JOIN (SELECT DISTINCT tcr FROM pos) i)"
LABEL = "labelled AS (SELECT g.peptide, g.tcr, CASE WHEN p.tcr IS NULL THEN 0 ELSE 1 END AS label FROM grid g LEFT JOIN (SELECT DISTINCT peptide, tcr FROM pos) p ON g.peptide = p.peptide AND g.tcr = p.tcr)"
LABELLED = f"{GRID}, {LABEL}"
NEG = GRID + ", neg AS (SELECT g.* FROM grid g ANTI JOIN pos p ON g.peptide = p.peptide AND g.tcr = p.tcr)"


def labelled(spark, sf_dir):
    pos = positives(spark, sf_dir)
    return pairs.candidate_pairs(pos, pos, pos, "peptide", "tcr")


@query(f"WITH {LABELLED} SELECT peptide, tcr, label FROM labelled")
def pair_generation_labeled(spark, sf_dir):
    return labelled(spark, sf_dir)


@query(f"WITH {LABELLED} SELECT tcr, peptide, label FROM labelled")
def project_format_a(spark, sf_dir):
    return pairs.layout(labelled(spark, sf_dir), "peptide", "tcr", "a")


@query(f"WITH {LABELLED} SELECT '' AS \"TCRA_CDR3\", tcr AS \"TCRB_CDR3\", peptide AS \"Epitope\", label FROM labelled")
def project_format_b(spark, sf_dir):
    return pairs.layout(labelled(spark, sf_dir), "peptide", "tcr", "b")


@query(f"WITH {LABELLED} SELECT '' AS \"TRA\", tcr AS \"TRB\", '' AS \"TRAV\", '' AS \"TRAJ\", '' AS \"TRBV\", '' AS \"TRBJ\", '' AS \"T_Cell_Type\", peptide AS \"Peptide\", '' AS \"MHC\", label FROM labelled")
def project_format_c(spark, sf_dir):
    return pairs.layout(labelled(spark, sf_dir), "peptide", "tcr", "c")


@query(f"WITH {NEG} SELECT peptide, tcr FROM neg")
def negative_pool_anti(spark, sf_dir):
    pos = positives(spark, sf_dir)
    return pairs.negatives(pos, pos, "peptide", "tcr")


@query(f"WITH {NEG} SELECT peptide, tcr FROM neg SEMI JOIN (SELECT p_partkey FROM part WHERE p_size > 10) a ON neg.tcr = a.p_partkey")
def allowed_negatives_semi(spark, sf_dir):
    allowed = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("tcr"))
    return negative_pool_anti(spark, sf_dir).join(allowed, "tcr", "left_semi").select("peptide", "tcr")


@query(f"""WITH r AS (SELECT p_partkey, upper(trim(p_brand)) AS a, upper(trim(split_part(p_name, ' ', 1))) AS b, upper(trim(split_part(p_name, ' ', 2))) AS p FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(a, '^[{pairs.ALPHABET}]+$') THEN a ELSE 'UNK' END AS tra, b AS trb, p AS peptide FROM r WHERE regexp_matches(b, '^[{pairs.ALPHABET}]+$') AND regexp_matches(p, '^[{pairs.ALPHABET}]+$')""")
def resolve_and_filter_pairs(spark, sf_dir):
    word = F.split("p_name", " ")
    named = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("a"), F.get(word, 0).alias("b"), F.get(word, 1).alias("p"))
    clean = named.select("p_partkey", F.coalesce(pairs.clean_sequence("a"), F.lit("UNK")).alias("tra"), pairs.clean_sequence("b").alias("trb"), pairs.clean_sequence("p").alias("peptide"))
    return clean.where("trb IS NOT NULL AND peptide IS NOT NULL")


DRAW = "md5('7:' || peptide || ':' || tcr)"
SUPPORT = NEG + f""", support AS (
  SELECT peptide, tcr, 1 AS label FROM (SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY {DRAW}, tcr) AS rn FROM (SELECT DISTINCT peptide, tcr FROM pos)) WHERE rn <= 2
  UNION ALL SELECT peptide, tcr, 0 FROM (SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY {DRAW}, tcr) AS rn FROM neg) WHERE rn <= 2)"""


@query(f"WITH {SUPPORT} SELECT peptide, tcr, label FROM support")
def kshot_support(spark, sf_dir):
    pos = positives(spark, sf_dir)
    return sampling.support(pos, pos, "peptide", "tcr", 2, "7")


@query(f"""WITH {SUPPORT}, {LABEL}
SELECT l.peptide, l.tcr, l.label FROM labelled l ANTI JOIN support s ON l.peptide = s.peptide AND l.tcr = s.tcr""")
def query_set_anti(spark, sf_dir):
    return pairs.without_support(labelled(spark, sf_dir), kshot_support(spark, sf_dir), "peptide", "tcr").select("peptide", "tcr", "label")


@query("SELECT d.doc_id, d.lang, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def score_left_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


SUPPLIERS = "sup AS (SELECT CAST(s_suppkey % 7 AS BIGINT) AS file, s_suppkey AS cdr3, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS label FROM supplier)"


def suppliers(spark, sf_dir):
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((key % 7).cast("long").alias("file"), key.alias("cdr3"), (key % 3 == 0).cast("int").alias("label"))


@query(f"""WITH {SUPPLIERS}, z AS (SELECT *, sum(label) OVER (PARTITION BY file) AS p, sum(1 - label) OVER (PARTITION BY file) AS q FROM sup),
d AS (SELECT file, sample, cdr3, label, CASE WHEN p = 0 THEN least(q, 1000) WHEN q = 0 THEN p ELSE least(p, q) END AS k, row_number() OVER (PARTITION BY file, sample, label ORDER BY md5('b' || sample || ':' || file || ':' || cdr3), cdr3) AS rn FROM z, (SELECT unnest(range(0, 100)) AS sample))
SELECT file, CAST(sample AS INT) AS sample, cdr3, label FROM d WHERE rn <= k""")
def balanced_sample(spark, sf_dir):
    return sampling.balanced(suppliers(spark, sf_dir), ["file"], "label", "cdr3", 100, "b")


@query(f"""WITH {SUPPLIERS}, n AS (SELECT unnest(range(0, 100)) AS sample), c AS (SELECT file, count(*) AS p FROM sup WHERE label = 1 GROUP BY file),
fit AS (SELECT s.file, s.cdr3, coalesce(c.p, 10000) AS k FROM sup s SEMI JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) a ON s.cdr3 = a.s_suppkey LEFT JOIN c ON s.file = c.file WHERE s.label = 0),
d AS (SELECT file, sample, cdr3, k, row_number() OVER (PARTITION BY file, sample ORDER BY md5('s' || sample || ':' || file || ':' || cdr3), cdr3) AS rn FROM fit, n)
SELECT file, CAST(sample AS INT) AS sample, cdr3, 0 AS label FROM d WHERE rn <= k UNION ALL SELECT file, CAST(sample AS INT), cdr3, 1 FROM sup, n WHERE label = 1""")
def shuffling_sample(spark, sf_dir):
    allowed = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("cdr3"))
    return sampling.shuffled(suppliers(spark, sf_dir), allowed, ["file"], "label", "cdr3", 100, "s")


@query(f"""WITH {NEG}, p AS (SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY md5('r:' || peptide || ':' || tcr), tcr) AS rn FROM (SELECT DISTINCT peptide, tcr FROM pos)),
q AS (SELECT peptide, round, tcr, row_number() OVER (PARTITION BY peptide, round ORDER BY md5('r' || round || ':' || peptide || ':' || tcr), tcr) AS rn FROM neg, (SELECT unnest(range(0, 3)) AS round) WHERE tcr % 2 = round % 2)
SELECT peptide, CAST(round AS INT) AS round, tcr, 1 AS label, 'positive' AS source FROM p, (SELECT unnest(range(0, 3)) AS round) WHERE rn <= 2
UNION ALL SELECT peptide, CAST(round AS INT), tcr, 0, CASE WHEN round % 2 = 0 THEN 'background' ELSE 'reshuffling' END FROM q WHERE rn <= 2""")
def multi_round_support(spark, sf_dir):
    pos = positives(spark, sf_dir)
    return sampling.rounds_of_support(pos, pos.where("tcr % 2 = 0"), pos.where("tcr % 2 = 1"), "peptide", "tcr", 2, 3, "r")


@query("""WITH f AS (SELECT source, ntile(5) OVER (ORDER BY md5('42:' || source)) AS fold FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))
SELECT d.doc_id, d.source, f.fold FROM documents d JOIN f ON d.source = f.source""")
def group_kfold(spark, sf_dir):
    return sampling.group_folds(table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "source"), "source", 5, "42").select("doc_id", "source", "fold")


@query("""SELECT peptide, tcr, CASE WHEN row_number() OVER (PARTITION BY peptide ORDER BY md5('m:' || peptide || ':' || tcr), tcr) <= floor(count(*) OVER (PARTITION BY peptide) * 0.5) THEN 'support' ELSE 'query' END AS role
FROM (SELECT label AS peptide, vec_id AS tcr FROM embeddings)""")
def majority_split(spark, sf_dir):
    return sampling.majority_split(positives(spark, sf_dir), "peptide", "tcr", 0.5, "m")


@query(f"""WITH {NEG}, drawn AS (SELECT peptide, tcr FROM (SELECT peptide, tcr, row_number() OVER (PARTITION BY peptide ORDER BY md5('m:' || peptide || ':' || tcr), tcr) AS rn, floor(count(*) OVER (PARTITION BY peptide) * 0.5) AS k FROM pos) WHERE rn <= k),
size AS (SELECT peptide, floor(count(*) * 0.5) AS k FROM pos GROUP BY peptide), no AS (SELECT n.peptide, n.tcr, row_number() OVER (PARTITION BY n.peptide ORDER BY md5('m:' || n.peptide || ':' || n.tcr), n.tcr) <= s.k AS known FROM neg n JOIN size s ON n.peptide = s.peptide)
SELECT peptide, tcr, CASE WHEN (peptide, tcr) IN (SELECT (peptide, tcr) FROM drawn) THEN '1' ELSE 'Unknown' END AS known_label, 1 AS label, CASE WHEN (peptide, tcr) IN (SELECT (peptide, tcr) FROM drawn) THEN 'train' ELSE 'test' END AS set FROM pos
UNION ALL SELECT peptide, tcr, CASE WHEN known THEN '0' ELSE 'Unknown' END, 0, CASE WHEN known THEN 'train' ELSE 'test' END FROM no""")
def majority_finetune(spark, sf_dir):
    pos = positives(spark, sf_dir)
    return sampling.majority_finetune(pos, pos, "peptide", "tcr", 0.5, "m")


@query("""WITH needs AS (SELECT label AS peptide, count(*) AS n FROM embeddings GROUP BY label), s AS (SELECT peptide, n, coalesce(sum(n) OVER (ORDER BY peptide ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM needs),
p AS (SELECT p_partkey AS tcr, row_number() OVER (ORDER BY md5('d:' || p_partkey), p_partkey) AS place FROM part)
SELECT s.peptide, p.tcr, p.place FROM s JOIN p ON p.place > s.lo AND p.place <= s.lo + s.n""")
def deal_negatives_offsets(spark, sf_dir):
    needs = positives(spark, sf_dir).groupBy("peptide").agg(F.count("*").alias("n"))
    pool = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tcr"))
    return sampling.dealt(needs, pool, "peptide", "n", "tcr", "d")


_ROWS = ", ".join(f"('{a}', {j}, CAST({v} AS DOUBLE))" for a, row in FACTORS.items() for j, v in enumerate(row))
_CODE = ", ".join(f"({p}, {j}, CAST({v!r} AS DOUBLE))" for p, row in enumerate(position_code(25)) for j, v in enumerate(row))


@query(f"""WITH f(a, j, v) AS (VALUES {_ROWS}), c(p, j, v) AS (VALUES {_CODE}), s AS (SELECT DISTINCT upper(p_name) AS seq FROM part),
r AS (SELECT seq, i, substr(seq, CAST(i AS INT), 1) AS a, length(regexp_replace(substr(seq, 1, CAST(i AS INT) - 1), '[^{"".join(FACTORS)}]', '', 'g')) AS before FROM s, (SELECT unnest(range(1, 26)) AS i))
SELECT seq, CAST((i - 1) * 5 + j.j AS INT) AS pos, {R6.format('coalesce(f.v + c.v, 0.0)')} AS value FROM r CROSS JOIN (SELECT unnest(range(0, 5)) AS j) j LEFT JOIN f ON f.a = r.a AND f.j = j.j LEFT JOIN c ON c.p = r.before AND c.j = j.j""")
def atchley_encode(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.upper("p_name").alias("seq")).distinct()
    return words.select("seq", F.posexplode(encoded("seq", 25)).alias("pos", "value")).withColumn("value", near("value"))


@query(f"""WITH {SUPPORT}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT s.peptide, g.i, avg(list_extract(e.v, CAST(g.i AS INT))) AS x FROM support s JOIN e ON s.tcr = e.vec_id, (SELECT unnest(range(1, 65)) AS i) g WHERE s.label = 1 GROUP BY s.peptide, g.i),
v AS (SELECT peptide, list(x ORDER BY i) AS mean FROM m GROUP BY peptide)
SELECT v.peptide, e.vec_id AS tcr, {R6.format('list_inner_product(e.v, v.mean)')} AS score FROM v CROSS JOIN e WHERE NOT EXISTS (SELECT 1 FROM support s WHERE s.peptide = v.peptide AND s.tcr = e.vec_id)""")
def prototype_fewshot_score(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tcr"), "embedding")
    drawn = kshot_support(spark, sf_dir)
    rest = pairs.without_support(labelled(spark, sf_dir), drawn, "peptide", "tcr").select("peptide", "tcr").join(vectors, "tcr")
    return scoring.prototype_scores(drawn.where("label = 1").join(vectors, "tcr"), rest, "peptide", "embedding").select("peptide", "tcr", near("score").alias("score"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R6.format('l_discount * 0.86 + l_tax * 0.14')} AS zero_shot, {R6.format('l_discount * 0.59 + l_tax * 0.41')} AS majority, {R6.format('l_tax')} AS few_shot FROM lineitem")
def weighted_chain_ensemble(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    for mode in scoring.CHAIN_WEIGHTS:
        df = scoring.weighted_chains(df, mode, "l_discount", "l_tax").withColumn(mode.replace("-", "_"), near("score"))
    return df.drop("score", "l_discount", "l_tax")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R6.format('1 - (l_discount * 8 + l_tax * 9 + l_quantity / 60) / 3')} AS probability,
CASE WHEN (l_discount * 8 + l_tax * 9 + l_quantity / 60) / 3 > 0.5 THEN 'negative' ELSE 'positive' END AS verdict FROM lineitem""")
def mean_ensemble_verdict(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    p, verdict = scoring.mean_verdict(F.col("l_discount") * 8, F.col("l_tax") * 9, F.col("l_quantity") / 60)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", near(p).alias("probability"), verdict.alias("verdict"))


@query(f"""WITH k(slot) AS (SELECT unnest(range(0, 64))), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT vec_id, slot, list_extract(v, CAST(slot + 1 AS INT)) / sqrt(list_inner_product(v, v)) AS x FROM e, k), z AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id)) AS w FROM s)
SELECT vec_id, CAST(slot AS INT) AS slot, {R6.format('w / sum(w) OVER (PARTITION BY vec_id)')} AS weight FROM z""")
def memory_softmax_weights(spark, sf_dir):
    # The cosine of a vector with each unit slot is its number there over its length.
    sims = table(spark, sf_dir, "embeddings").select("vec_id", F.sqrt(scoring.dot("embedding", "embedding")).alias("length"), F.posexplode("embedding").alias("slot", "v")).select("vec_id", "slot", (F.col("v").cast("double") / F.col("length")).alias("x"))
    return scoring.softmax_weights(sims, ["vec_id"], "x").select("vec_id", "slot", near("weight").alias("weight"))


@query(f"WITH t AS (SELECT o_custkey % 50 AS step, avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS x, avg(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) AS y FROM orders GROUP BY 1) SELECT step, {R6.format('(x + y) / 2')} AS loss FROM t ORDER BY (x + y) / 2, step LIMIT 1")
def best_step_by_val_loss(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("step"), (F.col("o_orderkey") % 2).alias("odd"), "o_totalprice")
    trace = lambda odd: orders.where(F.col("odd") == odd).groupBy("step").agg(F.avg("o_totalprice").alias("val_loss"))
    return scoring.best_step(trace(0), trace(1)).withColumn("loss", near("loss"))


@query("SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY user_id, event_type")
def first_occurrence_dedupe(spark, sf_dir):
    return pairs.first_occurrence(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")


@query("SELECT p_partkey, floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / 7)::BIGINT AS batch, (floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / 7)::BIGINT) % 3 AS worker FROM part")
def batch_numbering(spark, sf_dir):
    return ranking.batches(table(spark, sf_dir, "part"), ["p_partkey"], 7, 3, ["p_brand"]).select("p_partkey", "batch", "worker")


@query()
def rf_train_predict(spark, sf_dir):
    """A forest on the 200 numbers of each pair, learned on four folds of names; the names of the fifth are scored."""
    word = F.split(F.upper("p_name"), " ")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.get(word, 0).alias("peptide"), F.get(word, 1).alias("tcr"))
    rows = sampling.group_folds(rows, "p_name", 5, "42").withColumn("label", (F.length("peptide") >= F.length("tcr")).cast("double"))
    # A forest keeps its rows in the tasks that it gets them in: small rows are dealt before they become large vectors.
    rows = spread(rows, "p_partkey").withColumn("feature", F.when(F.col("peptide").isNotNull() & F.col("tcr").isNotNull(), features.pair_feature("peptide", "tcr")))
    model = scoring.forest(rows.where("fold > 1 AND label IS NOT NULL"), ["feature"], "label")
    return model(rows.where("fold = 1")).select("p_partkey", "p_name", "fold", "label", F.round("score", 4).alias("score"))
