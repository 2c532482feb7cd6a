"""Registered queries over folders of files, which they write from the driver's tables into the shared folder and read back.

The folders hold prediction files, one for each brand and key modulo five: even brands as csv, odd ones as parquet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.operators import metrics
from rankspark.plans.registry import ORACLES, R6, SCORED, near, query, scored
from rankspark.sources import tables
from rankspark.sources.stored import shared_folder, written

COLUMNS = "score double, label int"
SIDE = "CASE WHEN CAST(regexp_extract(directory, '[0-9]+$', 0) AS INT) % 2 = 0 THEN 'csv' ELSE 'parquet' END"
PATH = f"{SIDE} || '/brand=' || regexp_extract(directory, '[0-9]+$', 0) || '/file=' || file"


def folder(spark, sf_dir) -> str:
    """The root of a new tree ``<kind>/brand=<number>/file=<number>/``."""
    root = f"{shared_folder(spark)}/folder-{uuid.uuid4().hex}"
    rows = written(scored(spark, sf_dir, "l_quantity").select(F.regexp_extract("directory", "[0-9]+$", 0).cast("int").alias("brand"), "file", "score", "label"))  # joined once for both kinds
    for kind, odd in (("csv", 0), ("parquet", 1)):
        tables.write_tree(rows.where(F.col("brand") % 2 == odd), f"{root}/{kind}", ["brand", "file"], ["score"], kind, "none" if kind == "csv" else "gzip")
    return root


def named(df: DataFrame) -> DataFrame:
    """The brand and file of a directory of ``folder``."""
    part = lambda p: F.regexp_extract("directory", p, 1)
    return df.select(F.concat(F.lit("Brand#"), part("brand=([0-9]+)")).alias("directory"), part("file=([0-9]+)").cast("long").alias("file"), *[c for c in df.columns if c != "directory"])


@query(ORACLES["roc_pr_auc"])
def folder_auc(spark, sf_dir):
    """Both formats in one folder, each directory a ranking."""
    files = tables.load_folder(spark, folder(spark, sf_dir), "any", COLUMNS)
    return named(metrics.auc_by_group(files, ["directory"], "score", "label")).withColumns({c: near(c) for c in ("roc_auc", "pr_auc")})


@query(f"WITH {SCORED} SELECT {SIDE} AS top, count(DISTINCT (directory, file)) AS directories, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM scored GROUP BY {SIDE}")
def folder_first_level(spark, sf_dir):
    """The first folders of a tree, each taken as one."""
    files = tables.first_level(tables.load_folder(spark, folder(spark, sf_dir), "any", COLUMNS))
    return files.groupBy("top").agg(F.count_distinct("directory").alias("directories"), F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"))


@query(f"WITH {SCORED} SELECT DISTINCT {PATH} AS directory FROM scored")
def folder_directories(spark, sf_dir):
    """The directories with data."""
    return tables.data_directories(tables.load_folder(spark, folder(spark, sf_dir), "any", COLUMNS))


@query(f"WITH {SCORED} SELECT {PATH} AS directory, {R6.format('avg(CASE WHEN (tied / 50 > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n FROM scored WHERE {SIDE} = 'csv' AND file >= 2 GROUP BY ALL")
def folder_not_done(spark, sf_dir):
    """One kind's folder alone is listed; the directories whose results are there already are not evaluated again."""
    files = tables.load_folder(spark, folder(spark, sf_dir), "csv", COLUMNS, directory="csv")
    measure = lambda df: metrics.accuracy(df, ["directory"], F.col("score") / 50, "label")
    done = written(measure(files.where("directory RLIKE 'file=[01]$'")))
    return measure(tables.not_done(files, done, ["directory"])).withColumn("accuracy", near("accuracy"))
