"""Rows with their position in the file they come from, over files of several splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark.operators.ranges import with_spans
from rankspark.sources.tables import SUFFIXES


def with_positions(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """The rows of a file, or of all files of a kind below a folder, with ``file_name`` and ``pos`` (from 0 in file order).

    Parquet tells a row's place itself. A csv file's splits are counted, and the rows of the splits before are added to the
    place in the own split; blank lines are no rows, and a header is not counted.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.schema(schema) if schema else reader
    if not path.rstrip("/").lower().endswith(("." + kind, ".par")):
        reader = reader.option("pathGlobFilter", SUFFIXES[kind])
    if kind == "parquet":
        return reader.parquet(path).select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("pos"))
    rows = reader.option("header", True).csv(path)
    own = rows.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"))
    split = ["__path", "__block"]
    sizes = own.groupBy(*split).agg(F.count("*").alias("__rows"))
    before = Window.partitionBy("__path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*split, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*split).orderBy("__id")) - 1
    placed = own.withColumn("__id", F.monotonically_increasing_id()).withColumn("__own", place)
    return with_spans(placed, starts, split).withColumn("pos", (F.col("__before") + F.col("__own")).cast("long")).drop("__id", "__own", "__before", *split)


def zipped_by_position(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of two positioned tables side by side; rows without a partner are left out. ``b``'s file name is dropped."""
    return a.join(b.drop("file_name"), "pos")
