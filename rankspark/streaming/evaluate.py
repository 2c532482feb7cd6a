"""Incremental evaluation: each batch of new prediction files adds sums by score, from which all areas are computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.operators.metrics import auc_of_steps, auc_steps, bedroc_of_steps


def _each_batch(spark: SparkSession, source: str, schema: str, checkpoint: str, run: Callable[[DataFrame, int], None]) -> None:
    """Give the files that are there and were not given before to ``run``, then stop."""
    stream = spark.readStream.schema(schema).parquet(source).select("*", F.col("_metadata.file_path").alias("__file"))
    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def evaluate_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, group: list[str], score: str, label: str) -> DataFrame:
    """Process the files that are there, stop, and return areas and early recognition (``bedroc``) of all files seen so far.

    A batch's sums replace those of the same batch, so a replay changes nothing, and a group whose files come in several
    batches gets one result over all of them.
    """

    def batch(df: DataFrame, number: int) -> None:
        auc_steps(df, group, score, label).write.mode("overwrite").parquet(f"{target}/batch={number}")

    _each_batch(spark, source, schema, checkpoint, batch)
    steps = spark.read.parquet(target).groupBy(*group, "__s").agg(F.sum("p").alias("p"), F.sum("c").alias("c"))
    early = bedroc_of_steps(steps, group)
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__e_{c}"))
    return auc_of_steps(steps, group).join(early.select(*[F.col(c).alias(f"__e_{c}") for c in group], "bedroc"), same).drop(*[f"__e_{c}" for c in group])


def score_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Append the scored rows of new files to ``target`` and return all that is there, with the column ``__file``.

    Every batch has a folder of its own that a replay writes anew, so no row comes twice, whenever the run is cut off.
    """

    def batch(df: DataFrame, number: int) -> None:
        scorer(df).write.mode("overwrite").parquet(f"{target}/batch={number}")

    _each_batch(spark, source, schema, checkpoint, batch)
    return spark.read.parquet(target).drop("batch")


def ledger(scored: DataFrame) -> DataFrame:
    """(file, n_rows) of the files that were scored."""
    return scored.groupBy(F.col("__file").alias("file")).agg(F.count("*").alias("n_rows"))
