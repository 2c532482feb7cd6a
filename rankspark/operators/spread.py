"""Few rows from which many or large ones are made: dealt over the tasks first, as Spark joins small partitions by their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt over the session's shuffle partitions, of which none are joined; by columns, or evenly without any."""
    return df.repartition(shuffle_partitions(df.sparkSession), *by)
