"""Ranks within groups and the curves over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.operators import ranges


def best_first(score: str, ties: Sequence[str]) -> list[Column]:
    """A total order: score from high to low, NaN and null last, then the tie columns."""
    return [F.nanvl(F.col(score).cast("double"), F.lit(None)).desc_nulls_last(), *map(F.col, ties)]


def ranked(df: DataFrame, group: Sequence[str], score: str, ties: Sequence[str], sums: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Adds ``rank`` (from 1) and ``n`` (rows of the group), and totals of ``sums`` for the functions below.

    A group may be longer than a task can hold: rows are ranked in ranges, see ``ranges``.
    """
    return ranges.numbered(ranges.in_ranges(df, group, best_first(score, ties), parts), group, sums)


def positive_positions(ranks: DataFrame, group: Sequence[str], label: str) -> DataFrame:
    """(group, position, ordinal) of each positive, position being its 0-based rank over n; (-1, 0) for groups with none.

    ``ranks``: of ``ranked`` with ``label`` among its sums.
    """
    found = ranks.where(F.col(label) == 1)
    found = found.select(*group, ((F.col("rank") - 1) / F.col("n")).alias("position"), ranges.running(found, group, label).cast("long").alias("ordinal"))
    none = ranks.where((F.col("rank") == 1) & (F.coalesce(f"total_{label}", F.lit(0)) == 0))
    return found.unionByName(none.select(*group, F.lit(-1.0).alias("position"), F.lit(0).cast("long").alias("ordinal")))


def rate_curve(ranks: DataFrame, group: Sequence[str], directory: str, label: str, ratio: float) -> DataFrame:
    """Recall and precision at every rank up to a ratio of the group, averaged over the directory's groups.

    Groups without a positive are left out; at each rank only groups that reach it count. ``ranks``: of ``ranked`` with
    ``label`` among its sums.
    """
    kept = ranks.where((F.col(f"total_{label}") > 0) & (F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * ratio))))
    hits = kept.select(directory, "rank", F.col(f"total_{label}").alias("total"), ranges.running(kept, group, label).alias("hits"))
    return hits.groupBy(directory, F.col("rank").alias("top_k")).agg(F.avg(F.col("hits") / F.col("total")).alias("success_rate"), F.avg(F.col("hits") / F.col("rank")).alias("hit_rate"))


def batches(df: DataFrame, order: Sequence[str], size: int, workers: int, within: Sequence[str]) -> DataFrame:
    """Adds ``batch`` (of ``size`` rows in a group) and ``worker`` (batches dealt in turn)."""
    place = F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(place / size).cast("long")).withColumn("worker", F.pmod("batch", F.lit(workers)).cast("long"))
