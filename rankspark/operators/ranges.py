"""Ranks, running sums and neighbours of ordered groups, however long a group is.

Rows are dealt by ranges of (group, order), which Spark takes from a sample of the rows, and sorted within each range.
A row's number in its range comes from its place there; the rows and sums of the group's earlier ranges are added, and
only these - one row a range and group - pass through windows over whole groups. Ties at the border of two ranges are
told apart by the tie columns, so that a value which most rows share is split as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.sources.stored import written

PART, PLACE = "__part", "__place"


def with_spans(rows: DataFrame, spans: DataFrame, on: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``spans``, one row at most for each of ``on``."""
    named = spans.select(*[F.col(c).alias(f"__s_{c}") for c in on], *[c for c in spans.columns if c not in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    return rows.join(named, cond).drop(*[f"__s_{c}" for c in on])


def in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """``df``, stored, with its range and the place there; a range may hold several groups, and a group several ranges.

    Without a number of ``parts`` they are the session's shuffle partitions, of which Spark joins small ones.
    """
    by = [*([parts] if parts else []), *map(F.col, group), *order]
    number = F.monotonically_increasing_id()  # the partition in the upper bits, the row in the lower 33
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by[bool(parts) :]).withColumn(PLACE, number)
    return written(dealt).withColumn(PART, F.shiftright(PLACE, 33)).withColumn(PLACE, F.col(PLACE).bitwiseAND((1 << 33) - 1))


def numbered(rows: DataFrame, group: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank`` (from 1) and ``n`` to rows of ``in_ranges``, and for each of ``sums`` what earlier ranges have (``before_``) and all (``total_``)."""
    spans = rows.groupBy(*group, PART).agg(F.min(PLACE).alias("__first"), F.count("*").alias("__rows"), *[F.sum(c).alias(f"__sum_{c}") for c in sums])
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    spans = spans.select(*group, PART, (before("__rows") - F.col("__first")).alias("__shift"), F.sum("__rows").over(whole).alias("n"), *[x for c in sums for x in (before(f"__sum_{c}").alias(f"before_{c}"), F.sum(f"__sum_{c}").over(whole).alias(f"total_{c}"))])
    return with_spans(rows, spans, [*group, PART]).withColumn("rank", (F.col(PLACE) + F.col("__shift") + 1).cast("long")).drop("__shift")


def running(rows: DataFrame, group: Sequence[str], value: str) -> Column:
    """The sum of ``value`` up to each row of ``numbered``: inside its range, and what earlier ranges have."""
    inside = Window.partitionBy(*group, PART).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value).over(inside) + F.col(f"before_{value}")


def with_next(rows: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds ``next_`` columns, the values of the group's next row, across ranges too; null at the end."""
    inside = Window.partitionBy(*group, PART).orderBy(PLACE)
    first = rows.groupBy(*group, PART).agg(F.min_by(F.struct(*columns), PLACE).alias("__head"))
    heads = first.select(*group, PART, F.lead("__head").over(Window.partitionBy(*group).orderBy(PART)).alias("__head"))
    out = with_spans(rows.withColumn("__next", F.lead(F.struct(*columns)).over(inside)), heads, [*group, PART])
    return out.withColumn("__next", F.coalesce("__next", "__head")).select(*rows.columns, *[F.col("__next").getField(c).alias(f"next_{c}") for c in columns])
