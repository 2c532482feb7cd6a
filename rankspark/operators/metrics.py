"""Classification and early-recognition metrics per group, as windows and aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.operators import ranges


def auc_by_group(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """(group, roc_auc, pr_auc, status); both areas are null where a class is missing.

    Rows are summed by (group, score) first, so windows see distinct scores only. ROC: pairs won plus half the ties.
    PR: trapezoids over (recall, precision) from the point (0, 1). A group with a null or NaN score has an error status.
    """
    return auc_of_steps(auc_steps(df, group, score, label), group)


def auc_steps(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """(group, __s, p, c): positives and rows of each score. Sums of such tables are those of the rows together."""
    value = F.nanvl(F.col(score).cast("double"), F.lit(None))
    return df.groupBy(*group, value.alias("__s")).agg(F.sum(label).cast("double").alias("p"), F.count("*").cast("double").alias("c"))


def auc_of_steps(steps: DataFrame, group: Sequence[str]) -> DataFrame:
    """The areas of ``auc_steps``."""
    down = Window.partitionBy(*group).orderBy(F.col("__s").desc())
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    steps = steps.select(*group, "__s", "p", "c", F.sum("p").over(so_far).alias("tp"), F.sum("c").over(so_far).alias("k"), F.sum("p").over(whole).alias("m"), F.sum("c").over(whole).alias("n"))
    steps = steps.withColumn("rec", F.when(F.col("m") > 0, F.col("tp") / F.col("m"))).withColumn("prec", F.col("tp") / F.col("k"))
    steps = steps.withColumn("rec0", F.lag("rec", 1, 0.0).over(down)).withColumn("prec0", F.lag("prec", 1, 1.0).over(down))
    won = F.col("p") * ((F.col("n") - F.col("m")) - (F.col("k") - F.col("tp")) + (F.col("c") - F.col("p")) / 2)
    out = steps.groupBy(*group).agg(F.max(F.col("__s").isNull()).alias("odd"), F.sum(won).alias("won"), F.max("m").alias("m"), F.max("n").alias("n"), F.sum((F.col("rec") - F.col("rec0")) * (F.col("prec") + F.col("prec0")) / 2).alias("area"))
    two = (F.col("m") > 0) & (F.col("m") < F.col("n")) & ~F.col("odd")
    return out.select(*group, F.when(two, F.col("won") / (F.col("m") * (F.col("n") - F.col("m")))).alias("roc_auc"), F.when(two, F.col("area")).alias("pr_auc"), F.when(F.col("odd"), "error: score is null or not a number").when(two, "success").otherwise("insufficient samples").alias("status"))


def with_summary(aucs: DataFrame, directory: str, file: str) -> DataFrame:
    """The rows and, for each directory with a success, one row of means."""
    means = aucs.where("status = 'success'").groupBy(directory).agg(F.avg("roc_auc").alias("roc_auc"), F.avg("pr_auc").alias("pr_auc"), F.count("*").alias("c"))
    means = means.select(directory, F.lit("[FOLDER_SUMMARY]").alias(file), "roc_auc", "pr_auc", F.format_string("success (averaged over %d files)", "c").alias("status"))
    return aucs.withColumn(file, F.col(file).cast("string")).unionByName(means)


def bedroc(ranks: DataFrame, group: Sequence[str], label: str, alpha: float = 20.0) -> DataFrame:
    """(group, bedroc): 0 without a positive, 1 with positives only."""
    each = ranks.groupBy(*group).agg(F.sum(F.when(F.col(label) == 1, F.exp(-alpha * F.col("rank") / F.col("n"))).otherwise(0.0)).alias("s"), F.sum(label).cast("double").alias("m"), F.max("n").cast("double").alias("n"))
    return each.select(*group, _bedroc(alpha).alias("bedroc"))


def _bedroc(alpha: float) -> Column:
    """From s, the sum over positives of exp(-alpha * rank / n), m positives and n rows."""
    share = F.col("m") / F.col("n")
    rie = F.col("s") / (share * (1 - math.exp(-alpha)) / (F.exp(alpha / F.col("n")) - 1))
    most = (1 - F.exp(-alpha * share)) / (share * (1 - math.exp(-alpha)))
    least = (1 - F.exp(alpha * share)) / (share * (1 - math.exp(alpha)))
    return F.when(F.col("m") == 0, 0.0).when(F.col("m") == F.col("n"), 1.0).otherwise((rie - least) / (most - least))


def bedroc_of_steps(steps: DataFrame, group: Sequence[str], alpha: float = 20.0) -> DataFrame:
    """(group, bedroc) of ``auc_steps``: equal scores share the mean of their ranks' weights, a closed geometric sum.

    Steps of parts of the rows add up to the steps of all, so this is what batches of files merge to. It passes through
    windows over the different scores of a group. A null score ranks last.
    """
    down = Window.partitionBy(*group).orderBy(F.col("__s").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(*group, "p", "c", F.coalesce(F.sum("c").over(down), F.lit(0.0)).alias("k"), F.sum("c").over(Window.partitionBy(*group)).alias("n"))
    a = alpha / F.col("n")
    block = F.exp(-a * (F.col("k") + 1)) * (1 - F.exp(-a * F.col("c"))) / (1 - F.exp(-a))
    each = steps.groupBy(*group).agg(F.sum(F.col("p") / F.col("c") * block).alias("s"), F.sum("p").alias("m"), F.max("n").alias("n"))
    return each.select(*group, _bedroc(alpha).alias("bedroc"))


def zero_filled(curve: DataFrame, directory: str, y: str) -> DataFrame:
    """Zeros become a tenth of the directory's least positive value, or 1e-10 where all are zero."""
    least = curve.groupBy(directory).agg(F.min(F.when(F.col(y) > 0, F.col(y))).alias("__least"))
    return ranges.with_spans(curve, least, [directory]).withColumn(y, F.when(F.col(y) == 0, F.coalesce(F.col("__least") / 10, F.lit(1e-10))).otherwise(F.col(y))).drop("__least")


def partial_areas(curve: DataFrame, directory: str, x: str, y: str, cutoffs: Sequence[float]) -> DataFrame:
    """(directory, cutoff, n_rows, area) under the curve up to each share of its x range, over the normalised x.

    Equal x are averaged; a curve may be longer than a task can hold, see ``ranges``; the cut point is interpolated; null with fewer than two points up to it, or no x range.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    points = curve.where(finite(x) & finite(y)).groupBy(directory, F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("y"), F.count("*").alias("c"))
    points = ranges.in_ranges(points, [directory], [F.col("x")])
    whole = points.groupBy(directory).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("c").alias("n_rows"))
    points = ranges.with_spans(ranges.with_next(points, [directory], ["x", "y"]), whole, [directory])
    points = points.select(directory, "x", "y", F.col("next_x").alias("x1"), F.col("next_y").alias("y1"), "lo", "hi", "n_rows")
    points = points.select("*", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])).alias("cutoff")).withColumn("cut", F.col("lo") + F.col("cutoff") * (F.col("hi") - F.col("lo")))
    end = F.col("y") + (F.col("cut") - F.col("x")) / (F.col("x1") - F.col("x")) * (F.col("y1") - F.col("y"))
    part = F.when(F.col("x1").isNull() | (F.col("x") >= F.col("cut")), 0.0).when(F.col("x1") <= F.col("cut"), (F.col("x1") - F.col("x")) * (F.col("y") + F.col("y1")) / 2).otherwise((F.col("cut") - F.col("x")) * (F.col("y") + end) / 2)
    kept = F.sum(F.when(F.col("x") <= F.col("cut"), 1).otherwise(0))
    fine = (kept >= 2) & (F.max("hi") > F.min("lo")) & (F.col("cutoff") > 0) & (F.col("cutoff") <= 1)
    return points.groupBy(directory, "cutoff").agg(F.max("n_rows").alias("n_rows"), F.when(fine, F.sum(part) / (F.max("hi") - F.min("lo"))).alias("area"))


def cutoff_label(cutoff: float) -> str:
    """0.001 -> AUC_0_1pct_area."""
    return "AUC_" + f"{cutoff * 100:.6f}".rstrip("0").rstrip(".").replace(".", "_") + "pct_area"


def pivoted(areas: DataFrame, directory: str, cutoffs: Sequence[float]) -> DataFrame:
    """One column for each cutoff."""
    return areas.groupBy(directory).agg(F.max("n_rows").alias("n_rows"), *[F.max(F.when(F.col("cutoff") == c, F.col("area"))).alias(cutoff_label(c)) for c in cutoffs])


def step_accuracy(df: DataFrame, epoch: str, step: str, correct: Column) -> DataFrame:
    """(epoch, step, accuracy) over all tasks of a step."""
    return df.groupBy(epoch, step).agg(F.avg(correct.cast("double")).alias("accuracy"))


def epoch_accuracy(steps: DataFrame, epoch: str, step: str) -> DataFrame:
    """Each epoch's accuracy at its last step and the mean of its steps."""
    return steps.groupBy(epoch).agg(F.max_by("accuracy", step).alias("last_accuracy"), F.avg("accuracy").alias("mean_accuracy"))


def accuracy(df: DataFrame, group: Sequence[str], probability: Column, label: str) -> DataFrame:
    """Share of rows whose decision at one half is the label."""
    return df.groupBy(*group).agg(F.avg(((probability > 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("n"))
