"""Reproducible samples: rows are ordered by md5(seed:key), so a draw needs no random state and no driver."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.operators.spread import spread


def draw_order(seed: str | Column, *key: str) -> Column:
    seed = F.lit(seed) if isinstance(seed, str) else seed.cast("string")
    return F.md5(F.concat_ws(":", seed, *[F.col(k).cast("string") for k in key]))


def first_k(df: DataFrame, group: Sequence[str], order: Column, k: Column | int, *ties: str) -> DataFrame:
    """The first ``k`` rows of each group in drawing order."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(order, *ties))
    return df.withColumn("__place", place).where(F.col("__place") <= k).drop("__place")


def balanced(df: DataFrame, group: Sequence[str], label: str, key: str, samples: int, seed: str, most: int = 1000) -> DataFrame:
    """(group, sample, key, label): equal numbers of both labels; without a positive at most ``most`` negatives."""
    sizes = df.groupBy(*group).agg(F.sum(label).alias("__p"), F.sum(1 - F.col(label)).alias("__n"))
    size = F.when(F.col("__p") == 0, F.least("__n", F.lit(most))).when(F.col("__n") == 0, F.col("__p")).otherwise(F.least("__p", "__n"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    sized = df.alias("a").join(sizes.alias("b"), reduce(and_, same)).select(*[f"a.{c}" for c in group], f"a.{key}", f"a.{label}", size.alias("__k"))
    many = spread(sized).select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    order = draw_order(F.concat(F.lit(seed), F.col("sample").cast("string")), *group, key)
    return first_k(many, [*group, "sample", label], order, F.col("__k"), key).select(*group, "sample", key, label)


def shuffled(df: DataFrame, allowed: DataFrame, group: Sequence[str], label: str, key: str, samples: int, seed: str, most: int = 10_000) -> DataFrame:
    """All positives and as many allowed negatives whose key is no positive of the group (``most`` without positives)."""
    positives = df.where(F.col(label) == 1).select(*group, key)
    count = positives.groupBy(*group).agg(F.count("*").alias("__p"))
    fit = df.where(F.col(label) == 0).join(allowed.select(key).distinct(), key, "left_semi").join(positives.distinct(), [*group, key], "left_anti").select(*group, key)
    fit = fit.join(count, list(group), "left").withColumn("__k", F.coalesce("__p", F.lit(most)))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")
    drawn = first_k(spread(fit.select(*group, key, "__k")).select("*", numbers), [*group, "sample"], draw_order(F.concat(F.lit(seed), F.col("sample").cast("string")), *group, key), F.col("__k"), key)
    return positives.select(*group, numbers, key, F.lit(1).alias(label)).unionByName(drawn.select(*group, "sample", key, F.lit(0).alias(label)))


def support(positives: DataFrame, pool: DataFrame, key: str, item: str, k: int, seed: str) -> DataFrame:
    """k positives and k negatives of each key."""
    from rankspark.operators.pairs import negatives

    order = draw_order(seed, key, item)
    yes = first_k(positives.select(key, item).distinct(), [key], order, k, item).withColumn("label", F.lit(1))
    return yes.unionByName(first_k(negatives(pool, positives, key, item), [key], order, k, item).withColumn("label", F.lit(0)))


def rounds_of_support(positives: DataFrame, background: DataFrame, reshuffled: DataFrame, key: str, item: str, k: int, rounds: int, seed: str) -> DataFrame:
    """(key, round, item, label, source): shared positives; even rounds draw from the background, odd ones elsewhere."""
    from rankspark.operators.pairs import negatives

    number = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")
    yes = first_k(positives.select(key, item).distinct(), [key], draw_order(seed, key, item), k, item).select(key, number, item, F.lit(1).alias("label"), F.lit("positive").alias("source"))
    parts = [yes]
    for odd, (name, pool) in enumerate((("background", background), ("reshuffling", reshuffled))):
        each = negatives(pool, positives, key, item).select(key, number, item).where(F.col("round") % 2 == odd)
        parts.append(first_k(each, [key, "round"], draw_order(F.concat(F.lit(seed), F.col("round").cast("string")), key, item), k, item).select(key, "round", item, F.lit(0).alias("label"), F.lit(name).alias("source")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def numbered(df: DataFrame, order: Column, *ties: str) -> DataFrame:
    """Adds ``place`` (from 1) in the order: rows are cut into ranges, and each range's number starts after the rows before.

    Ranges are bounds of the first 24 bits of ``order``, an md5 text, so a row's range does not hang on a sample of the
    data. One row a range goes through a single task.
    """
    ranges = 4096
    cut = df.withColumn("__order", order).withColumn("__range", F.floor(F.conv(F.substring("__order", 1, 6), 16, 10).cast("long") * ranges / (1 << 24)))
    sizes = cut.groupBy("__range").agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy("__order", *ties))
    return cut.withColumn("__own", own).join(F.broadcast(starts), "__range").withColumn("place", (F.col("__before") + F.col("__own")).cast("long")).drop("__order", "__range", "__own", "__before")


def group_folds(df: DataFrame, group: str, folds: int, seed: str) -> DataFrame:
    """Adds ``fold`` (from 1); whole groups fall into one, the first folds are larger by one group."""
    each = df.select(group).distinct()
    placed = numbered(each, draw_order(seed, group), group)
    n = each.agg(F.count("*").alias("__n"))
    size, larger = F.floor(F.col("__n") / folds), F.col("__n") % folds
    first = larger * (size + 1)  # groups in the larger folds
    fold = F.when(F.col("place") <= first, F.ceil(F.col("place") / (size + 1))).otherwise(larger + F.ceil((F.col("place") - first) / F.greatest(size, F.lit(1))))
    return df.join(placed.join(F.broadcast(n)).select(group, fold.cast("long").alias("fold")), group)


def majority_split(df: DataFrame, group: str, item: str, ratio: float, seed: str) -> DataFrame:
    """Adds ``role``: support for floor(n x ratio) rows of each group in drawing order, else query."""
    own = Window.partitionBy(group)
    place = F.row_number().over(own.orderBy(draw_order(seed, group, item), item))
    return df.withColumn("role", F.when(place <= F.floor(F.count("*").over(own) * ratio), "support").otherwise("query"))


def majority_finetune(positives: DataFrame, pool: DataFrame, key: str, item: str, ratio: float, seed: str) -> DataFrame:
    """(key, item, known_label, label, set): all positives and all of the pool that is no positive of the key.

    The support of ``majority_split`` and as many negatives, first in drawing order, are the set 'train' and known; the
    others are the set 'test' and their known_label is 'Unknown'. Repeated positives stay and share one set, as their
    pair is drawn or not; a pool with too few negatives gives all of them.
    """
    from rankspark.operators.pairs import negatives

    split = majority_split(positives.select(key, item), key, item, ratio, seed)
    drawn = split.where("role = 'support'").select(key, item).distinct().withColumn("__in", F.lit(True))
    yes = positives.select(key, item).join(drawn, [key, item], "left").select(key, item, F.lit(1).alias("label"), F.coalesce("__in", F.lit(False)).alias("__in"))
    size = positives.groupBy(key).agg(F.floor(F.count("*") * ratio).alias("__k"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(draw_order(seed, key, item), item))
    no = negatives(pool, positives, key, item).join(size, key).select(key, item, F.lit(0).alias("label"), (place <= F.col("__k")).alias("__in"))
    known = F.when(F.col("__in"), F.col("label").cast("string")).otherwise("Unknown")
    return yes.unionByName(no).select(key, item, known.alias("known_label"), "label", F.when(F.col("__in"), "train").otherwise("test").alias("set"))


def dealt(needs: DataFrame, pool: DataFrame, key: str, n: str, item: str, seed: str) -> DataFrame:
    """Consecutive slices of the shuffled pool: each key gets its ``n`` items. Offsets are sums over the keys only."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    spans = needs.select(key, F.coalesce(F.sum(n).over(before), F.lit(0)).alias("lo"), F.col(n).alias("__n"))
    slots = spans.where("__n > 0").select(key, F.explode(F.sequence(F.col("lo") + 1, F.col("lo") + F.col("__n"))).alias("place"))
    return slots.join(numbered(pool.select(item), draw_order(seed, item), item), "place").select(key, item, "place")
