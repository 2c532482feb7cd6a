"""Tasks and their data: applying saved indices, samplers of support and query sets, replay of saved epochs, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.operators import ranges
from rankspark.operators.pairs import negatives
from rankspark.operators.sampling import draw_order, first_k, numbered


def stem(name: str | Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"\.[^.]*$", "")


def apply_indices(records: DataFrame, rows: DataFrame, file: str, position: str) -> DataFrame:
    """The rows of each record's file at its saved positions, positives first, each list in its order.

    ``records``: original_file, sample_index, label_1_indices, label_0_indices; null lists are empty, and a position that
    the file does not have gives no row. Adds ``place`` (from 0) and the record's columns. Files meet by stem.
    """
    none = F.array().cast("array<bigint>")
    both = F.concat(F.coalesce(F.col("label_1_indices").cast("array<bigint>"), none), F.coalesce(F.col("label_0_indices").cast("array<bigint>"), none))
    wanted = records.select("original_file", "sample_index", stem("original_file").alias("__stem"), F.posexplode(both).alias("place", "__at"))
    own = rows.withColumn("__stem", stem(file)).withColumn("__at", F.col(position).cast("bigint"))
    return wanted.join(own, ["__stem", "__at"]).drop("__stem", "__at")


def enough(df: DataFrame, key: str, least: int) -> DataFrame:
    """The rows of keys that have ``least`` rows or more, repeats counted."""
    return df.join(df.groupBy(key).agg(F.count("*").alias("__c")).where(F.col("__c") >= least).select(key), key, "left_semi")


def task_sample(positives: DataFrame, pool: DataFrame, key: str, item: str, support: int, query: int, seed: str) -> DataFrame:
    """(key, role, item, label): of keys with enough positives, the first in drawing order are support, the next query."""
    fit = enough(positives.select(key, item), key, support + query)
    parts = []
    for label, rows in ((1, fit.distinct()), (0, negatives(pool, fit, key, item))):
        place = F.row_number().over(Window.partitionBy(key).orderBy(draw_order(seed, key, item), item))
        drawn = rows.select(key, item, place.alias("__place")).where(F.col("__place") <= support + query)
        parts.append(drawn.select(key, F.when(F.col("__place") <= support, "support").otherwise("query").alias("role"), item, F.lit(label).alias("label")))
    return parts[0].unionByName(parts[1])


def alternating_tasks(positives: DataFrame, background: DataFrame, reshuffled: DataFrame, key: str, item: str, support: int, query: int, epochs: int, seed: str) -> DataFrame:
    """``task_sample`` of each epoch; odd epochs draw negatives from the background, even ones from the reshuffled pool."""
    out = None
    for epoch in range(epochs):  # a few epochs; each is one branch of the plan
        one = task_sample(positives, background if epoch % 2 else reshuffled, key, item, support, query, f"{seed}{epoch}").withColumn("epoch", F.lit(epoch))
        out = one if out is None else out.unionByName(one)
    return out


def drawn_with_replacement(keys: DataFrame, pool: DataFrame, key: str, item: str, n: int, seed: str) -> DataFrame:
    """(key, draw, item): ``n`` draws a key from the whole pool, repeats allowed."""
    placed = numbered(pool.select(item).distinct(), draw_order(seed, item), item)
    size = placed.agg(F.count("*").alias("__n"))  # one row
    draws = keys.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw")).join(F.broadcast(size), F.col("__n") > 0)
    word = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    return draws.withColumn("place", word % F.col("__n") + 1).join(placed, "place").select(key, "draw", item)


def shuffled_negatives(positives: DataFrame, pool: DataFrame, key: str, item: str, seed: str) -> DataFrame:
    """Each key's pool without its positives, with the place in drawing order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(draw_order(seed, key, item), item))
    return negatives(pool, positives, key, item).select(key, item, place.cast("long").alias("place"))


def replayed(wide: DataFrame, position: str, keys: Sequence[str], support: int, query: int) -> DataFrame:
    """(key, epoch, role, label, place, item) of a saved table with a column a key and a block of rows an epoch.

    A block holds positive support, positive query, negative support, negative query. ``place`` orders an epoch's rows as
    they are used: support before query, positives first in both. A last block that is cut short is left out.
    """
    block = 2 * (support + query)
    long = wide.select(position, F.explode(F.create_map(*[x for k in keys for x in (F.lit(k), F.col(f"`{k}`").cast("string"))])).alias("key", "item"))
    at = F.col(position) % block
    role = F.when(at % (support + query) < support, "support").otherwise("query")
    label = F.when(at < support + query, 1).otherwise(0)
    inner = at % (support + query)
    place = F.when(inner < support, (1 - label) * support + inner).otherwise(support * 2 + (1 - label) * query + inner - support)
    whole = wide.agg(F.floor((F.max(position) + 1) / block).alias("__epochs"))  # one row
    out = long.withColumn("epoch", F.floor(F.col(position) / block)).join(F.broadcast(whole), F.col("epoch") < F.col("__epochs"))
    return out.select("key", F.col("epoch").cast("long").alias("epoch"), role.alias("role"), label.alias("label"), place.cast("long").alias("place"), "item")


def topped_up(support: DataFrame, candidates: DataFrame, key: str, item: str, least: int, seed: str) -> DataFrame:
    """The support with more negatives from the candidates, none twice, until each of its keys has ``least``."""
    have = support.groupBy(key).agg(F.sum((F.col("label") == 0).cast("int")).alias("__have"))
    fresh = candidates.select(key, item).distinct().join(support.select(key, item), [key, item], "left_anti").join(have, key)
    more = first_k(fresh, [key], draw_order(seed, key, item), F.lit(least) - F.col("__have"), item).select(key, item, F.lit(0).alias("label"))
    return support.select(key, item, "label").unionByName(more)


def support_slices(support: DataFrame, key: str, position: str, k: int, rounds: int) -> DataFrame:
    """Each round has a key's first ``k`` rows and the next ``k`` from an offset that moves on by ``k`` a round."""
    every = support.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    at = F.col(position)
    return every.where((at < k) | ((at >= k + F.col("round") * k) & (at < 2 * k + F.col("round") * k)))


def with_default(df: DataFrame, column: str, value) -> DataFrame:
    """``df`` itself if it has the column, else with the value everywhere."""
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def routed(df: DataFrame, label: str, unknown: str = "Unknown") -> DataFrame:
    """Adds ``role``: query where the label is unknown or null, else support. A missing ``set`` is ''."""
    value = F.col(label).cast("string")
    return with_default(df, "set", "").withColumn("role", F.when(value.isNull() | (value == unknown), "query").otherwise("support"))


def flagged(df: DataFrame, chosen: DataFrame, on: Sequence[str]) -> DataFrame:
    """Adds ``selected``: whether the row's pair is one of the chosen."""
    return df.join(chosen.select(*on).distinct().withColumn("__in", F.lit(True)), list(on), "left").withColumn("selected", F.coalesce("__in", F.lit(False))).drop("__in")


def set_lists(df: DataFrame, key: str, item: str, label: str, sets: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """For each key and set the items, in order, and their labels. A key's lists are as long as its finetune set."""
    own = F.array_sort(F.collect_list(F.struct(item, label)))
    out = df.groupBy(key).agg(*[F.filter(F.array_sort(F.collect_list(F.when(F.col("set") == s, F.struct(item, label)))), lambda x: x.isNotNull()).alias(f"__{s}") for s in sets], F.size(own).alias("n"))
    return out.select(key, "n", *[c for s in sets for c in (F.transform(f"__{s}", lambda x: x[item]).alias(f"{s}_items"), F.transform(f"__{s}", lambda x: x[label]).alias(f"{s}_labels"))])


def set_blocks(df: DataFrame, key: str, item: str, label: str, size: int) -> DataFrame:
    """``set_lists`` for pools of any length: (key, set, block, items, labels), at most ``size`` items in a row.

    Items are in order within a block and from block to block (from 0). No task holds a key's pool.
    """
    placed = ranges.numbered(ranges.in_ranges(df.select(key, "set", item, label), [key, "set"], [F.col(item), F.col(label)]), [key, "set"])
    block = F.floor((F.col("rank") - 1) / size).cast("long").alias("block")
    out = placed.groupBy(key, "set", block).agg(F.array_sort(F.collect_list(F.struct("rank", item, label))).alias("__rows"))
    return out.select(key, "set", "block", F.transform("__rows", lambda x: x[item]).alias("items"), F.transform("__rows", lambda x: x[label]).alias("labels"))


def merged_lists(parts: Sequence[DataFrame], key: str, item: str, order: str) -> DataFrame:
    """(key, items): the distinct items of all parts in the order in which they were first seen."""
    every = parts[0].select(key, item, order)
    for p in parts[1:]:
        every = every.unionByName(p.select(key, item, order))
    first = every.groupBy(key, item).agg(F.min(order).alias("__first"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", item))), lambda x: x[item]).alias("items"))


def typed_empty(df: DataFrame) -> DataFrame:
    """No row of the same columns."""
    return df.limit(0)
