"""Draws from large pools without the product of keys and pool.

A pool is numbered once. The i-th draw of a key is the place P(i), where P is the key's own permutation of the pool's
places: a Feistel network over a grid of about the pool's size, whose few points beyond the pool are walked past. So a
key's draws cost as many rows as it draws, none repeats, and nothing has to be remembered or collected. What a key must
not get (its positives, what it has already) leaves by an anti join; as many further draws as it has such items make up
for them, up to ``attempts`` times the number wanted, so a key whose draws hit too many of them may get fewer.

Few keys may want many draws each: these are cut into blocks, which are dealt over the shuffle partitions before a row a draw
is made. A block looks the few words of its key's network up in a table where it draws more than the table has.

Where nothing is barred and a key draws a good part of its pool, its draws are not sent to the pool's places: the network
run backwards tells for each place which draw hits it, so that the key's one row goes to the pool instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.operators.sampling import draw_order, first_k
from rankspark.operators.spread import spread

ROUNDS = 4
#: Steps by which a place beyond the pool is walked on; a draw that is still beyond then counts as a failed attempt. Of a
#: grid at most one place in four is beyond the pool, of a large one nearly none.
WALKS = 16
RANGES = 4096
#: Draws of a key that one row stands for until its places are known.
BLOCK = 1 << 14
#: A key that draws this part of its pool or more is looked up from the places: so many times as many places are run
#: backwards at most, each for less than a draw costs that is shuffled.
PART_DRAWN = 1 / 4
#: Places that a key's network is made for at once, as a multiple of the grid's width; its words are four times the width.
CHUNK = 8


def grid_side(n: Column) -> Column:
    """The grid's width: the least whole number whose square is n or more."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double")))).cast("long")


def permuted(place: Column, n: Column, seed: Column, rounds: int = ROUNDS, walks: int = WALKS) -> Column:
    """The place (from 0) to which the seed's permutation of n places moves ``place``; null if it walks for too long."""
    wide = grid_side(n)
    high = F.greatest(F.lit(1), F.ceil(n / wide)).cast("long")

    def word(r: Column, half: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", seed, r.cast("string"), half.cast("string"))), 1, 8), 16, 10).cast("long")

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(F.when(even, (s["l"] + word(r, s["r"])) % wide).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise((s["r"] + word(r, s["l"])) % high).alias("r"))

    def once(x: Column) -> Column:
        start = F.struct((x % wide).cast("long").alias("l"), F.floor(x / wide).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda s: s["r"] * wide + s["l"])

    step = lambda x, k: F.when((k > 0) & (x < n), x).otherwise(once(x))
    return F.aggregate(F.sequence(F.lit(0), F.lit(walks)), place.cast("long"), step, lambda x: F.when(x < n, x))


def network_words(n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """The words of a seed's network on ``n`` places, an array for each round: about ``rounds`` times the root of n in all."""
    wide = grid_side(n)
    high = F.greatest(F.lit(1), F.ceil(n / wide)).cast("long")

    def words(r: int) -> Column:
        halves = F.sequence(F.lit(0).cast("long"), (high if r % 2 == 0 else wide) - 1)
        return F.transform(halves, lambda half: F.conv(F.substring(F.md5(F.concat_ws(":", seed, F.lit(str(r)), half.cast("string"))), 1, 8), 16, 10).cast("long"))

    return F.array(*[words(r) for r in range(rounds)])


def permuted_block(first: Column, last: Column, n: Column, seed: Column, words: Column, rounds: int = ROUNDS) -> Column:
    """The array of ``permuted`` of the places ``first`` to ``last``, by the ``network_words`` of the same seed and n."""
    wide = grid_side(n)
    high = F.greatest(F.lit(1), F.ceil(n / wide)).cast("long")

    def once(x: Column) -> Column:
        l, r = (x % wide).cast("long"), F.floor(x / wide).cast("long")
        for k in range(rounds):
            if k % 2 == 0:
                l = (l + F.get(F.get(words, F.lit(k)), r)) % wide
            else:
                r = (r + F.get(F.get(words, F.lit(k)), l)) % high
        return r * wide + l

    def walked(x: Column) -> Column:
        """A place beyond the pool is walked on; nearly all are not."""
        steps = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), x, lambda y, _: F.when(y < n, y).otherwise(once(y)))
        return F.when(x < n, x).otherwise(F.transform(F.array(steps), lambda y: F.when(y < n, y))[0])

    return F.transform(F.transform(F.sequence(first, last), once), walked)


def unpermuted(place: Column, n: Column, words: Column, rounds: int = ROUNDS, walks: int = WALKS) -> Column:
    """The place that ``permuted`` moves to ``place``, by the ``network_words``; null if it walks for too long."""
    wide = grid_side(n)
    high = F.greatest(F.lit(1), F.ceil(n / wide)).cast("long")

    def back(y: Column) -> Column:
        l, r = (y % wide).cast("long"), F.floor(y / wide).cast("long")
        for k in reversed(range(rounds)):
            if k % 2 == 0:
                l = F.pmod(l - F.get(F.get(words, F.lit(k)), r), wide)
            else:
                r = F.pmod(r - F.get(F.get(words, F.lit(k)), l), high)
        return r * wide + l

    first = back(place)
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, lambda x, _: F.when(x < n, x).otherwise(back(x)))
    return F.when(first < n, first).otherwise(F.transform(F.array(steps), lambda x: F.when(x < n, x))[0])


def numbered_pools(pools: DataFrame, pool: str, item: str, seed: str) -> DataFrame:
    """(pool, item, place, __n) of the different items of each pool, places from 0 in drawing order.

    The numbers start anew in each of 4096 ranges of the drawing order, and the sizes of the ranges before are added, so no
    task holds a whole pool.
    """
    cut = pools.select(pool, item).distinct().withColumn("__order", draw_order(seed, item))
    cut = cut.withColumn("__range", F.floor(F.conv(F.substring("__order", 1, 6), 16, 10).cast("long") * RANGES / (1 << 24)))
    own = F.row_number().over(Window.partitionBy(pool, "__range").orderBy("__order", item))
    before = Window.partitionBy(pool).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(pool, "__range").agg(F.count("*").alias("__rows"))
    starts = sizes.select(pool, "__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), F.sum("__rows").over(Window.partitionBy(pool)).alias("__n"))
    return cut.withColumn("__own", own).join(starts, [pool, "__range"]).select(pool, item, (F.col("__before") + F.col("__own") - 1).cast("long").alias("place"), F.col("__n").cast("long").alias("__n"))


def _open(wants: DataFrame, places: DataFrame) -> DataFrame:
    """``wants`` with the size of their pool, which has a place at least, and no more tries than that."""
    sizes = places.groupBy("pool").agg(F.max("__n").alias("__n"))
    return wants.join(sizes, "pool").withColumn("__tries", F.least("__tries", "__n").cast("long")).where("__tries > 0")


def _name(keys: Sequence[str], seed: str) -> Column:
    return F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys])


def tried(wants: DataFrame, pools: DataFrame, keys: Sequence[str], item: str, seed: str) -> DataFrame:
    """(keys, item, __k, __try): the items that a key's first ``__tries`` draws, or as many as the pool has, hit.

    ``wants``: the key columns, ``pool``, ``__k`` and ``__tries``.
    """
    places = numbered_pools(pools, "pool", item, seed)
    return _by_draws(_open(wants, places), places, keys, item, seed)


def _by_draws(open_: DataFrame, places: DataFrame, keys: Sequence[str], item: str, seed: str) -> DataFrame:
    """``tried`` of open wants: a row a draw is made and joined with the numbered places."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__tries") - 1, F.lit(BLOCK).cast("long"))).alias("__first")
    blocks = spread(open_.select(*keys, "pool", "__k", "__n", "__tries", starts), *keys, "__first")
    last = F.least(F.col("__first") + BLOCK, "__tries") - 1
    n, many = F.col("__n"), last - F.col("__first") >= grid_side(F.col("__n"))
    worded = blocks.withColumn("__name", _name(keys, seed)).withColumn("__last", last).withColumn("__words", F.when(many, network_words(n, F.col("__name"))))
    few = F.transform(F.sequence("__first", "__last"), lambda x: permuted(x, n, F.col("__name")))
    block = F.when(F.col("__words").isNull(), few).otherwise(permuted_block(F.col("__first"), F.col("__last"), n, F.col("__name"), F.col("__words")))
    placed = worded.withColumn("__places", block).select(*keys, "pool", "__k", "__first", F.posexplode_outer("__places").alias("__at", "place")).where("place IS NOT NULL")  # outer: no filter that would make the places twice
    return placed.join(places.drop("__n"), ["pool", "place"]).select(*keys, item, "__k", (F.col("__first") + F.col("__at")).alias("__try"))


def _by_places(open_: DataFrame, places: DataFrame, keys: Sequence[str], item: str, seed: str) -> DataFrame:
    """(keys, item) of open wants: each place is looked up in the tries of all keys that draw from its pool.

    A key has a row for each chunk of its pool's places, so that a large pool is dealt over many tasks.
    """
    chunk = CHUNK * grid_side(F.col("__n"))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / chunk))).alias("__chunk")
    dealt = spread(open_.select(*keys, "pool", "__n", "__tries", chunks), "pool", "__chunk")
    worded = dealt.withColumn("__words", network_words(F.col("__n"), _name(keys, seed)))
    own = places.select("pool", F.floor(F.col("place") / chunk).alias("__chunk"), "place", item)
    # No broadcast: Spark takes the words for as small as the rows that they are made of.
    return own.join(worded.hint("merge"), ["pool", "__chunk"]).where(unpermuted(F.col("place"), F.col("__n"), F.col("__words")) < F.col("__tries")).select(*keys, item)


def drawn(wants: DataFrame, pools: DataFrame, barred: DataFrame, keys: Sequence[str], item: str, seed: str, attempts: int = 10, by: str | None = None) -> DataFrame:
    """(keys, item, draw): for each row of ``wants`` up to ``__k`` different items of its pool that are not barred.

    ``wants``: the key columns, ``pool`` and ``__k``, one row a combination of keys; ``pools``: pool, item; ``barred``:
    ``by`` - one of the keys, by default the first - and item. ``draw`` counts from 1 in the order of the draws.
    """
    by = by or keys[0]
    barred = barred.select(by, item).distinct()
    each = barred.groupBy(by).agg(F.count("*").alias("__barred"))
    tries = F.least(F.col("__k") * attempts, F.col("__k") + F.coalesce("__barred", F.lit(0)))
    found = tried(wants.select(*keys, "pool", "__k").join(each, by, "left").withColumn("__tries", tries), pools, keys, item, seed)
    fresh = found.join(barred, [by, item], "left_anti")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("__try"))
    return fresh.withColumn("draw", nth).where(F.col("draw") <= F.col("__k")).select(*keys, item, "draw")


def drawn_freely(wants: DataFrame, pools: DataFrame, keys: Sequence[str], item: str, seed: str) -> DataFrame:
    """(keys, item): ``drawn`` where nothing is barred, so that every try counts and none needs a number."""
    places = numbered_pools(pools, "pool", item, seed)
    open_ = _open(wants.select(*keys, "pool", "__k", F.col("__k").alias("__tries")), places)
    much = F.col("__tries") >= F.col("__n") * PART_DRAWN
    return _by_draws(open_.where(~much), places, keys, item, seed).select(*keys, item).unionByName(_by_places(open_.where(much), places, keys, item, seed))


def _one_pool(pool: DataFrame, item: str) -> DataFrame:
    return pool.select(F.lit("").alias("pool"), item)


def drawn_support(positives: DataFrame, pool: DataFrame, key: str, item: str, k: int, seed: str, negatives: int | None = None, attempts: int = 10) -> DataFrame:
    """(key, item, label): k positives of each key in drawing order and ``negatives`` (k if none is said) draws from the pool."""
    own = positives.select(key, item).distinct()
    yes = first_k(own, [key], draw_order(seed, key, item), k, item).withColumn("label", F.lit(1))
    wants = own.select(key).distinct().select(key, F.lit("").alias("pool"), F.lit(k if negatives is None else negatives).alias("__k"))
    return yes.unionByName(drawn(wants, _one_pool(pool, item), own, [key], item, seed, attempts, key).select(key, item, F.lit(0).alias("label")))


def drawn_rounds(positives: DataFrame, background: DataFrame, reshuffled: DataFrame, key: str, item: str, k: int, rounds: int, seed: str, attempts: int = 10) -> DataFrame:
    """(key, round, item, label, source): shared positives; even rounds draw from the background, odd ones elsewhere."""
    own = positives.select(key, item).distinct()
    number = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")
    yes = first_k(own, [key], draw_order(seed, key, item), k, item).select(key, number, item, F.lit(1).alias("label"), F.lit("positive").alias("source"))
    source = F.when(F.col("round") % 2 == 0, "background").otherwise("reshuffling")
    wants = own.select(key).distinct().select(key, number).withColumn("pool", source).withColumn("__k", F.lit(k))
    pools = background.select(F.lit("background").alias("pool"), item).unionByName(reshuffled.select(F.lit("reshuffling").alias("pool"), item))
    no = drawn(wants, pools, own, [key, "round"], item, seed, attempts, key)
    return yes.unionByName(no.select(key, "round", item, F.lit(0).alias("label"), source.alias("source")))


def drawn_tasks(positives: DataFrame, pools: DataFrame, key: str, item: str, support: int, query: int, epochs: DataFrame, seed: str, attempts: int = 10) -> DataFrame:
    """(key, epoch, role, item, label): a task of each epoch for every key with enough positives, in one plan.

    ``epochs``: epoch and the ``pool`` it draws negatives from, a few rows; ``pools``: pool, item. Each epoch also draws the
    positives anew; the first ``support`` of both labels are the support set, the next ``query`` the query set.
    """
    size = support + query
    counts = positives.groupBy(key).agg(F.count("*").alias("__c")).where(F.col("__c") >= size).select(key)
    own = positives.select(key, item).distinct().join(counts, key, "left_semi")
    tasks = counts.crossJoin(F.broadcast(epochs.select("epoch", "pool"))).withColumn("__k", F.lit(size))  # one row a task
    # A key's positives are a pool of their own, of which nothing is barred.
    named = own.select(F.col(key).cast("string").alias("pool"), item)
    yes = drawn(tasks.withColumn("pool", F.col(key).cast("string")), named, own.limit(0), [key, "epoch"], item, f"{seed}+", attempts, key).withColumn("label", F.lit(1))
    no = drawn(tasks, pools, own, [key, "epoch"], item, seed, attempts, key).withColumn("label", F.lit(0))
    return yes.unionByName(no).select(key, "epoch", F.when(F.col("draw") <= support, "support").otherwise("query").alias("role"), item, "label")


def drawn_top_up(support: DataFrame, pool: DataFrame, positives: DataFrame, key: str, item: str, least: int, seed: str, attempts: int = 10) -> DataFrame:
    """The support with further draws of negatives, none twice, until each of its keys has ``least``."""
    have = support.groupBy(key).agg(F.sum((F.col("label") == 0).cast("int")).alias("__have"))
    wants = have.select(key, F.lit("").alias("pool"), (F.lit(least) - F.col("__have")).alias("__k")).where("__k > 0")
    barred = support.select(key, item).unionByName(positives.select(key, item))
    more = drawn(wants, _one_pool(pool, item), barred, [key], item, seed, attempts, key).select(key, item, F.lit(0).alias("label"))
    return support.select(key, item, "label").unionByName(more)


def drawn_ratio(positives: DataFrame, pool: DataFrame, key: str, item: str, ratio: float, seed: str, attempts: int = 10) -> DataFrame:
    """(key, item, label): all positives and ``ratio`` times as many negatives of each key, rounded down."""
    own = positives.select(key, item).distinct()
    wants = own.groupBy(key).agg(F.floor(F.count("*") * ratio).cast("long").alias("__k")).select(key, F.lit("").alias("pool"), "__k")
    no = drawn(wants, _one_pool(pool, item), own, [key], item, seed, attempts, key)
    return own.withColumn("label", F.lit(1)).unionByName(no.select(key, item, F.lit(0).alias("label")))


def drawn_slices(positives: DataFrame, pool: DataFrame, key: str, item: str, fixed: int, random: int, rounds: int, seed: str, attempts: int = 10) -> DataFrame:
    """(key, round, item, place): the key's first ``fixed`` draws in every round, then ``random`` more of the round's own.

    All of a key's draws are one sequence, so a round's own are never the fixed ones, nor another round's.
    """
    own = positives.select(key, item).distinct()
    wants = own.select(key).distinct().select(key, F.lit("").alias("pool"), F.lit(fixed + random * rounds).alias("__k"))
    no = drawn(wants, _one_pool(pool, item), own, [key], item, seed, attempts, key)
    number = F.when(F.col("draw") <= fixed, F.sequence(F.lit(0), F.lit(rounds - 1))).otherwise(F.array(F.floor((F.col("draw") - fixed - 1) / random).cast("int")))
    out = no.select(key, item, "draw", F.explode(number).alias("round"))
    return out.select(key, "round", item, F.when(F.col("draw") <= fixed, F.col("draw")).otherwise(fixed + 1 + (F.col("draw") - fixed - 1) % random).cast("int").alias("place"))


def drawn_balanced(df: DataFrame, group: str, label: str, item: str, samples: int, seed: str, most: int = 1000) -> DataFrame:
    """(group, sample, item, label): equal numbers of both labels in each sample; without a positive at most ``most`` negatives.

    Only what is drawn is copied for the samples: each group and label is a pool of its own.
    """
    rows = df.select(group, item, F.col(label).cast("int").alias(label)).distinct()
    pool = F.concat(F.col(group).cast("string"), F.lit(":"), F.col(label).cast("string"))
    sizes = rows.groupBy(group).agg(F.sum(label).alias("__p"), F.sum(1 - F.col(label)).alias("__q"))
    k = F.when(F.col("__p") == 0, F.least("__q", F.lit(most))).when(F.col("__q") == 0, F.col("__p")).otherwise(F.least("__p", "__q"))
    number = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")
    wants = sizes.select(group, k.alias("__k"), number).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias(label)).withColumn("pool", pool)
    return drawn_freely(wants, rows.select(pool.alias("pool"), item), [group, "sample", label], item, seed).select(group, "sample", item, label)


def drawn_shuffled(df: DataFrame, allowed: DataFrame, group: str, label: str, item: str, samples: int, seed: str, most: int = 10_000) -> DataFrame:
    """All positives in each sample and as many draws from the group's allowed negatives (``most`` without positives)."""
    positives = df.where(F.col(label) == 1).select(group, item).distinct()
    fit = df.where(F.col(label) == 0).select(group, item).join(allowed.select(item).distinct(), item, "left_semi").join(positives, [group, item], "left_anti")
    number = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")
    counts = positives.groupBy(group).agg(F.count("*").alias("__p"))
    pool = F.col(group).cast("string").alias("pool")
    wants = fit.select(group).distinct().join(counts, group, "left").select(group, F.coalesce("__p", F.lit(most)).alias("__k"), pool, number)
    no = drawn_freely(wants, fit.select(pool, item), [group, "sample"], item, seed)
    return positives.select(group, number, item, F.lit(1).alias(label)).unionByName(no.select(group, "sample", item, F.lit(0).alias(label)))
