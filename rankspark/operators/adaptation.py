"""Per-key training of a last layer, all keys at once, and the reading of a memory of such layers.

The last layer has two classes, so only the difference of their weights matters: a pair's logit is the product of its
features, with a 1 at the end for the bias, and one vector a key. A step of gradient descent joins the support rows with
the table of the keys' states, sums loss and gradient by key - summed before the shuffle, so a key with very many rows is no
burden - and makes the next state. States are written every few steps, which keeps plans short and lost executors cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.operators.scoring import dot
from rankspark.sources.stored import written

# Steps without progress before a key stops, the least progress, and what keeps a clip's quotient finite.
PATIENCE, PROGRESS, TINY = 10, 1e-4, 1e-6


def with_one(vector: str | Column) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.concat(F.transform(v, lambda x: x.cast("double")), F.array(F.lit(1.0)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


STATE = ["__v", "weights", "best_loss", "losses", "__wait", "__done"]


def _stepped(state: DataFrame, support: DataFrame, key: str, width: int, number: int, rate: float, clip: float | None, patience: int, progress: float) -> DataFrame:
    """The state after one step. It is read once - its columns come along through the sums - so that plans grow by a line a step."""
    rows = support.join(state, key).withColumn("__z", dot("__x", "__v"))
    loss = F.greatest("__z", F.lit(0.0)) - F.col("__z") * F.col("__y") + F.log1p(F.exp(-F.abs("__z")))
    rows = rows.select(key, "__x", "__c", (F.col("__c") * loss).alias("__loss"), (F.col("__c") * (sigmoid(F.col("__z")) - F.col("__y"))).alias("__r"), *STATE)
    sums = rows.groupBy(key).agg(F.sum("__loss").alias("__loss"), F.sum("__c").alias("__c"), *[F.sum(F.col("__r") * F.get("__x", i)).alias(f"__g{i}") for i in range(width)], F.first(F.struct(*STATE)).alias("__s"))
    both = sums.select(key, (F.col("__loss") / F.col("__c")).alias("__loss"), F.array(*[F.col(f"__g{i}") / F.col("__c") for i in range(width)]).alias("__g"), "__s.*")
    norm = F.sqrt(2 * dot("__g", "__g"))  # the gradients of both classes are opposite
    both = both.withColumn("__coef", F.least(F.lit(1.0), F.lit(clip) / (norm + TINY)) if clip else F.lit(1.0))
    both = both.withColumn("__moved", F.zip_with("__v", "__g", lambda v, g: v - 2 * rate * F.col("__coef") * g))
    both = both.withColumn("__better", F.col("__loss") < F.col("best_loss") - (progress if number else 0.0))
    both = both.withColumn("__waited", F.when(F.col("__better"), 0).otherwise(F.col("__wait") + int(number > 0)))
    old = lambda new, c: F.when(F.col("__done"), F.col(c)).otherwise(new).alias(c)
    stop = F.col("__waited") >= patience
    return both.select(
        key,
        old(F.when(stop, F.col("__v")).otherwise(F.col("__moved")), "__v"),
        # The first loss is the best so far, with the weights that it leads to.
        old(F.when(F.col("__better"), F.col("__v") if number else F.col("__moved")).otherwise(F.col("weights")), "weights"),
        old(F.when(F.col("__better"), F.col("__loss")).otherwise(F.col("best_loss")), "best_loss"),
        old(F.array_append("losses", F.col("__loss")), "losses"),
        old(F.col("__waited"), "__wait"),
        old(stop, "__done"),
    )


def adapt(support: DataFrame, key: str, vector: str, label: str, width: int, rate: float, steps: int, initial: Sequence[float] | None = None, clip: float | None = None, class_weights: tuple[float, float] = (1.0, 1.0), patience: int = PATIENCE, progress: float = PROGRESS, every: int = 10) -> DataFrame:
    """(key, weights, best_loss, losses): each key's last layer after up to ``steps`` steps, with the best weights restored.

    ``width``: numbers in a vector; ``initial``: width + 1 numbers, zeros by default; ``losses``: the loss before each step,
    shorter where a key stopped after ``patience`` steps without ``progress``. A key whose labels or vectors are null in
    some rows is trained on the others; one without a usable row has no result.
    """
    rows = support.where(F.col(label).isNotNull() & (F.size(vector) == width)).select(key, with_one(vector).alias("__x"), F.col(label).cast("double").alias("__y"))
    rows = written(rows.withColumn("__c", F.when(F.col("__y") == 1, F.lit(float(class_weights[1]))).otherwise(F.lit(float(class_weights[0])))))
    start = F.array(*[F.lit(float(x)) for x in (initial if initial is not None else [0.0] * (width + 1))])
    none = F.array().cast("array<double>")
    state = rows.select(key).distinct().select(key, start.alias("__v"), start.alias("weights"), F.lit(float("inf")).alias("best_loss"), none.alias("losses"), F.lit(0).alias("__wait"), F.lit(False).alias("__done"))
    for number in range(steps):
        state = _stepped(state, rows, key, width + 1, number, rate, clip, patience, progress)
        if (number + 1) % every == 0:
            state = written(state)
            if state.where("NOT __done").isEmpty():
                break
    return state.select(key, "weights", "best_loss", "losses")


def adapted_scores(query: DataFrame, adapted: DataFrame, key: str, vector: str) -> DataFrame:
    """``query`` with the probability of class 1 under its key's weights."""
    return query.join(adapted.select(key, F.col("weights").alias("__w")), key).withColumn("score", sigmoid(dot(with_one(vector), "__w"))).drop("__w")


def step_losses(adapted: DataFrame, key: str) -> DataFrame:
    """(key, step, loss)."""
    return adapted.select(key, F.posexplode("losses").alias("step", "loss"))


def memory(slots: DataFrame, slot: str, address: str, weights: str) -> DataFrame:
    """One row: the addresses and the layers of all slots, in order. A memory is a model's own, of some dozen slots."""
    each = F.array_sort(F.collect_list(F.struct(F.col(slot).alias("s"), F.transform(address, lambda x: x.cast("double")).alias("a"), F.transform(weights, lambda x: x.cast("double")).alias("w"))))
    return slots.agg(each.alias("m")).select(F.transform("m", lambda s: s["a"]).alias("__addresses"), F.transform("m", lambda s: s["w"]).alias("__layers"))


def memory_scores(keys: DataFrame, pairs: DataFrame, slots: DataFrame, key: str, key_vector: str, vector: str) -> DataFrame:
    """``pairs`` with ``score``: the mean of the slots' probabilities of class 1, weighted by the key's attention to them.

    ``slots``: one row of ``memory``. The attention is the softmax of the cosine of the key's vector and each address.
    """
    small = 1e-16  # fixed value: added to both vectors

    def cosine(a: Column) -> Column:
        near = lambda v: F.transform(v, lambda x: x.cast("double") + small)
        x, y = near(F.col(key_vector)), near(a)
        return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))

    likeness = keys.crossJoin(slots.select("__addresses")).select(key, F.transform("__addresses", cosine).alias("__c"))  # one row a key
    raised = likeness.select(key, F.transform("__c", lambda c: F.exp(c - F.array_max("__c"))).alias("__e"))
    total = F.aggregate("__e", F.lit(0.0), lambda s, e: s + e)
    attention = raised.select(key, total.alias("__t"), "__e").select(key, F.transform("__e", lambda e: e / F.col("__t")).alias("__r"))
    read = pairs.join(attention, key).crossJoin(slots.select("__layers")).withColumn("__x", with_one(vector))
    each = F.zip_with("__r", "__layers", lambda r, w: r * sigmoid(dot("__x", w)))
    return read.withColumn("score", F.aggregate(each, F.lit(0.0), lambda s, x: s + x)).drop("__r", "__layers", "__x")
