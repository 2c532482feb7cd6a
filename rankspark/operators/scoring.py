"""Scores: prototypes, softmax over slots, ensembles, a forest, and the interface for other models."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the two chains in each mode.
CHAIN_WEIGHTS = {"zero-shot": (0.86, 0.14), "majority": (0.59, 0.41), "few-shot": (0.0, 1.0)}


class Scorer(Protocol):
    """A model that adds a ``score`` column to pairs; networks plug in here through mapInPandas."""

    def __call__(self, pairs: DataFrame) -> DataFrame: ...


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def prototype_scores(support: DataFrame, query: DataFrame, key: str, vector: str) -> DataFrame:
    """``query`` with the dot product of each row's vector and the mean vector of its key's support."""
    each = support.select(key, F.posexplode(vector).alias("pos", "v")).groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    means = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("__mean"))
    return query.join(means, key).withColumn("score", dot(vector, "__mean")).drop("__mean")


def softmax_weights(similarities: DataFrame, group: list[str], value: str) -> DataFrame:
    """Adds ``weight``: softmax of the values of a group."""
    from pyspark.sql import Window

    own = Window.partitionBy(*group)
    e = F.exp(F.col(value) - F.max(value).over(own))
    return similarities.withColumn("__e", e).withColumn("weight", F.col("__e") / F.sum("__e").over(own)).drop("__e")


def weighted_chains(df: DataFrame, mode: str, alpha: str, beta: str) -> DataFrame:
    a, b = CHAIN_WEIGHTS[mode]
    return df.withColumn("score", F.col(alpha) * a + F.col(beta) * b)


def mean_verdict(*negative: Column, swapped: tuple[int, ...] = ()) -> tuple[Column, Column]:
    """Probability and verdict of models that give the probability of the negative class.

    Models whose place is in ``swapped`` have their classes the other way round.
    """
    negative = tuple(1 - c if k in swapped else c for k, c in enumerate(negative))
    mean = sum(negative[1:], negative[0]) / len(negative)
    return 1 - mean, F.when(mean > 0.5, "negative").otherwise("positive")


def both_chains(alpha: Column, beta: Column) -> Column:
    """Positive only if both chains' verdicts are."""
    return F.when((alpha == "positive") & (beta == "positive"), "positive").otherwise("negative")


def zipped(a: DataFrame, b: DataFrame, row: str) -> DataFrame:
    """The columns of both tables side by side, by row id."""
    return a.join(b, row)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Null where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def best_step(a: DataFrame, b: DataFrame) -> DataFrame:
    """The step with the least mean validation loss of two traces (step, val_loss)."""
    both = a.select("step", F.col("val_loss").alias("a")).join(b.select("step", F.col("val_loss").alias("b")), "step")
    return both.agg(F.min(F.struct(((F.col("a") + F.col("b")) / 2).alias("loss"), "step")).alias("m")).select(F.col("m.step").alias("step"), F.col("m.loss").alias("loss"))


class Forest:
    """A fitted random forest as a Scorer: adds ``score``, the probability of class 1. A row with a null feature scores 0."""

    def __init__(self, model, features: list[str]):
        self.model, self.features = model, features

    def __call__(self, pairs: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        whole = F.lit(True)
        for c in self.features:
            whole = whole & F.col(c).isNotNull()
        rows = pairs.withColumn("__whole", whole)
        out = self.model.transform(rows.withColumn("__features", _assembled(rows, self.features)))
        score = F.when(F.col("__whole"), vector_to_array("probability")[1]).otherwise(0.0)
        return out.withColumn("score", score).drop("__features", "__whole", "probability", "rawPrediction", "prediction")

    def save(self, path: str) -> None:
        """The model and, beside it, its features with a fingerprint."""
        self.model.write().overwrite().save(f"{path}/model")
        rows = [(k, c, _fingerprint(self.features)) for k, c in enumerate(self.features)]
        _session().createDataFrame(rows, "place int, feature string, fingerprint string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def _fingerprint(features: list[str]) -> str:
    import hashlib

    return hashlib.sha256("\n".join(features).encode()).hexdigest()


def _assembled(rows: DataFrame, features: list[str]) -> Column:
    """The features as one vector: numbers, and arrays of numbers in full; nulls are zeros."""
    from pyspark.ml.functions import array_to_vector

    kinds = dict(rows.dtypes)
    one = lambda c: F.transform(F.coalesce(c, F.array().cast(kinds[c])), lambda x: x.cast("double")) if kinds[c].startswith("array") else F.array(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return array_to_vector(F.concat(*[one(c) for c in features]))


def load_forest(path: str) -> Forest:
    """A saved forest; an error if its features were changed since."""
    from pyspark.ml.classification import RandomForestClassificationModel

    rows = sorted(_session().read.parquet(f"{path}/features").collect())
    features = [r.feature for r in rows]
    if not rows or {r.fingerprint for r in rows} != {_fingerprint(features)}:
        raise ValueError("the saved features are not those of the model")
    return Forest(RandomForestClassificationModel.load(f"{path}/model"), features)


def forest(train: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 16, seed: int = 42) -> Forest:
    """A random forest of numbers and arrays of numbers, by default with the trees and depth that cuML's documentation gives as defaults."""
    from pyspark.ml.classification import RandomForestClassifier

    rows = train.select(F.col(label).cast("double").alias(label), _assembled(train, features).alias("__features"))
    return Forest(RandomForestClassifier(featuresCol="__features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(rows), features)
