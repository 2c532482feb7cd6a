"""Connected components of an undirected graph given as edges, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that can be reached, for every node of ``edges`` (columns a and b, longs).

    A round gives each node the least label around it and then the label of its label. Rounds grow with the logarithm
    of a component's width in practice; each is written to the shared folder, so a lost executor costs one round.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("near"))
        jump = nearer.select(F.col("node").alias("near"), F.col("near").alias("far"))
        moved = stored(nearer.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("new"), "label"))
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.where("new <> label").isEmpty():
            return labels
