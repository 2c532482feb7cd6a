"""Features of pairs: looked-up encodings with a computed fallback, pair features, one-hot and table encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions.encode import FACTORS, encoded

PAD = "X"


def with_encoding(df: DataFrame, dictionary: DataFrame, sequence: str, length: int) -> DataFrame:
    """Adds ``encoding`` and ``hit``: the dictionary's (sequence, encoding) where it has the sequence, else computed.

    A dictionary with repeated sequences gives its smallest encoding. Spark picks the join by the dictionary's size.
    """
    # The hit is a column of its own, so that whoever reads it alone moves no encodings.
    known = dictionary.groupBy(sequence).agg(F.min("encoding").alias("__known"), F.max(F.col("encoding").isNotNull()).alias("__hit"))
    out = df.join(known, sequence, "left")
    return out.withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit").withColumn("encoding", F.coalesce("__known", encoded(sequence, length))).drop("__known")


def hit_ratio(looked_up: DataFrame) -> DataFrame:
    """One row: n, hits and their share (null without rows)."""
    return looked_up.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("hit").cast("int")), F.lit(0)).alias("hits"), F.avg(F.col("hit").cast("double")).alias("hit_ratio"))


def missing_keys(df: DataFrame, dictionary: DataFrame, sequence: str, most: int = 10) -> DataFrame:
    """The first ``most`` sequences, in order, that the dictionary lacks."""
    return df.select(sequence).distinct().join(dictionary, sequence, "left_anti").orderBy(sequence).limit(most)


def pair_feature(key: str, item: str, key_length: int = 15, item_length: int = 25) -> Column:
    """The key's encoding followed by the item's: 200 numbers by default."""
    return F.concat(encoded(key, key_length), encoded(item, item_length))


def task_embedding(support: DataFrame, query: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item, role, feature) of a task's support and query; a null item is a placeholder without a feature."""
    both = support.select(key, item, F.lit("support").alias("role")).unionByName(query.select(key, item, F.lit("query").alias("role")))
    return both.withColumn("feature", F.when(F.col(item).isNotNull(), pair_feature(key, item)))


def fixed_width(sequence: Column, width: int = 29) -> Column:
    """Cut to the first ``width`` residues, or padded with X on the left."""
    return F.lpad(sequence, width, PAD)


def _rows(sequence: Column, table: Mapping[str, Sequence[float]], width: int) -> Column:
    size = len(next(iter(table.values())))
    known = F.create_map(*[x for a, v in table.items() for x in (F.lit(a), F.array(*[F.lit(float(y)) for y in v]))])
    none = F.array_repeat(F.lit(0.0), size)
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.element_at(known, F.substring(sequence, i, F.lit(1))), none)))


def with_products(table: Mapping[str, Sequence[float]]) -> dict[str, list[float]]:
    """Each residue's numbers and the products of any two of them: five numbers become twenty."""
    return {a: [*v, *(float(x * y) for i, x in enumerate(v) for y in v[i:])] for a, v in table.items()}


def onehot_chemical(item: str, key: str, chemistry: Mapping[str, Sequence[float]], width: int = 29) -> Column:
    """58 rows of 20 numbers: 29 one-hot rows of the joined pair, then its 29 rows of a chemistry table.

    ``chemistry``: twenty numbers for each residue, a table that the user brings (or ``with_products`` of the five factors).
    Unknown residues and the filling are zeros.
    """
    order = sorted(FACTORS)
    if any(len(v) != len(order) for v in chemistry.values()):
        raise ValueError(f"a residue needs {len(order)} numbers")
    onehot = {a: [float(k == j) for j in range(len(order))] for k, a in enumerate(order)}
    pair = fixed_width(F.concat(F.col(item), F.col(key)), width)
    return F.concat(_rows(pair, onehot, width), _rows(pair, chemistry, width))


def padded_rows(sequence: str, table: Mapping[str, Sequence[float]], length: int = 20) -> Column:
    """``length`` rows of a table's numbers (principal components, say) and a flag, 1 where the sequence has ended."""
    size = len(next(iter(table.values())))
    known = F.create_map(*[x for a, v in table.items() for x in (F.lit(a), F.array(*[F.lit(float(y)) for y in v]))])
    none = F.array_repeat(F.lit(0.0), size)
    s = F.col(sequence)
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.concat(F.coalesce(F.element_at(known, F.substring(s, i, F.lit(1))), none), F.array(F.when(i > F.length(s), 1.0).otherwise(0.0)))))


def chain_features(df: DataFrame, kind: str, alpha: str, beta: str, key: str, table: Mapping[str, Sequence[float]], length: int = 20) -> DataFrame:
    """The rows with the features of the chains that ``kind`` (A, B or AB) names and an error code.

    ``error``: 0, or 1 (A), 2 (B), 3 (AB) where a chain that is asked for, or the key, is missing; such rows have no features.
    """
    if kind not in ("A", "B", "AB"):
        raise ValueError(f"unknown kind: {kind}")
    chains = [c for c, name in ((alpha, "A"), (beta, "B")) if name in kind]
    whole = F.col(key).isNotNull()
    for c in chains:
        whole = whole & F.col(c).isNotNull()
    out = df.withColumn("error", F.when(whole, 0).otherwise({"A": 1, "B": 2, "AB": 3}[kind]))
    for c in chains:
        out = out.withColumn(f"{c}_features", F.when(whole, F.concat(padded_rows(c, table, length), padded_rows(key, table, length))))
    return out
