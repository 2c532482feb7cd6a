"""Cleaning of sequences, candidate pairs of keys and items, labels by existence, output layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the residues of a valid sequence.
ALPHABET = "ARNDCQEGHILKMFPSTWYV"


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def clean_sequence(c: str | Column, strict: bool = False) -> Column:
    """Trimmed and upper-cased, or null if it has other letters; ``strict`` takes it as it is."""
    c = F.col(c) if isinstance(c, str) else c
    c = c if strict else F.upper(stripped(c))
    return F.when(c.rlike(rf"\A[{ALPHABET}]+\z"), c)


def resolve_column(df: DataFrame, names: Sequence[str], fallback: int) -> str:
    """The first column with one of the names (any case, outer blanks ignored), or the one at ``fallback``."""
    own = {c.strip().lower(): c for c in df.columns}
    return next((own[n.lower()] for n in names if n.lower() in own), df.columns[fallback])


def valid_pairs(df: DataFrame, item: str, key: str, other: str | None = None) -> DataFrame:
    """Rows whose item and key are valid; an invalid ``other`` becomes UNK."""
    out = df.withColumn(item, clean_sequence(item)).withColumn(key, clean_sequence(key)).dropna(subset=[item, key])
    return out.withColumn(other, F.coalesce(clean_sequence(other), F.lit("UNK"))) if other else out


def candidate_pairs(keys: DataFrame, pool: DataFrame, positives: DataFrame, key: str, item: str) -> DataFrame:
    """Every key with the whole pool and its own positives, labelled 1 where the pair is a positive.

    The product of keys and pool is the result itself: both sides are distinct, so it needs no shuffle of its own.
    Labels come from an equi-join on the pair, which Spark broadcasts while the positives are small; positives whose item
    the pool lacks are added.
    """
    known, own, items = positives.select(key, item).distinct(), keys.select(key).distinct(), pool.select(item).distinct()
    grid = own.crossJoin(items).join(known.withColumn("label", F.lit(1)), [key, item], "left").fillna(0, ["label"])
    return grid.unionByName(known.join(own, key, "left_semi").join(items, item, "left_anti").select(key, item, F.lit(1).alias("label")))


def negatives(pool: DataFrame, positives: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item): for each key the distinct pool without its positives."""
    return positives.select(key).distinct().crossJoin(pool.select(item).distinct()).join(positives.select(key, item), [key, item], "left_anti")


def without_support(ranking: DataFrame, support: DataFrame, key: str, item: str) -> DataFrame:
    """The ranking rows that are not in the support, labels and repeats kept."""
    return ranking.join(support.select(key, item).distinct(), [key, item], "left_anti")


def layout(pairs: DataFrame, key: str, item: str, kind: str) -> DataFrame:
    """Columns of a target: a (tcr, peptide, label), b (two chain columns) or c (gene columns, blank)."""
    k, i, n = F.col(key).alias("peptide"), F.col(item).alias("tcr"), F.col("label")
    blank = lambda *names: [F.lit("").alias(x) for x in names]
    if kind == "a":
        return pairs.select(i, k, n)
    if kind == "b":
        return pairs.select(F.lit("").alias("TCRA_CDR3"), i.alias("TCRB_CDR3"), k.alias("Epitope"), n)
    return pairs.select(*blank("TRA"), i.alias("TRB"), *blank("TRAV", "TRAJ", "TRBV", "TRBJ", "T_Cell_Type"), k.alias("Peptide"), *blank("MHC"), n)


def first_occurrence(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Distinct keys with the place at which each was first seen."""
    return df.groupBy(*key).agg(F.min(order).alias("first"))
