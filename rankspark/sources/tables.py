"""Readers and writers: recursive folders, text lists, mirrored trees, skipping what is done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.operators.pairs import stripped
from rankspark.operators.spread import spread

SUFFIXES = {"parquet": "*.{parquet,par}", "csv": "*.csv"}


def _read(spark: SparkSession, root: str, kind: str, schema: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", SUFFIXES[kind])
    reader = reader.schema(schema) if schema else reader
    return reader.option("header", True).csv(root) if kind == "csv" else reader.parquet(root)


def load_folder(spark: SparkSession, root: str, kind: str = "any", schema: str | None = None, skip: str | None = "k_shot", directory: str | None = None) -> DataFrame:
    """All files of a kind below ``root`` with their directory (relative to ``root``) and file name.

    ``kind``: csv, parquet (.par too) or any, which needs a schema as it takes both. Names that contain ``skip`` are left
    out. With ``directory`` only files below that folder are listed at all.
    """
    if kind not in (*SUFFIXES, "any"):
        raise ValueError(f"unsupported format: {kind}")
    if kind == "any" and not schema:
        raise ValueError("files of both formats need a schema")
    below = root.rstrip("/") + (f"/{directory.strip('/')}" if directory else "")
    parts = []
    for k in SUFFIXES if kind == "any" else [kind]:
        df = _read(spark, below, k, schema)
        path = F.col("_metadata.file_path")
        parts.append(df.select("*", path.alias("__path"), F.col("_metadata.file_name").alias("file_name")))
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    base = F.regexp_replace(F.lit(root), "^[a-z0-9]+:/+|^/+|/+$", "")
    # Plain text functions, as they run on each row: the path without its scheme, then without the file's name.
    path = F.ltrim(F.substr("__path", F.instr("__path", ":/") + 1), F.lit("/"))
    inner = F.substr(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)
    df = df.withColumn("directory", F.ltrim(F.substr(inner, F.instr(inner, base) + F.length(base)), F.lit("/"))).drop("__path")
    return df.where(~F.col("file_name").contains(skip)) if skip else df


def load_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One file or folder by its suffix."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end == "csv":
        reader = spark.read.option("header", True)
        return normal_names((reader.schema(schema) if schema else reader).csv(path))
    if end in ("parquet", "par"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format: {path}")


def load_plain_table(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """A csv file by position, for files without a header; columns beyond the names are left out."""
    df = spark.read.option("header", False).csv(path)
    return df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, names, strict=False)])


def data_directories(files: DataFrame) -> DataFrame:
    """The directories of ``load_folder``'s rows, sorted."""
    return files.select("directory").distinct().orderBy("directory")


def first_level(files: DataFrame) -> DataFrame:
    """Adds ``top``, the first part of the directory; rows of files directly in the root are left out."""
    return files.withColumn("top", F.substring_index("directory", "/", 1)).where(F.col("top") != "")


def file_names(files: DataFrame) -> DataFrame:
    """One quoted file name a row, sorted, for export."""
    return files.select("file_name").distinct().orderBy("file_name").select(F.concat(F.lit("'"), "file_name", F.lit("'")).alias("value"))


def write_both(df: DataFrame, path: str) -> None:
    """The same rows as csv and as parquet, in two folders of one path; the source is computed once."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(f"{path}.parquet")
    df.sparkSession.read.schema(df.schema).parquet(f"{path}.parquet").write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def load_list(spark: SparkSession, path: str, name: str = "tcr") -> DataFrame:
    """Lines of a text file, stripped of white space and a byte-order mark, blank ones left out."""
    return spark.read.text(path).select(stripped(F.regexp_replace("value", "^\ufeff", "")).alias(name)).where(F.col(name) != "")


def normal_names(df: DataFrame) -> DataFrame:
    """Column names without outer blanks or a byte-order mark."""
    return df.toDF(*[c.strip().lstrip("﻿").strip() for c in df.columns])


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    own = {c.lower() for c in df.columns}
    if missing := [c for c in columns if c.lower() not in own]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def write_tree(df: DataFrame, path: str, by: Sequence[str], order: Sequence[str], kind: str = "parquet", compression: str = "gzip") -> None:
    """One folder for each value of ``by``, rows ordered inside each file; a task writes few of them."""
    rows = spread(df, *by).sortWithinPartitions(*by, *order)
    rows.write.mode("overwrite").partitionBy(*by).option("compression", compression).option("header", True).format(kind).save(path)


def not_done(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has no output yet."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")
