"""A sink of whole files in a tree of folders: one file for each name in a column, all of them or none.

Tasks write to a staging folder; only the commit, once every task has ended, moves the files to their places, and an abort
removes the staging folder. A task that is lost and run again stages its files anew, under another name. The root is
opened as a folder by all workers, so it must be one that they share. A file's rows are one task's, in order, and stream
through it batch by batch.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.csv
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from rankspark.operators.tasks import stem

FILE = "__file"


@dataclass
class Staged(WriterCommitMessage):
    """(staged path, name below the root) of each file of a task."""

    files: list[tuple[str, str]] = field(default_factory=list)


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str, kind: str, compression: str):
        self.root, self.kind, self.compression = root.rstrip("/"), kind, compression
        self.staging = f"{self.root}/_staging-{uuid.uuid4().hex}"

    def _open(self, path: str, schema: pa.Schema):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return pa.csv.CSVWriter(path, schema) if self.kind == "csv" else pq.ParquetWriter(path, schema, compression=self.compression)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        own, out, now, sink = f"{self.staging}/{uuid.uuid4().hex}", Staged(), None, None
        try:
            for batch in iterator:
                names = batch.column(FILE).to_pylist()
                rows = batch.select([c for c in batch.schema.names if c != FILE])
                starts = [k for k, n in enumerate(names) if k == 0 or n != names[k - 1]]
                for a, b in zip(starts, [*starts[1:], len(names)], strict=True):
                    if names[a] != now:
                        if sink:
                            sink.close()
                        now = names[a]
                        if now is None or os.path.isabs(now) or ".." in now.split("/"):
                            raise ValueError(f"not a name below the root: {now}")
                        out.files.append((f"{own}/{now}", now))
                        sink = self._open(f"{own}/{now}", rows.schema)
                    sink.write(rows.slice(a, b - a))
        finally:
            if sink:
                sink.close()
        return out

    def commit(self, messages: list[Staged | None]) -> None:
        for message in messages:
            for staged, name in message.files if message else ():
                place = f"{self.root}/{name}"
                os.makedirs(os.path.dirname(place), exist_ok=True)
                os.replace(staged, place)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class TreeSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], self.options.get("kind", "csv"), self.options.get("compression", "gzip"))


def write_files(df: DataFrame, root: str, file: Column, order: Sequence[str | Column], kind: str = "csv", compression: str = "gzip") -> None:
    """Write each row to the file that ``file`` names below ``root``, rows in ``order``; files of these names are replaced."""
    df.sparkSession.dataSource.register(TreeSink)
    rows = df.withColumn(FILE, file).repartition(FILE).sortWithinPartitions(FILE, *order)
    rows.write.format("file_tree").mode("append").option("kind", kind).option("compression", compression).save(root)


def sorted_name(directory: str, file_name: str, kind: str) -> Column:
    """The mirrored place of a sorted file: its own folders, ``<stem>_sorted`` and the suffix of the kind."""
    name = F.concat(stem(file_name), F.lit(f"_sorted.{kind}"))
    return F.when(F.coalesce(directory, F.lit("")) == "", name).otherwise(F.concat(F.col(directory), F.lit("/"), name))


def sample_name(sample: str, key: str) -> Column:
    """sample_<i>/<key>.csv; separators in a key become underscores."""
    return F.concat(F.lit("sample_"), F.col(sample).cast("string"), F.lit("/"), F.regexp_replace(F.col(key).cast("string"), r"[/\\]", "_"), F.lit(".csv"))
