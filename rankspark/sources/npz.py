"""A data source for encoding dictionaries in archives of arrays: spark.read.format("npz").load(path).

Each member of the archive is a row (name, shape, encoding: its numbers in order). The driver reads only the archive's
directory; tasks read members of about equal bytes, and only plain numbers: pickled members are an error. The path is
opened as a file by every worker, so it must be a folder that all of them see.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of members that one task reads.
TASK_BYTES = 64 << 20


class Members(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class NpzReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes = path, task_bytes

    def partitions(self) -> list[Members]:
        out, size = [[]], 0
        with zipfile.ZipFile(self.path) as z:
            for info in z.infolist():
                if info.filename.endswith(".npy"):
                    if out[-1] and size + info.file_size > self.task_bytes:
                        out.append([])
                        size = 0
                    out[-1].append(info.filename)
                    size += info.file_size
        return [Members(names) for names in out]

    def read(self, partition: Members) -> Iterator[tuple[str, list[int], list[float]]]:
        with zipfile.ZipFile(self.path) as z:
            for name in partition.names:
                with z.open(name) as f:
                    array = np.lib.format.read_array(f, allow_pickle=False)
                yield name.removesuffix(".npy"), list(array.shape), array.astype(np.float64).ravel().tolist()


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "name string, shape array<int>, encoding array<double>"

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options["path"], int(self.options.get("taskBytes", TASK_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzSource)
