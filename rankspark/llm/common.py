"""Helpers that several operators share: text batches of bounded size, words, hashes, block counts."""

from __future__ import annotations

import ctypes
import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a helper works on at once inside a task.
BATCH_BYTES = 4 << 20

_U = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc

#: By step, what clears the memory that its workers keep from task to task.
FORGET: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """What Arrow and the allocator hold free goes back to the system; else a worker keeps its peak through all later steps."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def forget_others(step: str) -> None:
    for own, forget in FORGET.items():
        if own != step:
            forget()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], step: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a worker that serves several steps: first what other steps remember goes, at the end what is free."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(step)
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def lean_group(run: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """The same for a function of groups, which remembers nothing."""

    def held(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return run(key, table)
        finally:
            give_back()

    return held


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each (a longer single row stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def as_words(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Runs of other bytes than the six ASCII white-space bytes: row offsets and all words, in order. Null: no word."""
    text = pc.fill_null(text, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    offsets, flat = parts.offsets.to_numpy().astype(np.int64), parts.values
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    return kept[offsets], flat.filter(full)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each different word of the batch is hashed once."""
    coded = words.dictionary_encode()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), dtype=_U, count=len(coded.dictionary))
    return each[coded.indices.to_numpy()] if len(words) else np.empty(0, _U)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit mixer, element by element (wraps around)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def remainder_is(column: str, divisor: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: the hold-out rule of several operators."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor == remainder


def block_count(n_rows: int, rows_per_block: int) -> int:
    """Blocks so that each has about ``rows_per_block`` rows, however many rows there are."""
    return max(1, math.ceil(n_rows / rows_per_block))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where the session names none (as in tests), one under the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it again, which cuts its lineage.

    As with checkpoints, who owns the folder removes its files; the returned frame reads them lazily.
    """
    return stored_by(df)[0]


#: Spark's own setting: the shuffle files of a query go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_by(df: DataFrame, column: str | None = None) -> tuple[DataFrame, str]:
    """``stored``, in one folder for each value of ``column``; the path comes too, for ``dropped``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(column) if column else df.write).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a stored table, or one of its folders, that no later step reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes, k1 and k2, that name a row by its columns; neither is ever null."""
    return [F.xxhash64(F.lit(1), *columns, F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), *reversed(columns), F.lit(7)).alias("k2")]


# The split of byte-level vocabularies, and the same split in the classes of the standard library's re.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT_RE = r""" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""


class Splitter:
    """All matches of a pattern. ``SPLIT`` itself runs in re, which is faster, for texts in which the classes agree."""

    def __init__(self, pattern: str):
        self.exact = regex.compile(pattern).findall
        self.fast = self.odd = None
        if pattern == SPLIT:
            every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))  # texts with later code points take the exact way
            kinds = [(set(regex.findall(a, every)), set(re.findall(b, every))) for a, b in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))]
            differ = sorted(set().union(*(a ^ b for a, b in kinds)))
            self.fast, self.odd = re.compile(SPLIT_RE).findall, re.compile("[" + "".join(map(re.escape, differ)) + "\U00010000-\U0010ffff]").search

    def __call__(self, text: str) -> list[str]:
        return self.fast(text) if self.fast and not self.odd(text) else self.exact(text)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The class of each code point in ``SPLIT``: 1 letter, 2 number, 3 white space, 0 any other."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.zeros(len(every), np.uint8)
    for k, kind in enumerate((r"\p{L}+", r"\p{N}+", r"\s+"), 1):
        for m in regex.finditer(kind, every):
            kinds[m.start() : m.end()] = k
    return np.insert(kinds, 0xD800, np.zeros(0x800, np.uint8))


def piece_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the matches of ``SPLIT`` start in UTF-8 texts that lie one behind the other, text k from ``edges[k]``."""
    if not len(data):
        return np.empty(0, np.int64)
    kind = _kinds()[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    point = data[lead].astype(np.int64) & (0x7F >> size)
    tails = [(size > j, lead[size > j] + j) for j in (1, 2, 3)]
    for longer, at in tails:
        point[longer] = point[longer] << 6 | data[at] & 0x3F
    kind[lead] = _kinds()[point]
    for longer, at in tails:
        kind[at] = kind[lead[longer]]
    start = np.empty(len(data), bool)
    start[0], start[1:] = True, kind[1:] != kind[:-1]
    # Of white space before something else the last character stands alone, or with what follows if it is a space.
    edge = edges[edges < len(data)]
    start[edge] = False
    after = np.flatnonzero(start & (kind != 3))
    after = after[(after > 0) & (kind[after - 1] == 3)]
    last = after - 1
    start[after[data[last] == 0x20]] = False
    for _ in range(2):
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    start[edge] = True
    quote = np.flatnonzero((data == 0x27) & start)
    end = edges[np.searchsorted(edges, quote, "right")]
    one, two = (np.where(quote + j < end, data[np.minimum(quote + j, len(data) - 1)], 0) for j in (1, 2))
    length = np.where(np.isin(one, [*b"stmd"]), 2, np.where(np.isin(one, [*b"rv"]) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 3, 0))
    quote, end, length = quote[length > 0], end[length > 0], length[length > 0]
    start[quote + 1] = False
    start[(quote + length)[quote + length < end]] = True
    return np.flatnonzero(start)
