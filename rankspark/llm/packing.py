"""Bounded-space online best-fit packing of tokenized documents into sequences (operator 7).

Each task tokenizes its documents and packs their pieces in the order in which they come, with a fixed number of open
bins, so nothing is shuffled and a task holds no more than its open bins. A bitset has bit ``f`` set when some open bin has
``f`` free places, so the best fit for a piece of length ``n`` is the lowest set bit at or above ``n`` (of equal bins the
one filled last). When nothing fits and all bins are open, the fullest (lowest set bit) closes first. Full pieces are
sequences of their own.

The pieces of bins that the tasks leave with more than a little room are packed once more by the same method, those of
some tasks together, the longest first, with more open bins. Only numbers are moved then, one row a piece of such a bin.

Defined results: null text is the empty text and gives one piece (the end id alone); a document of more than ``capacity``
ids is cut so that only its first piece may be shorter; null and repeated ids are packed as separate rows; no row gives no
piece; other columns are left out. Where tables are read in other splits, documents may get other sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import FORGET, SPLIT, Splitter, lean, piece_starts, slices, stored

#: Bins that are open at the same time.
OPEN_BINS = 32
#: Tasks whose pieces are packed by one task of the second pass, the share of a bin that is left empty in peace, and the
#: bins that are open at the same time there.
TASKS, ROOM, AGAIN = 64, 1 / 256, 4096
#: Bits of a sequence's id below the number of its task.
TASK_BITS = 40
#: Different pieces of text that a worker remembers until it runs another step (``lean``); beyond it, it forgets all but those
#: of the texts at hand and those that it has met again since they were learned.
REMEMBERED = 250_000


class OpenBins:
    """A fixed number of open bins in a bitset keyed by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free_bits, self.open, self.at, self.next_id = 0, 0, {}, 0

    def _take(self, free: int) -> int:
        stack = self.at[free]
        bin_id = stack.pop()
        if not stack:
            self.free_bits &= ~(1 << free)
        return bin_id

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of 1 to ``capacity`` ids."""
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
                self.open -= 1
            bin_id, free = self.next_id, self.capacity
            self.next_id += 1
            self.open += 1
        left = free - length
        if left:
            self.at.setdefault(left, []).append(bin_id)
            self.free_bits |= 1 << left
        else:
            self.open -= 1
        return bin_id, self.capacity - free


class CachedTokenizer:
    """Ids by the tokenizers library; each different piece of the byte-level split is given to it once per worker."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split, self.known, self.again = None if pattern == SPLIT else Splitter(pattern), {}, set()
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)).search if added else lambda _: None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)  # one character stands for one byte

    def _learn(self, pieces: list[str]) -> None:
        # A run of " word" pieces splits back into these pieces, so a joined text costs one call.
        plain = [p for p in pieces if p[0] == " " and p[1:].isalpha()]
        for a in range(0, len(plain), 1000):
            part = plain[a : a + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(pc.binary_length(pa.array(part)).to_numpy())
            cuts = (4 * (np.searchsorted(np.cumsum(self.size[ids]), ends) + 1)).tolist()
            raw = ids.tobytes()
            self.known.update(zip(part, [raw[x:y] for x, y in zip([0, *cuts], cuts, strict=False)], strict=True))
        rest = [p for p in pieces if p not in self.known]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else [], strict=True):
            self.known[p] = np.array(e.ids, "<u4").tobytes()

    def _pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different pieces, the number of each piece among them, and the first piece of each text (and the end)."""
        if self.split:
            split = [self.split(t) for t in texts]
            coded = pa.array([p for s in split for p in s], pa.large_string()).dictionary_encode()
            return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.cumsum([0, *map(len, split)])
        column = pa.array(texts, pa.large_string())
        _, offsets, data = column.buffers()
        edges = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
        starts = piece_starts(np.frombuffer(data or b"", np.uint8)[: edges[-1]], edges)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, edges[-1])), data).dictionary_encode()
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.searchsorted(starts, edges)

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, as the library gives them for the whole text.

        The library looks for added tokens before it splits, so a text that holds the string of one is given to it whole.
        """
        whole = {k: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for k, t in enumerate(texts) if self.special(t)}
        here, index, edges = self._pieces(["" if k in whole else t for k, t in enumerate(texts)])
        each = list(map(self.known.get, here))
        full = len(self.known) > REMEMBERED
        if full and len(self.again) > REMEMBERED * 9 // 10:
            self.again.clear()
        self.again.update(p for p, ids in zip(here, each, strict=True) if ids is not None)
        if full:
            self.known = {p: ids for p, ids in self.known.items() if p in self.again}
        new = [k for k, ids in enumerate(each) if ids is None]
        self._learn([here[k] for k in new])
        for k in new:
            each[k] = self.known[here[k]]
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        first = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(each), "<u4")

        def of(own: np.ndarray) -> bytes:
            n = size[own]
            ends = np.cumsum(n)
            return ids[np.repeat(first[own] - ends + n, n) + np.arange(n.sum())].tobytes()

        return [whole[k] if k in whole else of(index[a:b]) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str) -> CachedTokenizer:
    return CachedTokenizer(path, pattern)


FORGET["packing"] = _tokenizer.cache_clear


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all of ``capacity`` but the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pack_in_tasks(df: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first pass: one row per piece, as in ``pack``, in the order of arrival.

    ``sequence_id`` is the partition's number times 2**40 plus the bin's number in it, so a repeated task gives the same
    rows. Each task leaves at most its open bins partly empty, besides those that it closed.
    """
    kind = df.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, bins, base = _tokenizer(tokenizer_path, pattern), OpenBins(capacity, open_bins), TaskContext.get().partitionId() << TASK_BITS
        for b in slices(batches, "__text"):
            owner, rows = [], []
            for k, got in enumerate(tok.encode_bytes([t or "" for t in b.column(1).to_pylist()])):
                got += end
                cuts = cut_pieces(len(got) // 4, capacity)
                owner += [k] * len(cuts)
                for piece, (s, n) in enumerate(cuts):
                    at, offset = bins.put(n)
                    rows.append((piece, s, n, zlib.crc32(got[4 * s : 4 * (s + n)]), base + at, offset))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 5), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *columns], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return df.selectExpr(f"`{id_col}`", f"`{text_col}` AS __text").mapInArrow(lean(run, "packing"), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(df: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset; sequences of the second pass have negative ids."""
    pieces = stored(pack_in_tasks(df, tokenizer_path, pattern, capacity, end_id, open_bins, id_col, text_col))
    moved = packed_again(pieces, capacity).withColumnsRenamed({"sequence_id": "__bin", "offset": "__at"})
    out = pieces.join(moved, (F.col("sequence_id") == F.col("__bin")) & (F.col("offset") == F.col("__at")), "left")
    return out.select(id_col, "piece", "start", "length", "ids_crc32", F.coalesce("into", "sequence_id").alias("sequence_id"), F.coalesce("to", "offset").alias("offset"))


def packed_again(pieces: DataFrame, capacity: int, open_bins: int = AGAIN, tasks: int = TASKS, room: float = ROOM) -> DataFrame:
    """(sequence_id, offset, into, to): new places of the pieces of bins with more than ``room`` of their places free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins = None, OpenBins(capacity, open_bins)
        for b in batches:
            rows = []
            for own, bin_id, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != group:
                    group, bins = own, OpenBins(capacity, open_bins)
                at, to = bins.put(length)
                rows.append((bin_id, offset, -1 - (own << TASK_BITS) - at, to))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["sequence_id", "offset", "into", "to"])

    left = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < capacity * (1 - room)).select("sequence_id")
    group = F.floor(F.shiftright("sequence_id", TASK_BITS) / tasks).cast("long").alias("group")
    rows = pieces.join(left, "sequence_id", "left_semi").select(group, "sequence_id", "offset", "length")
    return rows.repartition("group").sortWithinPartitions("group", F.desc("length"), "sequence_id", "offset").mapInArrow(lean(run, "packing"), "sequence_id long, offset long, into long, to long")
