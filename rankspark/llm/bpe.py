"""Byte-level BPE over length-bucketed padded matrices (operator 3).

Texts are split by the vocabulary's pattern; each different piece is encoded once per worker. Pieces of similar
length stand in one padded id matrix. In each round every row merges its leftmost pair of minimum rank; pair ranks
come from an open-addressing hash table, and rows without a mergeable pair leave the matrix. Pieces above
``LONG`` bytes take the same merges in the same order from a heap, as a row's rounds would cost its length squared.

Defined results: null text is the empty text; an empty text has no ids; any Unicode text round-trips, a long one whole; null
and repeated ids are ids like others, one row each; other columns are left out; no row gives no row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankspark.llm.common import Splitter, slices

NONE = np.int32(2**31 - 1)
#: Bytes above which a piece is merged on its own.
LONG = 256
#: Different pieces that a worker remembers; beyond it, it forgets all and goes on.
REMEMBERED = 500_000

_EMPTY = np.uint64(2**64 - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> rank of the joined token, in an open-addressing table with linear probes."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() if len(t) > 1 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = np.array([k for k, _ in found], np.uint64), np.array([v for _, v in found], np.int32)
        bits = max(4, int(len(found) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values, self.probes = np.full(1 << bits, _EMPTY), np.full(1 << bits, NONE, np.int32), 0
        left = np.arange(len(keys))
        while len(left):
            slot = self._slot(keys[left], self.probes)
            free = self.keys[slot] == _EMPTY
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], values[left[put]]
            left, self.probes = left[~put], self.probes + 1
        self.plain = dict(zip(keys.tolist(), values.tolist(), strict=True))

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys * _FACTOR) >> self.shift) + np.uint64(probe)) & self.mask

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; NONE where an id is negative or the pair does not join."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = left.ravel()[at].astype(np.uint64) << np.uint64(32) | right.ravel()[at].astype(np.uint64)
        flat = out.ravel()
        for probe in range(self.probes):
            if not len(at):
                break
            slot = self._slot(keys, probe)
            seen = self.keys[slot]
            hit = seen == keys
            flat[at[hit]] = self.values[slot[hit]]
            go = ~hit & (seen != _EMPTY)
            at, keys = at[go], keys[go]
        return flat.reshape(left.shape)


class Bpe:
    """A rank vocabulary: pieces to ids, ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split, self.table = Splitter(pattern), PairTable(ranks)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.name = [str(i) for i in range(size)]
        self.known: dict[str, bytes] = {}

    @staticmethod
    def read(path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _rounds(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        n = len(rows)
        sizes = np.fromiter(map(len, rows), np.int64, n)
        ids = np.full((n, width + 1), -1, np.int32)
        ids[np.arange(width + 1) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(rows), np.uint8)]
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        who = np.arange(n)
        rank = self.table.look(ids[:, :-1], ids[:, 1:])
        while len(who):
            pos = rank.argmin(1)
            row = np.arange(len(who))
            best = rank[row, pos]
            done = best == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[who[i]] = ids[i, : sizes[i]].copy()
                go = ~done
                who, ids, rank, sizes, pos, best = who[go], ids[go], rank[go], sizes[go], pos[go], best[go]
                if not len(who):
                    break
                keep = int(sizes.max()) + 1
                ids, rank = ids[:, :keep], rank[:, : keep - 1]
                row = np.arange(len(who))
            after = np.arange(ids.shape[1]) > pos[:, None]
            ids = np.where(after, np.pad(ids[:, 1:], ((0, 0), (0, 1)), constant_values=-1), ids)
            ids[row, pos] = best
            rank = np.where(after[:, :-1], np.pad(rank[:, 1:], ((0, 0), (0, 1)), constant_values=NONE), rank)
            rank[row, pos] = self.table.look(ids[row, pos], ids[row, pos + 1])
            inner = np.flatnonzero(pos > 0)
            rank[inner, pos[inner] - 1] = self.table.look(ids[inner, pos[inner] - 1], ids[inner, pos[inner]])
            sizes = sizes - 1
        return out

    def _alone(self, piece: bytes) -> np.ndarray:
        ids, plain = self.byte_id[np.frombuffer(piece, np.uint8)].tolist(), self.table.plain
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(plain[k], i, k) for i in range(n - 1) if (k := ids[i] << 32 | ids[i + 1]) in plain]
        heapq.heapify(heap)
        while heap:
            rank, i, key = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] << 32 | ids[j] != key:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (k := rank << 32 | ids[after[i]]) in plain:
                    heapq.heappush(heap, (plain[k], i, k))
            if (b := before[i]) >= 0 and (k := ids[b] << 32 | rank) in plain:
                heapq.heappush(heap, (plain[k], b, k))
        return np.array([x for x, a in zip(ids, alive, strict=True) if a], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, as one vocabulary piece without splitting."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            buckets.setdefault(0 if len(p) > LONG else max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, own in buckets.items():
            step = max(1, (1 << 20) // max(1, width))
            for a in range(0, len(own), step):
                part = own[a : a + step]
                for i, ids in zip(part, self._rounds([pieces[i] for i in part], width) if width else [self._alone(pieces[i]) for i in part], strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = list(map(self.split, texts))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = [p for p in set().union(*split) if p not in known] if split else []
        for p, ids in zip(new, self.encode_pieces([p.encode() for p in new]), strict=True):
            known[p] = ids.astype("<u4").tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, s)), "<u4") for s in split]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.length[ids]
        ends = np.cumsum(size)
        return self.blob[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@lru_cache(maxsize=4)
def _vocabulary(path: str, pattern: str) -> Bpe:
    return Bpe.read(path, pattern)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again.

    Columns: the id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space), ``decoded_sha256`` and,
    with ``keep_ids``, ``ids`` (array of int). One row per input row; repeated rows give repeated rows.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(ranks_path, pattern)
        for b in slices(batches, "__text"):
            got = bpe.encode([t or "" for t in b.column(1).to_pylist()])
            cols = [
                b.column(0),
                pa.array([len(x) for x in got], pa.int64()),
                pa.array([hashlib.sha256(" ".join(map(bpe.name.__getitem__, x.tolist())).encode()).hexdigest() for x in got], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in got], pa.string()),
            ]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array([x.astype(np.int32) for x in got], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return df.selectExpr(f"`{id_col}`", f"`{text_col}` AS __text").mapInArrow(run, schema)
