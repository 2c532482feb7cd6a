"""Chroma audio fingerprints and their alignment (operator 9).

A recording is a binary column of 16-bit mono samples; windowed Fourier transforms give frames of 12 pitch-class
energies. Over each frame a set of rectangle filters is read from an integral image of frames by pitch classes; each
filter's answer is cut into two bits (Gray coded), and 16 filters give a packed 32-bit integer. Recordings are aligned by
seeds: samples of some bits of the ``WINDOW`` integers from each one that differs from the one before (so that silence,
one integer on and on, seeds nothing), of which one or more outlive bit errors; a run of one integer as long as an alignment
seeds by its integer and length. Only the 20 of the 32 bits that are nearest to even over the whole corpus are sampled, as
a bit that is nearly always set tells little. A seed has as many bits as it takes to tell all integers of the corpus apart,
and a place as many seeds as ``PASSAGE`` integers with ``BAD`` bit errors need; so the rows that meet by chance stay near
the number of seeds.
Recordings keep only the seeds that a query may have too. That is told where the seeds are made, from a bitmap of the
queries' seeds that each task sets itself: the integers of all queries, a small part of what their seeds take, are dealt to
every task, and a task has some of the recordings and some of the keys. The seeds left and those of the queries are joined
by a shuffle; none go through the driver. Recordings of the same integers are aligned once, and what is found holds for each.
Frames of a query that share a seed with a recording vote for an offset, each once. Every offset with enough votes is
checked by the share of different bits over all overlapping frames. Of the offsets that pass within the widest filter's
frames of each other, whose answers come from the same frames, the one with the least errors stays; all others are returned.

Defined results: a null or short recording has no integer and matches nothing; an odd last byte is ignored; null energies
count as 0; of equal errors the longer overlap, then the smallest absolute offset, then the smaller offset, is taken; rows
with one id are parts of a recording, aligned one by one, equal ones once; a null id has integers but is never aligned; a
recording is transformed whole by one task; other columns are left out; no row gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import block_count, mix, shuffle_partitions, slices, stored

CLASSES = 12
WIDTHS = (2, 4, 6, 8)
#: Votes and overlapping frames that an alignment needs, and the share of different bits that it may have. By chance
#: recordings of noise come down to 0.3 over 16 frames.
VOTES, OVERLAP, ERRORS = 2, 20, 0.25
#: Seeds are dealt so that this many integers with this share of bit errors share ``SHARED`` seeds on average.
PASSAGE, BAD, SHARED = 24, 0.2, 8
#: Integers from which a seed's bits are sampled, and the bits of each that are.
WINDOW, EVEN = 8, 20
#: What a sampled bit tells of its window, measured on noise (a fair one: 1).
TOLD = 0.88
#: Frames that are transformed, integers that are seeded, and seeds that are handed on, at once.
TOGETHER, SEEDED, HANDED = 256, 4096, 1 << 16
#: Bits of a bitmap for each seed set in it, the most bits that one has, and the most blocks that recordings are dealt to
#: (a block sets the queries' seeds again).
SPACE, BITMAP, BLOCKS = 16, 1 << 29, 32
# Where a filter's answer is cut.
LEVELS = (-0.15, 0.0, 0.15)


def chroma_frames(samples: np.ndarray, rate: int, size: int = 4096, hop: int = 1365) -> np.ndarray:
    """Pitch-class energies (frames x 12) of mono samples, by windowed Fourier transforms between 28 and 3520 Hz."""
    if len(samples) < size:
        return np.zeros((0, CLASSES))
    window, hertz = np.hanning(size), np.fft.rfftfreq(size, 1 / rate)
    own = np.flatnonzero((hertz >= 28) & (hertz <= 3520))
    pitch = np.round(12 * np.log2(hertz[own] / 440)).astype(int) % CLASSES
    each = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop]
    out = np.zeros((len(each), CLASSES))
    for a in range(0, len(each), TOGETHER):
        power = np.abs(np.fft.rfft(each[a : a + TOGETHER] * window, axis=1)[:, own]) ** 2
        for c in range(CLASSES):
            out[a : a + TOGETHER, c] = power[:, pitch == c].sum(1)
    return out


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the 16 filters: four kinds at four widths, classes spread over the octave."""
    return [(kind, (3 * kind + 2 * k) % 7, 6 - k % 2, w) for kind in range(4) for k, w in enumerate(WIDTHS)]


def integral(frames: np.ndarray) -> np.ndarray:
    out = np.zeros((len(frames) + 1, CLASSES + 1))
    out[1:, 1:] = frames.cumsum(0).cumsum(1)
    return out


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """Packed integers of the frames that have room for the widest filter."""
    n = len(frames) - max(WIDTHS) + 1
    if n < 1:
        return np.empty(0, np.uint32)
    frames = np.nan_to_num(np.asarray(frames, float))
    norm = np.linalg.norm(frames, axis=1, keepdims=True)
    image = integral(np.divide(frames, norm, out=np.zeros_like(frames), where=norm > 1e-9))
    t = np.arange(n)
    area = lambda a, b, c, d: image[t + b, d] - image[t + a, d] - image[t + b, c] + image[t + a, c]
    out = np.zeros(n, np.uint32)
    for kind, low, high, w in filters():
        top, half, mid = low + high, w // 2, low + high // 2
        if kind == 0:  # loud against all other classes
            x, y = area(0, w, low, top), area(0, w, 0, CLASSES) - area(0, w, low, top)
        elif kind == 1:  # later against earlier
            x, y = area(half, w, low, top), area(0, half, low, top)
        elif kind == 2:  # upper against lower classes
            x, y = area(0, w, mid, top), area(0, w, low, mid)
        else:  # the two diagonals
            x, y = area(0, half, low, mid) + area(half, w, mid, top), area(0, half, mid, top) + area(half, w, low, mid)
        level = np.digitize(np.round(np.log1p(np.maximum(x, 0)) - np.log1p(np.maximum(y, 0)), 9), LEVELS)  # no rounding noise at a cut
        out = out << np.uint32(2) | (level ^ (level >> 1)).astype(np.uint32)
    return out


def fingerprints(recordings: DataFrame, id_col: str, frames_col: str) -> DataFrame:
    """(rec, prints: binary of little-endian 32-bit integers) of recordings given as flat arrays of 12 energies a frame."""
    kind = recordings.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(np.array([0.0 if v is None else v for v in f or ()])[: len(f or ()) // CLASSES * CLASSES].reshape(-1, CLASSES)).astype("<u4").tobytes() for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["rec", "prints"])

    return recordings.select(id_col, frames_col).mapInArrow(run, f"rec {kind}, prints binary")


def audio_fingerprints(recordings: DataFrame, id_col: str, audio_col: str, rate: int, size: int = 4096, hop: int = 1365) -> DataFrame:
    """(rec, prints) of recordings given as little-endian 16-bit mono samples."""
    kind = recordings.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                raw = b.column(1)[k].as_py() or b""
                x = np.frombuffer(raw, "<i2", len(raw) // 2)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([fingerprint(chroma_frames(x, rate, size, hop)).astype("<u4").tobytes()], pa.binary())], ["rec", "prints"])

    return recordings.select(id_col, audio_col).mapInArrow(run, f"rec {kind}, prints binary")


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Integers of a batch, those of queries, and those with each bit set."""
    for b in batches:
        for raw, asked in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(raw.as_py() or b"", "<u4")
            ones = [int(np.count_nonzero(x & np.uint32(1 << k))) for k in range(32)]
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([len(x) if asked else 0], pa.int64()), pa.array([ones], pa.list_(pa.int64()))], ["integers", "asked", "ones"])


def corpus_bits(prints: DataFrame, is_query: Column) -> tuple[int, int, list[int]]:
    """The corpus's integers, those of queries, and the ``EVEN`` bits whose shares of ones over all of them are nearest to a half."""
    counts = prints.select("prints", is_query.alias("asked")).mapInArrow(_bit_counts, "integers long, asked long, ones array<long>")
    total, asked, *ones = counts.agg(F.sum("integers"), F.sum("asked"), *[F.sum(F.col("ones")[k]) for k in range(32)]).first()
    return total or 0, asked or 0, sorted(range(32), key=lambda k: (abs(2 * (ones[k] or 0) - (total or 0)), k))[:EVEN]


def seed_bits(integers: int) -> tuple[int, int]:
    """Bits of a seed and seeds of a place for a corpus of so many integers."""
    bits = min(31, max(12, math.ceil(math.log2(max(2, integers)) / TOLD)))
    return bits, math.ceil(SHARED / ((PASSAGE - WINDOW + 1) * (1 - BAD) ** bits))


def _samples(bits: int, keys: int) -> list[np.ndarray]:
    """The bits of the window that make each key: ``EVEN`` of its first integer, then those of the next."""
    draw = np.random.default_rng(9)
    return [draw.permutation(WINDOW * EVEN)[:bits] for _ in range(keys)]


def _seeds_of(prints: pa.Array, even: list[int], samples: list[np.ndarray], share: int, shares: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Seeds, rows and places of recordings, in pieces: those of every ``shares``-th key, and with the first of runs."""
    raw = prints.to_pylist()
    x = np.frombuffer(b"".join(raw), "<u4")
    edges = np.cumsum([0, *(len(r) // 4 for r in raw)])
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[edges[edges < len(x)]] = True
    starts = np.flatnonzero(new)
    row = np.searchsorted(edges, starts, "right") - 1
    place = (starts - edges[row]).astype(np.int32)
    whole = np.flatnonzero(starts + WINDOW <= edges[row + 1])
    for a in range(0, len(whole), SEEDED):
        own = whole[a : a + SEEDED]
        window = [x[starts[own] + ahead] >> np.uint32(e) & np.uint32(1) for ahead in range(WINDOW) for e in even]
        for k in range(share, len(samples), shares):
            seed = np.zeros(len(own), np.uint32)
            for n, bit in enumerate(samples[k]):
                seed |= window[bit] << np.uint32(n)
            yield seed.astype(np.int64) | k << len(samples[k]), row[own], place[own]
    if share == 0:
        length = np.diff(np.append(starts, len(x)))
        runs = np.flatnonzero(length >= OVERLAP)
        run = 1 << 62 | np.minimum(length[runs], (1 << 29) - 1) << 33 | x[starts[runs]].astype(np.int64) << 1
        # A run seeds at VOTES places, so that it is enough by itself.
        yield np.repeat(run, VOTES), np.repeat(row[runs], VOTES), (place[runs, None] + np.arange(VOTES, dtype=np.int32)).ravel()


def _handed(b: pa.RecordBatch, pieces: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Seeds and places of pieces of a batch, with what names their rows, about ``HANDED`` at once."""
    names = [c for c in b.schema.names if c not in ("cell", "other", "prints")]
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for piece in chain(pieces, [None]):
        if piece is not None:
            held.append(piece)
        if held and (piece is None or sum(len(seed) for seed, _, _ in held) >= HANDED):
            seed, row, place = map(np.concatenate, zip(*held, strict=True))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in names), pa.array(seed), pa.array(place)], [*names, "seed", "place"])
            held = []


def _seeds(even: list[int], bits: int, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = _samples(bits, keys)
        for b in slices(batches, "prints", 4 * SEEDED):
            yield from _handed(b, _seeds_of(b.column("prints"), even, samples, 0, 1))

    return run


def dealing(asked: int, keys: int, tasks: int) -> tuple[int, int, int]:
    """Shares of the keys, blocks of recordings, and bits of a bitmap for a share of the seeds of so many integers of queries.

    A bitmap stays within ``BITMAP`` by more shares, and each recording is dealt out once a share.
    """
    shares = min(keys, max(block_count(SPACE * asked * keys, BITMAP), block_count(tasks, BLOCKS)))
    return shares, block_count(tasks, shares), min(BITMAP, 1 << max(10, (SPACE * asked * keys // shares).bit_length()))


def _slots(seed: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each seed in a bitmap of ``size`` bits, a power of two."""
    h = mix(seed.view(np.uint64))
    return (h & np.uint64(size - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(size - 1)).astype(np.int64)


def _put(bitmap: np.ndarray, seed: np.ndarray) -> None:
    for slot in _slots(seed, 8 * len(bitmap)):
        np.bitwise_or.at(bitmap, slot >> 3, (1 << (slot & 7)).astype(np.uint8))


def _may_have(bitmap: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Where the seeds are that were put into the bitmap, and a few others."""
    one, two = _slots(seed, 8 * len(bitmap))
    at = np.flatnonzero(bitmap[one >> 3] >> (one & 7).astype(np.uint8) & 1)
    two = two[at]
    return at[(bitmap[two >> 3] >> (two & 7).astype(np.uint8) & 1).astype(bool)]


def _shared_seeds(even: list[int], bits: int, keys: int, shares: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows by cell, those of queries first: the seeds of all others that a query of the cell may have."""
        samples, bitmap, cell = _samples(bits, keys), np.zeros(size // 8, np.uint8), -1

        def kept(pieces):
            for piece in pieces:
                at = _may_have(bitmap, piece[0])
                yield tuple(x[at] for x in piece)

        for batch in slices(batches, "prints", 4 * SEEDED):
            kind = batch.column("cell").to_numpy() * 2 + batch.column("other").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
            for b in (batch.slice(a, z - a) for a, z in zip(cuts, cuts[1:], strict=False)):
                if cell != (cell := b.column("cell")[0].as_py()):
                    bitmap[:] = 0
                pieces = _seeds_of(b.column("prints"), even, samples, cell % shares, shares)
                if b.column("other")[0].as_py():
                    yield from _handed(b, kept(pieces))
                else:
                    for seed, _, _ in pieces:
                        _put(bitmap, seed)

    return run


def errors_at(x: np.ndarray, y: np.ndarray, shift: int) -> tuple[int, float]:
    """Overlapping frames and the share of different bits at an offset."""
    x, y = x[max(0, -shift) :], y[max(0, shift) :]
    n = min(len(x), len(y))
    return n, float(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n) if n else 1.0


def _checked(overlap: int, errors: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All offsets of a pair that pass, without those next to a better one."""
        for b in batches:
            row, found = [], []
            for i, (x, y, offsets) in enumerate(zip(b.column("query_prints").to_pylist(), b.column("prints").to_pylist(), b.column("offsets").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                each = [(*errors_at(x, y, o["shift"]), o["shift"], o["votes"]) for o in offsets]
                kept: list[tuple] = []
                for m in sorted((m for m in each if m[0] >= overlap and m[1] <= errors), key=lambda m: (m[1], -m[0], abs(m[2]), m[2])):
                    if all(abs(m[2] - k[2]) > max(WIDTHS) for k in kept):
                        kept.append(m)
                row += [i] * len(kept)
                found += kept
            at = pa.array(row, pa.int64())
            n, share, shift, votes = zip(*found, strict=True) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column("query_part").take(at), b.column("part").take(at), pa.array(shift, pa.int32()), pa.array(votes, pa.int64()), pa.array(n, pa.int64()), pa.array(share, pa.float64())], ["query_part", "part", "shift", "votes", "overlap", "bit_errors"])

    return run


def align(prints: DataFrame, is_query: Column, votes: int = VOTES, overlap: int = OVERLAP, errors: float = ERRORS) -> DataFrame:
    """Alignments of the query recordings with all others: query_id, match_id, shift, votes, overlap, bit_errors.

    ``shift`` is the place in the match less the place in the query. Queries are matched by an equi-join on seeds.
    """
    tasks = shuffle_partitions(prints.sparkSession)
    total, asked_integers, even = corpus_bits(prints, is_query)
    bits, keys = seed_bits(total)
    shares, blocks, size = dealing(asked_integers, keys, tasks)
    held = prints.select("rec", "prints").where("rec IS NOT NULL AND prints IS NOT NULL").distinct()
    each = held.groupBy("prints").agg(F.max(F.coalesce(is_query, F.lit(False))).alias("is_asked"), (F.count("*") > 1).alias("many"))
    parts = stored(each.select(F.monotonically_increasing_id().alias("part"), "*"))  # numbered once for all that reads them
    queries = parts.where("is_asked")
    # A cell is a block of recordings and a share of the keys. Small rows become many: cells and queries are dealt out first.
    known = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks * shares - 1))).alias("cell"), F.lit(0).alias("other"), "part", "prints")
    block = F.pmod(F.xxhash64("part"), F.lit(blocks)).cast("int")
    others = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")).select((block * shares + F.col("share")).alias("cell"), F.lit(1).alias("other"), "part", "prints")
    cells = known.unionByName(others).repartitionById(blocks * shares, "cell").sortWithinPartitions("cell", "other")
    seeds = cells.mapInArrow(_shared_seeds(even, bits, keys, shares, size), "part long, seed long, place int")
    dealt = queries.select("part", "many", "prints").repartition(tasks, "part")
    asked = dealt.mapInArrow(_seeds(even, bits, keys), "part long, many boolean, seed long, place int").toDF("query_part", "many", "seed", "at")
    # Spark takes the seeds for as small as the recordings that they are made of, and would send them through the driver.
    hits = seeds.join(asked.hint("merge"), "seed").where((F.col("query_part") != F.col("part")) | F.col("many"))
    pair = ["query_part", "part"]
    voted = hits.groupBy(*pair, (F.col("place") - F.col("at")).alias("shift"), "at").agg(F.lit(1).alias("one"))
    counted = voted.groupBy(*pair, "shift").agg(F.count("*").alias("votes")).where(F.col("votes") >= votes)
    offsets = counted.groupBy(*pair).agg(F.collect_list(F.struct("shift", "votes")).alias("offsets"))
    both = offsets.join(queries.select(F.col("part").alias("query_part"), F.col("prints").alias("query_prints")), "query_part").join(parts.select("part", "prints"), "part")
    found = both.select(*pair, "offsets", "query_prints", "prints").mapInArrow(_checked(overlap, errors), "query_part long, part long, shift int, votes long, overlap long, bit_errors double")
    names = held.join(parts.select("part", "prints"), "prints")
    asking = names.where(is_query).select(F.col("rec").alias("query_id"), F.col("part").alias("query_part"))
    named = found.join(asking, "query_part").join(names.select(F.col("rec").alias("match_id"), "part"), "part")
    return named.where("query_id != match_id").select("query_id", "match_id", "shift", "votes", "overlap", "bit_errors").distinct()
