"""Exact removal of repeated byte strings with a two-stage suffix sort (operator 5).

A byte goes if a ``size``-byte string that covers it also starts elsewhere. Equal strings are brought together without
shipping every suffix:

1. Each ``size``-byte window is named by its anchor, the least hash among its ``GRAM``-byte grams. Equal windows have
   equal anchors. Windows in a row with one anchor form a segment; only its description is shuffled first.
2. Segments whose anchor occurs once cannot repeat. The others are cut out of the texts, equal segments are summed up
   (an equal copy elsewhere settles all windows of a segment), and different segments meet by anchor.
3. Anchors with more than ``CROWD`` different segments, or more than ``KEY_BYTES`` of them, are split: a window that has the anchor in its right half also
   holds the ``half`` bytes left of it, and the others those right of it, so a longer anchor takes its place. Seven
   halvings reach whole windows, so no group needs a cap.
4. In each group of anchors the segments' suffixes are sorted in two stages: those smaller than their successor
   directly, the others induced by a scan over the first-byte buckets. Neighbours' common prefixes of ``size`` bytes
   or more are the repeats.

Equal segments are told by a 128-bit digest. A segment stays whole in one task; it is longer than a few hundred bytes
only where one gram is the least hash on and on, as in a periodic text, and then as long as that stretch.

Defined results: null text is the empty text; a text shorter than ``size`` bytes keeps all; repeated rows (same id and
text) are texts of their own, so that all of their windows repeat; rows that share an id only are told apart by their
texts; null ids are ids like others; columns that are not carried are left out; no row gives no row.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import lean, mix, row_key, slices, stored

#: Bytes of the grams that name windows.
GRAM = 40
#: Different segments that an anchor may have before it is split.
CROWD = 4096
#: Bytes of different segments that an anchor may have before it is split. The sort takes some 30 times its input in memory.
KEY_BYTES = 2 << 20
#: Bytes of segments that one call sorts at most, unless those of one anchor are more.
SORT_BYTES = 1 << 20
#: Neighbours whose common prefixes are looked at together.
NEIGHBOURS = 1 << 17

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_MUL = [_U(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(9)]


# ---- the two-stage sort -------------------------------------------------------------------------------------------


def _place_type(n: int) -> type:
    """For places in a text of ``n`` bytes: half the memory, but for very long ones."""
    return np.int32 if n < 2**31 - 2**16 else np.int64


def sort_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``text`` (uint8; its last byte must be 0), ordered by their first ``depth`` bytes.

    Stage one sorts the suffixes that are smaller than their successor, a few bytes at a time, ties only. Stage two
    scans the buckets of first bytes upwards and puts each suffix that is larger than its successor in place.
    Suffixes equal over ``depth`` bytes come next to each other in no defined order.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    place = _place_type(n)
    rise = np.sign(np.diff(text.astype(np.int16))).astype(np.int8)  # next byte less (-1), equal, greater
    nearest = np.arange(n - 1, dtype=place)
    nearest[rise == 0] = n
    np.minimum.accumulate(nearest[::-1], out=nearest[::-1])
    smaller = np.zeros(n, bool)  # than its successor; the last suffix counts as smaller, it has none
    smaller[:-1] = nearest < n
    np.minimum(nearest, n - 2, out=nearest)
    smaller[:-1] &= rise[nearest] > 0
    smaller[-1] = True
    del rise, nearest
    first = np.flatnonzero(smaller).astype(place)
    # Symbols in as few bits as the text's different bytes need; one 64-bit key holds a tie's number and the next symbols.
    used = np.flatnonzero(np.bincount(text, minlength=256))
    bits = max(1, int(len(used) - 1).bit_length())
    dense = np.zeros(256, np.uint8)
    dense[used] = np.arange(len(used))
    room = int(n).bit_length()
    step, lead = (63 - room) // bits, 63 // bits
    padded = np.concatenate([dense[text], np.zeros(lead, np.uint8)])
    words = padded[:n].astype(_U)  # the next ``lead`` symbols of each place, the first one in the highest bits
    for k in range(1, lead):
        words <<= _U(bits)
        words |= padded[k : k + n]
    del padded
    key = words[first]
    order = np.argsort(key)
    first, key = first[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    del key, order
    lo = lead
    while lo < depth:
        at = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
        if not len(at):
            break
        own = first[at]
        after = np.minimum(own, n - 1 - lo) + place(lo) if lo < n else np.full(len(own), n - 1, place)
        key = words[after] >> _U((lead - step) * bits)
        key[own >= n - lo] = 0  # nothing comes after these
        tie = np.cumsum(new[at], dtype=_U)
        tie <<= _U(step * bits)
        key |= tie
        del after, tie
        order = np.argsort(key)
        first[at] = own[order]
        key = key[order]
        new[at] = np.concatenate([[True], key[1:] != key[:-1]])
        del own, key, order
        lo += step
    del words, new

    # Stage two. The direct ones stand in their buckets already, after the induced ones of the same first byte.
    edge = np.searchsorted(text[first], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(suffixes: np.ndarray, byte: int) -> np.ndarray:
        """Deal the larger predecessors of ``suffixes`` to their buckets; those of this bucket are returned."""
        before = suffixes[suffixes > 0] - 1
        before = before[~smaller[before]]
        c = text[before]
        same = before[c == byte]
        rest = c > byte
        before, c = before[rest], c[rest]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        for part in np.split(before, np.flatnonzero(np.diff(c)) + 1) if len(before) else ():
            waiting[text[part[0]]].append(part)
        return same

    for byte in range(256):
        todo = waiting[byte]
        while todo:
            nxt = []
            for part in todo:
                out.append(part)
                same = induce(part, byte)
                if len(same):
                    nxt.append(same)
            todo = nxt
        if edge[byte] < edge[byte + 1]:
            part = first[edge[byte] : edge[byte + 1]]
            out.append(part)
            induce(part, byte)
    return np.concatenate(out)


def repeated_starts(segments: list[bytes], size: int) -> list[np.ndarray]:
    """For each segment, which window starts have a ``size``-byte string that starts at another place of any segment."""
    lens = np.fromiter(map(len, segments), np.int64, len(segments))
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    begin = np.cumsum(lens + 1) - lens - 1
    order = sort_suffixes(raw, size)
    room = np.repeat((begin + lens).astype(order.dtype), lens + 1)  # bytes from a place to its segment's end
    room -= np.arange(len(raw), dtype=order.dtype)
    order = order[(room >= size)[order]]
    del room
    flag = np.zeros(len(raw), bool)
    for k in range(0, len(order) - 1, NEIGHBOURS):
        part = order[k : k + NEIGHBOURS + 1]
        a, b = part[:-1], part[1:]
        same = common_prefix_reaches(raw, a, b, size)
        flag[a[same]] = True
        flag[b[same]] = True
    return [flag[x : x + max(0, n - size + 1)] for x, n in zip(begin.tolist(), lens.tolist(), strict=True)]


def common_prefix_reaches(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the suffixes at ``a`` and ``b`` share ``size`` bytes (all of which lie inside ``raw``)."""
    same = np.zeros(len(a), bool)
    left = np.arange(len(a))
    for k in range(0, size, 8):
        w = min(8, size - k)
        ok = np.ones(len(left), bool)
        for j in range(w):
            ok &= raw[a[left] + k + j] == raw[b[left] + k + j]
        left = left[ok]
    same[left] = True
    return same


# ---- anchors ------------------------------------------------------------------------------------------------------


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size``-byte gram, by doubling: a hash of 2k bytes from two of k."""
    parts, h, have = [], _BYTE[raw], 1
    offset, k = 0, size
    level = 0
    while k:
        if k & 1:
            parts.append((h, offset, have))
            offset += have
        k >>= 1
        if k:
            h = h[:-have] * _MUL[level] + h[have:]
            have *= 2
            level += 1
    n = len(raw) - size + 1
    total = np.zeros(n, _U)
    for x, off, _ in parts:
        total = total * _MUL[8] + x[off : off + n]
    return mix(total)


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have :])


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor hash) of the segments of a text, from its gram hashes; ``width`` grams a window."""
    least = window_minima(grams, width)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return first, np.diff(np.concatenate([first, [len(least)]])), least[first]


def split_segment(text: bytes, fixed: int, long: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Cut a segment whose windows all hold ``text[fixed : fixed + long]``: (from, to, new fixed, new long) of the parts.

    Windows that hold the ``left`` bytes before the fixed string take the longer string on that side; all others hold
    the bytes after it.
    """
    slack = size - long
    left = (slack + 1) // 2
    right = slack - left + 1
    last = len(text) - size
    edge = fixed - left  # the last window start that holds the bytes before
    if edge >= 0:
        yield 0, min(edge, last) + size, fixed - left, long + left
    if edge < last:
        yield max(0, edge + 1), last + size, fixed, long + right


def first_gram(raw: np.ndarray, anchor: int, gram: int) -> np.ndarray:
    return np.flatnonzero(gram_hashes(raw, gram) == _U(anchor))


# ---- the job ------------------------------------------------------------------------------------------------------

_KEYS = "k1 long, k2 long"


def _columns(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _doubled(h: np.ndarray, width: int, first: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Which segments hold their anchor more than once, and so may repeat a window inside."""
    out = np.zeros(len(first), bool)
    ordered = np.sort(h)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    for k in np.flatnonzero(np.isin(anchor, again)) if len(again) else ():
        out[k] = np.count_nonzero(h[first[k] : first[k] + n[k] + width - 1] == anchor[k]) > 1
    return out


def _describe(size: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            out = []
            for t in b.column(2).to_pylist():
                grams = gram_hashes(np.frombuffer(t, np.uint8), gram)
                told = anchors(grams, size - gram + 1)
                out.append((*told, 1 + _doubled(grams, size - gram + 1, *told)))
            if out:
                counts = [len(o[0]) for o in out]
                first, n, anchor, weight = (np.concatenate([o[k] for o in out]) for k in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), counts)), pa.array(np.repeat(b.column(1).to_numpy(), counts)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(weight.astype(np.int32))], ["k1", "k2", "first", "n", "anchor", "weight"])

    return run


def _extract(size: int):
    """Cut the wanted segments; the bytes of a segment are given once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = set()
        for b in slices(batches, "__text"):
            rows = []
            for k1, k2, t, parts in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                for p in parts:
                    seg = t[p["first"] : p["first"] + p["n"] + size - 1]
                    name = (p["anchor"], xxhash.xxh3_128_digest(seg))
                    rows.append((k1, k2, p["first"], *name, None if name in given else seg, p["twice"]))
                    given.add(name)
            if rows:
                yield _columns(rows, ["k1", "k2", "first", "key", "seg_id", "seg", "twice"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()])

    return run


def _split(size: int, gram: int):
    """Parts of crowded segments under longer anchors: (parent key and name, offset, part ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "seg"):
            rows = []
            for r in b.to_pylist():
                seg, pieces = r["seg"], []
                if r["long"] == 0:  # the anchor is a gram; each of its places has the windows after the place before
                    at = first_gram(np.frombuffer(seg, np.uint8), np.int64(r["key"]).view(np.uint64), gram).tolist()
                    for low, q in zip([0, *(x + 1 for x in at[:-1])], at, strict=True):
                        high = min(q, len(seg) - size)
                        pieces += [(low, seg[low : high + size], q - low, gram)] if low <= high else []
                else:
                    pieces = [(0, seg, r["fixed"], r["long"])]
                for low, part, fixed, long in pieces:
                    for a, z, f, g in split_segment(part, fixed, long, size):
                        own = part[a:z]
                        key = xxhash.xxh3_64_intdigest(part[f : f + g], seed=g) - 2**63
                        rows.append((r["key"], r["seg_id"], low + a, key, xxhash.xxh3_128_digest(own), own, r["copies"], f - a, g, r["twice"]))
            if rows:
                yield _columns(rows, ["up_key", "up_id", "off", "key", "seg_id", "seg", "copies", "fixed", "long", "twice"], [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()])

    return run


def _sort_groups(size: int):
    """Rows ordered by key -> (key, seg_id, runs) of the segments with repeats, SORT_BYTES or one key of them at a time."""
    run_type = pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int32())]))

    def judged(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        held = Counter(r[0] for r in rows)
        # A segment alone under its anchor, which it holds once, has nothing to be sorted against; its copies decide.
        sort = [r for r in rows if held[r[0]] > 1 or r[4]]
        flags = dict(zip(((r[0], r[1]) for r in sort), repeated_starts([r[2] for r in sort], size) if sort else (), strict=True))
        out = []
        for key, name, seg, copies, _ in rows:
            if copies > 1:
                out.append((key, name, [{"a": 0, "n": len(seg) - size + 1}]))
            elif (flag := flags.get((key, name))) is not None and flag.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
                out.append((key, name, [{"a": a, "n": z - a} for a, z in edge.reshape(-1, 2).tolist()]))
        if out:
            yield _columns(out, ["key", "seg_id", "runs"], [pa.int64(), pa.binary(), run_type])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, start, begun = [], 0, 0, 0
        for b in batches:
            for key, name, seg, copies, twice in zip(*(b.column(c).to_pylist() for c in ("key", "seg_id", "seg", "copies", "twice")), strict=True):
                if rows and rows[-1][0] == key and rows[-1][1] == name:
                    last = rows[-1]
                    last[2], last[3], last[4] = seg if last[2] is None else last[2], last[3] + copies, last[4] or twice
                    continue
                if rows and rows[-1][0] != key:
                    start, begun = len(rows), held  # of the rows of this key
                if held + len(seg) > SORT_BYTES and start:
                    yield from judged(rows[:start])
                    rows, held, start = rows[start:], held - begun, 0
                rows.append([key, name, seg, copies, twice])
                held += len(seg)
        yield from judged(rows)

    return run


def _summed(df: DataFrame) -> DataFrame:
    """One row for each key and segment."""
    return df.groupBy("key", "seg_id").agg(F.first("seg", ignorenulls=True).alias("seg"), F.sum("copies").alias("copies"), F.first("fixed").alias("fixed"), F.first("long").alias("long"), F.max("twice").alias("twice"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows by key and segment, those with bytes first."""
    return rows.select("key", "seg_id", "seg", "copies", "twice").repartition("key").sortWithinPartitions("key", "seg_id", F.col("seg").isNull())


def _repeats(rows: DataFrame, size: int, gram: int, crowd: int) -> DataFrame:
    """(key, seg_id, runs) of the segments, crowded keys split first. Rows of a segment add up; one or more has its bytes."""
    named = rows.groupBy("key", "seg_id").agg(F.max(F.length("seg")).alias("__l")).groupBy("key").agg(F.count("*").alias("__n"), F.sum("__l").alias("__l"))
    crowded = stored(named.where((F.col("__n") > crowd) | (F.col("__n") > 1) & (F.col("__l") > KEY_BYTES)).select("key"))
    lone = "key long, seg_id binary, runs array<struct<a:int,n:int>>"
    none = crowded.isEmpty()
    runs = stored(_in_order(rows if none else rows.join(crowded, "key", "left_anti")).mapInArrow(lean(_sort_groups(size)), lone))
    if none:
        return runs
    hot = stored(_summed(rows.join(crowded, "key", "left_semi")))
    whole = hot.where(F.col("long") >= size)  # a key of whole windows has one segment, so none is left here but by a hash tie
    parts = stored(hot.where(F.col("long") < size).mapInArrow(lean(_split(size, gram)), "up_key long, up_id binary, off int, key long, seg_id binary, seg binary, copies long, fixed int, long int, twice boolean"))
    below = _repeats(stored(_summed(parts)), size, gram, crowd)
    up = parts.select("up_key", "up_id", "off", "key", "seg_id").join(below, ["key", "seg_id"])
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("off")).alias("a"), r["n"].alias("n")))
    up = up.groupBy(F.col("up_key").alias("key"), F.col("up_id").alias("seg_id")).agg(F.flatten(F.collect_list(moved)).alias("runs"))
    return runs.unionByName(up).unionByName(_in_order(whole).mapInArrow(lean(_sort_groups(size)), lone))


def repeated_runs(docs: DataFrame, size: int, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``docs`` has k1, k2 and binary __text. (k1, k2, found: list of first window and runs of repeated starts in it)."""
    docs = docs.select("k1", "k2", "__text").where(F.length("__text") >= size)
    told = docs.mapInArrow(lean(_describe(size, gram)), f"{_KEYS}, first int, n int, anchor long, weight int")
    shared = told.groupBy("anchor").agg(F.sum("weight").alias("__w")).where("__w > 1").select("anchor")
    wanted = told.join(shared, "anchor", "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "n", "anchor", (F.col("weight") > 1).alias("twice"))).alias("parts"))  # a set, as repeated rows say the same
    cuts = stored(docs.join(wanted, ["k1", "k2"]).select("k1", "k2", "__text", "parts").mapInArrow(lean(_extract(size)), f"{_KEYS}, first int, key long, seg_id binary, seg binary, twice boolean"))
    # Copies are summed without their bytes, so a segment with very many copies sends a few rows.
    summed = cuts.groupBy("key", "seg_id").agg(F.count("*").alias("copies"), F.max("twice").alias("twice")).withColumn("seg", F.lit(None).cast("binary"))
    bytes_ = cuts.where("seg IS NOT NULL").select("key", "seg_id", "seg", "twice").withColumn("copies", F.lit(0).cast("long"))
    rows = bytes_.unionByName(summed).withColumns({"fixed": F.lit(-1), "long": F.lit(0)})
    runs = _repeats(rows, size, gram, crowd)
    return cuts.select("k1", "k2", "first", "key", "seg_id").join(runs, ["key", "seg_id"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "runs")).alias("found"))


def covered(length: int, found: list[dict] | None, size: int) -> np.ndarray:
    """Which bytes of a text are in a repeated window."""
    edge = np.zeros(length + 1, np.int32)
    for f in found or ():
        for r in f["runs"]:
            edge[f["first"] + r["a"]] += 1
            edge[f["first"] + r["a"] + r["n"] - 1 + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(df: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, crowd: int = CROWD, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans, kept_sha256, with ``keep_text`` kept_text, and the ``carry`` columns.

    ``kept_text`` is the kept bytes as text; bytes of a character that was cut apart are left out of it.
    """
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("__text"), F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0)]).alias("__rest"))
    docs = docs.select(*row_key("__id", "__text"), "__id", "__text", "__rest")
    found = repeated_runs(docs, size, gram, crowd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            rows = []
            for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if f:
                    gone = covered(len(t), f, size)
                    kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                    spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
                else:
                    kept, spans = t, 0
                rows.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept.decode(errors="ignore")] if keep_text else [])))
            got = _columns(rows, ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * keep_text], [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * keep_text])
            yield pa.RecordBatch.from_arrays([b.column(0), *got.columns, b.column(3)], ["__id", *got.schema.names, "__rest"])

    rest = docs.schema["__rest"].dataType.simpleString()
    schema = f"__id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text + f", __rest {rest}"
    out = docs.join(found, ["k1", "k2"], "left").select("__id", "__text", "found", "__rest").mapInArrow(lean(run), schema)
    return out.select(F.col("__id").alias(id_col), *out.columns[1:-1], *[F.col("__rest").getField(c).alias(c) for c in carry])
