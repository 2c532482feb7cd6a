"""Exact set-similarity join of word shingles by a universe-partition pigeonhole (operator 6).

Sets whose size differs by no more than the threshold allows meet in a size class. A class cuts the token universe
into ``m`` segments by hash. Two similar sets differ in at most ``H`` tokens, so if a set has more than ``H`` units
(one for each segment that is not empty, one more for a segment whose one-deletion neighbours are indexed too) the
two share at least one signature of a segment or of a neighbour of it.

The allocation is by cost: for each class, the cheapest of several layouts (``LAYOUTS``, and single tokens) under
which every set of the corpus has enough units; counted over all sets, so no link can be lost. Segments that many sets
share ("hot") are skipped by every set that has units to spare; only sets that need them ("bound") are compared through
them. Bound sets that share no other signature must share more hot ones than they have units to spare, so each meets
others only through its rarest hot signatures, as many as it has beyond its spare units.

A link in a class shares more signatures there than either set has units to spare. A set that shares no more than these
with all others together has no link: it is left out before any pair is made ("live" are the rest). Each unit whose
signature no other set has is a difference from every other set, which bounds the pairs of live sets (``far``).

The sets of a signature are first held against one of them, a star; links verified there give components. A signature
whose sets are still in different components gets further stars, around one set of each of ``CENTRES`` components. What
is left is looked at pair by pair, but only where components separate the two. Signatures that have their smallest set in
common are taken together where that makes fewer comparisons, so that a pair that shares hundreds of signatures is met
once. The join drops pairs that are too far apart: by size, by ``far``, by ``FOLD`` parity bits (their difference never exceeds
the sets'), or, where a signature is one token, by what the two can have in common from their first shared one on in the
order of rareness.

Signatures travel in blocks (one row for a batch and a bucket); buckets are as many as the signatures need. Candidates
are sifted by whole parity bitmaps and verified on whole sets. Only one link a set is verified first; other candidates
are verified if their ends are still in different components. Shingles are compared by 64-bit hashes.

Defined results: null or blank text has no shingle and is linked with nothing; texts of one to four words have one
shingle; rows with equal shingle sets are linked. Each row gives a row: rows that repeat an id keep their own texts and sets,
and a component's name is its smallest id that is not null (null if it has none). A text is read whole, however long, by
one task. Other columns are left out; no row gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import as_words, lean, lean_group, mix, row_key, shuffle_partitions, slices, stored, word_hashes
from rankspark.llm.components import components

WORDS = 5
#: The threshold: NUM * intersection >= DEN * union is tested in whole numbers.
NUM, DEN = 100, 75
#: Sets that may share a signature before it counts as hot.
HOT = 24
#: Sizes below this form class 0, where each token is a segment; further classes double.
FLOOR = 32
#: Layouts: tokens a segment at the class's largest size; every how many segments have indexed neighbours (0: none).
LAYOUTS = ((3.0, 0), (2.4, 0), (2.4, 4), (1.6, 4))
#: Least size of a parity bitmap.
BITS = 2048
#: Bits of the parity bitmap that goes along to the joins of pairs, in words of 64; ``BITS`` at most.
FOLD = 1024
#: Signatures in a bucket, about; each has 32 bits beside its bucket, and sets that meet by chance are verified apart.
PER_BUCKET = 1 << 20
#: Components of a signature that get a star of their own before the rest is compared pair by pair.
CENTRES = 4
#: Rows that a side may have to be broadcast.
SMALL = 1 << 17
#: Pairs of one pivot that are verified together.
SHARE = 256
BATCH = 12 << 20

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)


def shingles(offsets: np.ndarray, words: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    rolled = np.zeros(max(0, len(words) - k + 1), _U)
    for j in range(k):
        rolled = rolled * _P + words[j : j + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=b - a)], _U) if b > a else np.empty(0, _U))
    return out


def class_of(n: int) -> int:
    return 0 if n < FLOOR else (n // FLOOR).bit_length()


def bounds(c: int) -> tuple[int, int]:
    """Least and largest size of a class."""
    return (1, FLOOR - 1) if c == 0 else (FLOOR << (c - 1), (FLOOR << c) - 1)


def places(n: int) -> list[int]:
    """The classes in which a set of ``n`` stands: its own, and the next if larger sets there may be similar."""
    c = class_of(n)
    return [c, c + 1] if NUM * n >= DEN * bounds(c + 1)[0] else [c]


def needed(n: int, c: int) -> int:
    """Units with which a set of ``n`` cannot miss a similar set in class ``c``: the largest difference and one more."""
    other = min(bounds(c)[1], NUM * n // DEN)
    return (n + other) * (NUM - DEN) // (NUM + DEN) + 1


def segments_of(c: int, layout: int) -> int:
    return max(1, int((bounds(c)[1] + 1) / LAYOUTS[layout][0]))


def layout_of(tokens: np.ndarray, c: int, layout: int) -> tuple[int, int]:
    """Units and cost (signatures) of a set in a class under a layout."""
    if layout == len(LAYOUTS) or c == 0:
        return len(tokens), len(tokens)
    every = LAYOUTS[layout][1]
    sizes = np.bincount((tokens % _U(segments_of(c, layout))).astype(np.int64))
    full = int(np.count_nonzero(sizes))
    if not every:
        return full, full
    near = sizes[::every]
    near = near[near > 1]
    return full + len(near), full + int(near.sum())


def signatures(tokens: np.ndarray, c: int, layout: int) -> np.ndarray:
    """The signatures of a set's segments in a class, and those of one-deletion neighbours."""
    salt = _U((c * 64 + layout + 1) * 0x9E3779B97F4A7C15 % 2**64)
    spread = mix(tokens + _U(0x51ED270B))
    if layout == len(LAYOUTS) or c == 0:
        return mix(spread ^ salt)
    every = LAYOUTS[layout][1]
    at = tokens % _U(segments_of(c, layout))
    order = np.argsort(at, kind="stable")
    at, spread = at[order], spread[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    folded = np.bitwise_xor.reduceat(spread, first)
    out = [mix(folded ^ mix(at[first] ^ salt))]
    if every:
        size = np.diff(np.concatenate([first, [len(at)]]))
        own = np.repeat(np.arange(len(first)), size)
        near = (at % _U(every) == 0) & (size[own] > 1)
        out.append(mix(folded[own[near]] ^ spread[near] ^ mix(at[near] ^ salt)))
    return np.concatenate(out)


def parity(tokens: np.ndarray, bits: int = 0) -> bytes:
    """For each value of the tokens' last bits, whether an odd number of them has it; three bits a token or more."""
    bits = bits or max(BITS, 1 << (3 * len(tokens)).bit_length())
    return np.packbits((np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each parity bitmap folded to ``FOLD`` bits, as an added column of words."""
    for b in batches:
        words = [np.bitwise_xor.reduce(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, FOLD // 64)) for x in b.column("bits")]
        yield b.append_column("fold", pa.array(words, pa.list_(pa.int64())))


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the sets' difference: differing bits, the longer bitmap folded to the shorter."""
    a, b = np.frombuffer(x, _U), np.frombuffer(y, _U)
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """The set's node (a 64-bit hash with a free last bit) and 64 further bits, signed."""
    x = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (x & (2**64 - 2)) - 2**63, (x >> 64) - 2**63


def _sets(batch: pa.RecordBatch, column: str = "__text") -> list[np.ndarray]:
    offsets, words = as_words(batch.column(column))
    return shingles(offsets, word_hashes(words))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a text: node, more, n, the parity bitmap and, for each place and layout, units to spare and cost."""
    for b in slices(batches, "__text"):
        rows = []
        for s in _sets(b):
            if not len(s):
                rows.append((0, 0, 0, None, None, None, None))
                continue
            where = places(len(s))
            both = [[layout_of(s, c, k) for k in range(len(LAYOUTS) + 1)] for c in where]
            rows.append((*digest(s), len(s), parity(s), where, [[u - needed(len(s), c) for u, _ in own] for c, own in zip(where, both, strict=True)], [[x for _, x in own] for own in both]))
        node, more, n, bits, where, spare, cost = zip(*rows, strict=True)
        deep = pa.list_(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(node, pa.int64()), pa.array(more, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(where, pa.list_(pa.int32())), pa.array(spare, deep), pa.array(cost, deep)], ["k1", "k2", "__id", "node", "more", "n", "bits", "places", "spare", "cost"])


def _emit(plan: dict[int, int], buckets: int, most: int):
    """Blocks of signatures: rows (bucket, signatures, nodes, counts, marks) and, for locally hot ones, (bucket, hot)."""

    def block(node: np.ndarray, sig: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(sig)
        edge = np.append(np.flatnonzero(np.diff(sig[order], prepend=~sig[order[:1]])), len(sig))
        hot = np.zeros(len(sig), bool)
        hot[order[np.repeat(np.diff(edge) > most, np.diff(edge))]] = True
        top = ((sig >> _U(40)) % _U(buckets)).astype(np.uint32)
        low = sig.astype("<u4")
        del order, edge, sig
        full = top[hot].astype(_U) << _U(32) | low[hot]
        if len(full):
            salt = int(node[hot].sum() % _U(buckets))
            yield salt, b"", b"", b"", b"", full.tobytes() + node[hot].tobytes()
        marks = np.unique(full)
        order = np.flatnonzero(~hot)[np.argsort(top[~hot], kind="stable")]
        edge = np.searchsorted(top[order], np.arange(buckets + 1, dtype=np.uint32))
        mark_edge = np.searchsorted(marks >> _U(32), np.arange(buckets + 1).astype(_U))
        for k in range(buckets):
            own = order[edge[k] : edge[k + 1]]
            told = marks[mark_edge[k] : mark_edge[k + 1]]
            if not len(own) and not len(told):
                continue
            n = node[own]
            first = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) if len(n) else np.empty(0, np.int64)
            counts = np.diff(np.concatenate([first, [len(n)]]))
            if len(counts) and counts.max() > 255:  # rarely; one more row for the same set
                more = -(-counts // 255)
                first = np.concatenate([f + 255 * np.arange(m) for f, m in zip(first, more, strict=True)])
                counts = np.diff(np.concatenate([first, [len(n)]]))
            counts = counts.astype(np.uint8)
            yield k, low[own].tobytes(), n[first].tobytes(), counts.tobytes(), (told & _U((1 << 32) - 1)).astype("<u4").tobytes(), b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", BATCH):
            seen, nodes, sigs, more = set(), [], [], []
            for part in slices([b], "__text"):
                for s in _sets(part):
                    node = digest(s)[0] if len(s) else None
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    for role, c in enumerate(places(len(s))):
                        own = np.unique(signatures(s, c, plan.get(c, len(LAYOUTS))))
                        sigs.append(own)
                        nodes.append(np.full(len(own), np.int64(node + role).view(_U)))
                        # Rarely, two of a set fall on one: each but the first goes as a hot one of its own, for the counts.
                        lost = len(own) - len(np.unique((own >> _U(40)) % _U(buckets) << _U(32) | own & _U((1 << 32) - 1)))
                        more += [(nodes[-1][0], k) for k in range(lost)]
            if sigs:
                # Gathered one by one, and held by none but the call: they are the most that a task holds.
                nodes = np.concatenate(nodes)
                sigs = [np.concatenate(sigs)]
                rows = list(block(nodes, sigs.pop()))
                if more:
                    place, k = np.array(more, _U).T
                    rows.append((int(place.sum() % _U(buckets)), b"", b"", b"", b"", mix(place + (k + _U(1)) * _P).tobytes() + place.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 5), strict=True)], ["bucket", "sigs", "nodes", "counts", "marks", "hot"])

    return run


def _meet(most: int):
    """Of a bucket's signatures: the star of each (kind 0: a, b), memberships of hot ones (kind 1: sig, place) and of
    the others with three sets or more (kind 2: sig, node), once for equal memberships; of each place, how many of the
    others it shares (kind 3: place, count)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        sig, node, marks, hot = [], [], [], []
        for r in table.select(["sigs", "nodes", "counts", "marks", "hot"]).to_pylist():
            sig.append(np.frombuffer(r["sigs"], "<u4").astype(_U))
            node.append(np.repeat(np.frombuffer(r["nodes"], _U), np.frombuffer(r["counts"], np.uint8)))
            marks.append(np.frombuffer(r["marks"], "<u4").astype(_U))
            both = np.frombuffer(r["hot"], _U)
            hot.append((both[: len(both) // 2], both[len(both) // 2 :]))
        sig, node, marks = np.concatenate(sig), np.concatenate(node), np.unique(np.concatenate(marks))
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[fresh], node[fresh]
        head = np.ones(len(sig), bool)
        head[1:] = sig[1:] != sig[:-1]
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(sig)))
        crowded = (size > most) | np.isin(sig[first], marks)
        many = np.repeat(crowded, size)
        left, right = [_U(bucket) << _U(32) | sig[many], *(h[0] for h in hot)], [node[many], *(h[1] for h in hot)]
        kinds = [np.ones(sum(map(len, left)), np.int32)]
        few = ~crowded & (size > 1)
        at = np.repeat(few, size)
        shared, times = np.unique(node[at], return_counts=True)
        left.append(shared)
        right.append(times.astype(_U))
        kinds.append(np.full(len(shared), 3, np.int32))
        own, size = node[at] & ~_U(1), size[few]
        first = np.cumsum(size) - size
        star = np.stack([np.repeat(own[first], size), own]) if len(size) else np.empty((2, 0), _U)
        star = np.unique(star[:, star[0] != star[1]], axis=1) if len(size) else star
        left.append(star[0])
        right.append(star[1])
        kinds.append(np.zeros(star.shape[1], np.int32))
        if len(size):
            members = np.add.reduceat(mix(own), first) + size.astype(_U)
            _, once = np.unique(members, return_index=True)
            told = np.zeros(len(size), bool)
            told[once] = True
            told = np.repeat(told & (size > 2), size)
            left.append((_U(bucket) << _U(32) | sig[at])[told])
            right.append(own[told])
            kinds.append(np.full(np.count_nonzero(told), 2, np.int32))
        return pa.table({"kind": np.concatenate(kinds), "a": np.concatenate(left).view(np.int64), "b": np.concatenate(right).view(np.int64)})

    return run


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep candidate pairs that size and parity bitmaps allow."""
    for b in batches:
        if not b.num_rows:
            continue
        far = np.array([least_difference(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column("bits_a"), b.column("bits_b"), strict=True)])
        n, m = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
        ok = (far <= (n + m) * (NUM - DEN) // (NUM + DEN)) & (NUM * np.minimum(n, m) >= DEN * np.maximum(n, m))
        yield b.filter(pa.array(ok)).select(["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: a pivot's text (b null), then the texts of the sets to hold against it."""
    at, pivot = None, np.empty(0, _U)
    for batch in batches:
        for part in slices([batch], "__text"):
            found = []
            for a, b, own in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), _sets(part), strict=True):
                if b is None:
                    at, pivot = a, own
                    continue
                if a != at:
                    raise ValueError("a pivot's text is missing")
                both = np.concatenate([pivot, own])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if NUM * common >= DEN * (len(pivot) + len(own) - common):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def _verified(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidate pairs that are linked. A pivot's pairs are dealt into shares of about ``SHARE``, its text to each."""
    many = candidates.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    dealt = candidates.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "shares").cast("int").alias("share"))
    theirs = dealt.join(texts.toDF("b", "__text"), "b").select("a", "share", "b", "__text")
    pivots = dealt.select("a", "share").distinct().join(texts.toDF("a", "__text"), "a").select("a", "share", F.lit(None).cast("long").alias("b"), "__text")
    rows = theirs.union(pivots).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return stored(rows.select("a", "b", "__text").mapInArrow(lean(_verify), "a long, b long"))


def _allocation(profile: DataFrame) -> tuple[dict[int, int], int]:
    """For each class the cheapest layout in which every set has enough units, counted over all sets; all signatures."""
    each = profile.where("n > 0").select(F.explode(F.arrays_zip("places", "spare", "cost")).alias("p")).select("p.places", F.posexplode(F.arrays_zip("p.spare", "p.cost")).alias("layout", "x"))
    found = each.groupBy("places", "layout").agg(F.min("x.spare").alias("spare"), F.sum("x.cost").alias("cost")).collect()  # a row for each class and layout
    plan: dict[int, tuple[int, int]] = {}
    for r in found:
        if r.spare >= 0 and (r.places not in plan or (r.cost, r.layout) < plan[r.places]):
            plan[r.places] = (r.cost, r.layout)
    return {c: k for c, (_, k) in plan.items()}, sum(n for n, _ in plan.values())


def _live(full: DataFrame, meets: DataFrame, hot: DataFrame, plan: dict[int, int]) -> DataFrame:
    """The places (place, node, n, room, single, far) that share more signatures than they have units to spare (``room``).

    A place that shares fewer with all others together has no link there. ``far``: its units that no other place shares,
    each a difference from every other set of the class.
    """
    layouts = F.create_map(*[F.lit(x) for c in range(64) for x in (c, plan.get(c, len(LAYOUTS)))])
    single = F.col("c").isin([c for c in range(64) if c == 0 or plan.get(c, len(LAYOUTS)) == len(LAYOUTS)])
    each = full.select("node", "n", F.posexplode(F.arrays_zip("places", "spare")).alias("role", "x")).select((F.col("node") + F.col("role")).alias("place"), "n", F.col("x.places").alias("c"), F.element_at("x.spare", F.element_at(layouts, F.col("x.places")) + 1).alias("room"))
    shared = meets.where("kind = 3").select(F.col("a").alias("place"), F.col("b").alias("times")).union(hot.select("place", F.lit(1).cast("long"))).groupBy("place").agg(F.sum("times").alias("shared"))
    needed = F.expr(f"(n + least(shiftleft({FLOOR}L, c) - 1, {NUM} * n div {DEN})) * {NUM - DEN} div {NUM + DEN} + 1")  # as needed()
    live = each.dropDuplicates(["place"]).join(shared, "place").where("shared > room")
    return stored(live.select("place", F.col("place").bitwiseAND(-2).alias("node"), "n", "room", single.alias("single"), (F.col("room") + needed - F.col("shared")).alias("far")))


def _bound(hot: DataFrame, live: DataFrame) -> DataFrame:
    """Hot memberships (sig, node, n, far, loose, rare, after) of the live sets that have too few units without hot signatures.

    ``after``: the most that the set can share with one whose first shared signature this is.
    """
    short = hot.groupBy("place").agg(F.count("*").alias("hot")).join(live, "place").where("hot > room")
    short = short.select("place", "n", "far", F.when(F.col("single"), F.greatest(F.col("n") - F.col("hot"), F.lit(0))).otherwise(0).alias("loose"), "single", "hot", (F.col("hot") - F.col("room")).alias("prefix"))
    own = hot.join(short, "place")
    own = own.join(hot.groupBy("sig").agg(F.count("*").alias("crowd")), "sig")
    rank = F.row_number().over(Window.partitionBy("place").orderBy("crowd", "sig"))
    return own.select("sig", F.col("place").bitwiseAND(-2).alias("node"), "n", "far", "loose", (rank <= F.col("prefix")).alias("rare"), F.when(F.col("single"), F.col("hot") - rank + 1).otherwise(F.col("n")).alias("after"))


def linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per document: the id, n_shingles and component_id (the smallest id reachable by links)."""
    docs = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    docs = docs.select(*row_key("__id", "__text"), "__id", "__text")
    kind = df.schema[id_col].dataType.simpleString()
    profile = stored(docs.mapInArrow(lean(_profile), f"k1 long, k2 long, __id {kind}, node long, more long, n long, bits binary, places array<int>, spare array<array<int>>, cost array<array<int>>"))
    plan, total = _allocation(profile)
    buckets = max(shuffle_partitions(df.sparkSession), total // PER_BUCKET)
    blocks = docs.select("__text").mapInArrow(lean(_emit(plan, buckets, hot)), "bucket int, sigs binary, nodes binary, counts binary, marks binary, hot binary")
    meets = stored(blocks.groupBy("bucket").applyInArrow(lean_group(_meet(hot)), "kind int, a long, b long"))
    # A node is 63 bits of a 128-bit hash of the set and stands for it.
    full = profile.where("n > 0")
    crowded = stored(meets.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("place")).distinct())
    live = _live(full, meets, crowded, plan)
    nodes = full.join(live.groupBy("node").agg(F.min("far").alias("far")), "node").groupBy("node", "more").agg(F.min(F.struct("k1", "k2")).alias("k"), F.first("n").alias("n"), F.first("far").alias("far"), F.first("bits").alias("bits"))
    nodes = stored(nodes.select("node", "k.k1", "k.k2", "n", "far", "bits").mapInArrow(lean(_folded), "node long, k1 long, k2 long, n long, far long, bits binary, fold array<long>"))
    bound = stored(_bound(crowded, live))
    centre = bound.groupBy("sig").agg(F.min(F.struct("loose", "n", "node")).getField("node").alias("a"))
    star = bound.join(centre, "sig").where("node <> a").select("a", F.col("node").alias("b"))
    pairs = stored(_sifted(meets.where("kind = 0").select("a", "b").union(star).distinct(), nodes))
    lead = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = _texts(docs, nodes, wanted)
    edges = _verified(lead, texts)
    label = components(edges)
    rest = stored(_apart(pairs.join(lead, ["a", "b"], "left_anti"), label).select("a", "b"))
    edges = edges.union(_verified(rest, texts))
    label = components(edges)
    held = _memberships(meets, bound, nodes)
    for candidates in (_stars, _across):
        done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = stored(_sifted(candidates(held, nodes, label).join(done, ["a", "b"], "left_anti"), nodes))
        if not found.isEmpty():
            more = found.select(F.col("a").alias("node")).union(found.select("b")).distinct().join(texts, "node", "left_anti")
            texts = texts.union(_texts(docs, nodes, more))
            edges = edges.union(_verified(found, texts))
            label = components(edges)
            pairs = pairs.union(found)
    named = full.select("__id", "node", "n").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("__id").alias("component_id"))
    out = named.join(smallest, "label").select("__id", "n", "component_id").union(profile.where("n = 0").select("__id", "n", F.col("__id").alias("component_id")))
    return out.select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text (node, __text) of each wanted node; few nodes are sent to the texts, many meet them in a shuffle."""
    own = stored(nodes.join(wanted, "node", "left_semi").select("k1", "k2", "node"))
    own = F.broadcast(own) if own.count() <= SMALL else own
    return stored(docs.join(own, ["k1", "k2"]).select("node", "__text").dropDuplicates(["node"]))


def _memberships(meets: DataFrame, bound: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sig, node, n, far, after) of the live sets in signatures with three sets or more, hot ones of the bound sets only."""
    few = meets.where("kind = 2").select(F.col("a").alias("sig"), F.col("b").alias("node")).join(nodes.select("node", "n", "far"), "node").select("sig", "node", "n", "far", F.col("n").alias("after"))
    return stored(few.union(bound.where("rare").select("sig", "node", "n", "far", "after")))


def _labelled(held: DataFrame, label: DataFrame) -> DataFrame:
    """The memberships of signatures whose sets are in different components, with each set's component."""
    held = held.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = held.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
    return stored(held.join(several, "sig", "left_semi"))


def _stars(held: DataFrame, nodes: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (a < b) of the first sets, in the order of nodes, of ``CENTRES`` components of a signature with the sets of others."""
    held = _labelled(held, label)
    first = held.groupBy("sig", "label").agg(F.min(F.struct("node", "n", "far")).alias("x"))
    centres = first.withColumn("at", F.row_number().over(Window.partitionBy("sig").orderBy("x"))).where(F.col("at") <= CENTRES).select("sig", F.col("label").alias("centre_label"), F.col("x.node").alias("centre"), F.col("x.n").alias("centre_n"), F.col("x.far").alias("centre_far"))
    near = (F.col("label") != F.col("centre_label")) & (NUM * F.least("n", "centre_n") >= DEN * F.greatest("n", "centre_n")) & ((NUM + DEN) * F.greatest("far", "centre_far") <= (NUM - DEN) * (F.col("n") + F.col("centre_n")))
    return held.join(centres, "sig").where(near).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _across(held: DataFrame, nodes: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (a < b) of sets that share a signature but are in different components, and are not too far apart."""
    held = _labelled(held, label)
    groups = held.groupBy("sig").agg(F.count("*").alias("m"), F.min(F.struct("n", "node")).getField("node").alias("centre"))
    # Signatures of one centre are one key where that makes fewer comparisons than each by itself.
    together = held.join(groups, "sig").groupBy("centre").agg(F.count_distinct("node").alias("g"), F.sum("m").alias("each")).where(F.col("g") * F.col("g") <= F.col("each")).select("centre", F.lit(True).alias("together"))
    keys = groups.join(together, "centre", "left").select("sig", F.coalesce("together", F.lit(False)).alias("together"), F.when(F.col("together"), F.col("centre")).otherwise(F.col("sig")).alias("key"))
    rows = held.join(keys, "sig").groupBy("together", "key", "node").agg(F.first("n").alias("n"), F.max("after").alias("after"), F.first("label").alias("label"))
    rows = stored(rows.join(nodes.select("node", "far", *_words()), "node"))
    names = [f"f{k}" for k in range(FOLD // 64)]
    one, two = (rows.select("together", "key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "n", "far", "after", *names)]) for x in "ab")
    apart = (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & ((NUM + DEN) * F.least("after_a", "after_b") >= DEN * (F.col("n_a") + F.col("n_b")))
    return one.join(two, ["together", "key"]).where(apart & _near()).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _words() -> list[Column]:
    return [F.col("fold")[k].alias(f"f{k}") for k in range(FOLD // 64)]


def _near() -> Column:
    """Whether the sets of columns with the endings _a and _b can be similar by size, by ``far`` and by ``FOLD`` parity bits."""
    most = (NUM - DEN) * (F.col("n_a") + F.col("n_b"))
    near = (NUM * F.least("n_a", "n_b") >= DEN * F.greatest("n_a", "n_b")) & ((NUM + DEN) * F.greatest("far_a", "far_b") <= most)
    for k in range(4, FOLD // 64 + 1, 4):  # by the first words, then by more of them: most pairs end early
        far = sum((F.bit_count(F.col(f"f{w}_a").bitwiseXOR(F.col(f"f{w}_b"))) for w in range(k)), F.lit(0))
        near &= (NUM + DEN) * far <= most
    return near


def _sifted(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that size and parity bitmaps allow, the short bitmaps first."""
    small, bits = nodes.select("node", "n", "far", *_words()), nodes.select("node", "bits")
    names = [f"f{k}" for k in range(FOLD // 64)]
    both = pairs.join(small.toDF("a", "n_a", "far_a", *[f"{c}_a" for c in names]), "a").join(small.toDF("b", "n_b", "far_b", *[f"{c}_b" for c in names]), "b").where(_near()).select("a", "b", "n_a", "n_b")
    both = both.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")
    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(lean(_sift), "a long, b long")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    both = pairs.join(label.toDF("a", "la"), "a", "left").join(label.toDF("b", "lb"), "b", "left")
    return both.where(F.coalesce("la", "a") != F.coalesce("lb", "b"))
