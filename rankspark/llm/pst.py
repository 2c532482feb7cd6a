"""Language-model scores by a probabilistic suffix tree over words (operator 4).

Symbols are a text's lower-cased words and one end. A state is a context of up to ``DEPTH`` symbols; the root is the
add-one unigram distribution over all learned symbols. A gram of symbols is an entry of its state if it occurs at least
``LEAST`` times in all learning texts, at every depth and size, so a larger corpus gives more states; a deeper gram can
only be an entry if both shorter ones are. A state stays if its next-symbol distribution diverges from its suffix's by
more than a penalty for its entries (half the logarithm of its count for each); suffixes of states that stay, stay.
Entries are discounted; the mass left goes to the suffix's distribution over all other symbols, so that every state
sums to one. A symbol is scored from the longest suffix that is a state.

No table is broadcast or collected. A chunk of texts sends each different word once to its word's bucket, with its
learning count, and gets the corpus count and a symbol back; then it sends each different (context, symbol) once to the
bucket of the context's last symbol, where that symbol's states of all depths are counted, tested and used, and gets
the scores back, in single precision; to keep little on disk, a chunk lists its contexts once to send them and once more
to add up the scores. ``learn`` makes the same tree in memory, for small corpora; a test holds the two equal.

Defined results: null text is the empty text (one token, the end); with nothing to learn from every probability is 1
of the one unknown symbol. Null and repeated ids are ids like others, one row each, and repeated rows of the learning part
count as often as they stand there; equal texts have equal scores up to rounding; a long text is scored whole; other
columns are left out; no row gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import as_words, dropped, mix, shuffle_partitions, slices, stored, stored_by

DEPTH = 2
#: Occurrences in the learning texts from which a word is a symbol of its own and a gram an entry.
LEAST = 2
DISCOUNT = 0.5
#: Bytes of text in a chunk.
CHUNK = 12 << 20
#: The end of a text as a word (no text has it) and as a symbol; symbol 0 stands for words that are no entries.
END_WORD, END, RARE = "\n", 1, 0

CODEC = pa.Codec("zstd", compression_level=5)
_BITS = 20
_U = np.uint64
_NONE = np.uint32((1 << 32) - 1)
NAMES = ["kind", "chunk", "bucket", "words", "numbers", "id", "learned"]
_SENT = ["chunk", "bucket", "last", "first", "symbol", "n", "own", "own_count"]
#: Contexts that a task scores at once, but for those of one symbol.
PIECE = 1 << 19


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Model:
    """Frequent words with their counts, and for each depth the states and entries, sorted by code."""

    def __init__(self, words: list[str], counts: np.ndarray, tokens: int, types: int):
        self.words = pa.array(words, pa.string())
        self.root = np.concatenate([[0.0, 0.0], counts]) + 1.0
        self.count = np.concatenate([[0], [0], counts])
        if words and (at := self.words.index(END_WORD).as_py()) >= 0:
            self.root[END], self.count[END] = self.root[at + 2], self.count[at + 2]
        self.tokens, self.size = tokens, tokens + types + 1.0
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []  # all grams of a depth with their counts
        self.states: list[tuple[np.ndarray, np.ndarray]] = []
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []
        self.stay: list[np.ndarray] = []
        self._above: np.ndarray | None = None

    def symbols(self, words: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, each after an END and followed by one, and which places are scored."""
        coded = words.dictionary_encode()
        found = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -2).to_numpy() + 2
        own = found[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
        n = np.diff(offsets)
        out = np.full(int(n.sum()) + 2 * len(n), END, np.int64)
        scored = np.ones(len(out), bool)
        start = np.cumsum(n + 2) - n - 2
        scored[start] = False
        inner = scored.copy()
        inner[start + n + 1] = False
        out[inner] = own
        return out, scored

    def codes(self, symbols: np.ndarray, scored: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Gram codes of scored places and whether the context is whole and frequent (none reaches past its text)."""
        code = symbols.astype(_U)
        ok = scored.copy()
        back = np.arange(len(symbols))
        for k in range(1, depth + 1):
            moved = np.concatenate([np.zeros(k, np.int64), symbols[:-k]])
            ok &= moved != RARE
            if k > 1:  # the symbol before must not be the END with which the text begins
                ok &= np.concatenate([np.zeros(k - 1, bool), scored[: -(k - 1)]])
            code |= moved.astype(_U) << _U(_BITS * k)
        return code[scored], ok[scored] & (back[scored] >= depth)

    def add_depth(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Take the counted grams of the next depth."""
        order = np.argsort(codes)
        codes, counts, d = codes[order].astype(_U), counts[order].astype(np.float64), len(self.grams) + 1
        context = codes >> _U(_BITS)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(codes) else np.empty(0, np.int64)
        size = np.diff(np.concatenate([first, [len(codes)]]))
        if d == 1:
            total = self.count[context[first].astype(np.int64)].astype(np.float64)
            suffix = self.root[(codes & _U((1 << _BITS) - 1)).astype(np.int64)] / self.size
        else:
            total = self.grams[-1][1][_find(self.grams[-1][0], context[first])[0]]
            suffix = self._above[_find(self.grams[-1][0], codes & _U((1 << _BITS * d) - 1))[0]]
        p = (counts - DISCOUNT) / np.repeat(total, size)
        sums = lambda x: np.add.reduceat(x, first) if len(first) else np.empty(0)
        left, over = 1 - sums(p), 1 - sums(suffix)
        rest = np.maximum(left, 1e-9) / np.maximum(over, 1e-9)
        gain = sums(counts * np.log(p / suffix)) + (total - sums(counts)) * np.log(rest)
        self.grams.append((codes, counts))
        self._above = p
        self.entries.append((codes, np.log10(p)))
        self.states.append((context[first], np.log10(rest)))
        self.stay.append(gain > 0.5 * (size + 1) * np.log(np.maximum(total, 2)))

    def close(self) -> Model:
        """Keep the states that diverge and their suffixes."""
        for d in range(len(self.states) - 1, 0, -1):
            kept = self.states[d][0][self.stay[d]] & _U((1 << _BITS * d) - 1)
            self.stay[d - 1] |= np.isin(self.states[d - 1][0], kept)
        for d, stay in enumerate(self.stay):
            context, rest = self.states[d]
            self.states[d] = context[stay], rest[stay]
            code, p = self.entries[d]
            own = np.isin(code >> _U(_BITS), context[stay])
            self.entries[d] = code[own], p[own]
        self.grams, self._above = [], None
        return self

    def score(self, symbols: np.ndarray, scored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each scored place without the root's part, and which places the root ends."""
        n = int(scored.sum())
        out, open_ = np.zeros(n), np.ones(n, bool)
        for d in range(len(self.states), 0, -1):
            code, ok = self.codes(symbols, scored, d)
            at = np.flatnonzero(open_ & ok)
            place, known = _find(self.states[d - 1][0], code[at] >> _U(_BITS))
            at, place = at[known], place[known]
            entry, hit = _find(self.entries[d - 1][0], code[at])
            out[at[hit]] += self.entries[d - 1][1][entry[hit]]
            open_[at[hit]] = False
            out[at[~hit]] += self.states[d - 1][1][place[~hit]]
        return out, open_


def _by_bucket(names: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The order of words by bucket, the bounds of each bucket and the buckets that have words."""
    at = np.fromiter(map(xxhash.xxh3_64_intdigest, names.to_pylist()), np.uint64, len(names)) % _U(buckets)
    edge = np.searchsorted(np.sort(at), np.arange(buckets + 1).astype(_U))
    return np.argsort(at, kind="stable"), edge, [k for k in range(buckets) if edge[k] < edge[k + 1]]


def _blocks(names: pa.Array, counts: np.ndarray, order: np.ndarray, edge: np.ndarray, own: list[int]) -> list[pa.Array]:
    cuts = pa.array([*(edge[k] for k in own), edge[own[-1] + 1]], pa.int32())
    return [pa.array(own, pa.int32()), pa.ListArray.from_arrays(cuts, names.take(pa.array(order))), pa.array([counts[order[edge[k] : edge[k + 1]]].astype("<i8").tobytes() for k in own], pa.binary())]


def _word_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", CHUNK):
            words = as_words(b.column("__text"))[1]
            coded = words.dictionary_encode()
            names = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END_WORD])])
            counts = np.append(np.bincount(coded.indices.to_numpy(), minlength=len(names) - 1), b.num_rows)
            yield pa.RecordBatch.from_arrays(_blocks(names, counts, *_by_bucket(names, buckets)), ["bucket", "words", "numbers"])

    return run


def _summed(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Different words of a bucket, their sums, which word each sent place has, and where each block stops."""
    words = pa.concat_arrays([c.flatten() for c in table.column("words").chunks])
    coded = words.dictionary_encode()
    sent = [np.frombuffer(x, "<i8") for x in table.column("numbers").to_pylist()]
    at = coded.indices.to_numpy()
    return coded.dictionary, np.bincount(at, np.concatenate(sent), len(coded.dictionary)).astype("<i8"), at, np.cumsum([len(x) for x in sent])


def _frequent(key: tuple, table: pa.Table) -> pa.Table:
    """Words of a bucket that occur twice or more; a row without a word has the tokens and the different words."""
    names, total, _, _ = _summed(table)
    often = np.flatnonzero(total > 1)
    return pa.table({"word": pa.concat_arrays([pa.nulls(1, pa.string()), names.take(pa.array(often)).cast(pa.string())]), "n": np.concatenate([[total.sum()], total[often]]).astype(np.int64), "types": np.concatenate([[np.count_nonzero(total)], np.zeros(len(often))]).astype(np.int64)})


def _grams(model, depth: int):
    """Counts of the task's grams of ``depth`` + 1 frequent symbols whose shorter grams are entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = model.value
        codes, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for b in slices(batches, "__text"):
            offsets, words = as_words(b.column("__text"))
            code, ok = tree.codes(*tree.symbols(words, offsets), depth)
            code = code[ok & (code & _U((1 << _BITS) - 1) != RARE)]
            if depth > 1:
                known = tree.grams[-1][0]
                code = code[_find(known, code >> _U(_BITS))[1] & _find(known, code & _U((1 << _BITS * depth) - 1))[1]]
            own, n = np.unique(code, return_counts=True)
            codes, back = np.unique(np.concatenate([codes, own]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        for a in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[a : a + 100_000].view(np.int64)), pa.array(counts[a : a + 100_000])], ["code", "n"])

    return run


def learn(texts: DataFrame, least: int = LEAST) -> Model:
    """The model of all rows of ``texts`` (column __text) in the driver's memory; queries score without it."""
    spark = texts.sparkSession
    blocks = texts.select("__text").mapInArrow(_word_counts(shuffle_partitions(spark)), "bucket int, words array<string>, numbers binary")
    found = stored(blocks.groupBy("bucket").applyInArrow(_frequent, "word string, n long, types long"))
    sums = found.where("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    often = found.where(F.col("word").isNotNull() & (F.col("n") >= least)).select("word", "n").toArrow()
    if often.num_rows + 2 > 1 << _BITS:
        raise ValueError("too many words for a model in memory; use score_texts")
    model = Model(often.column("word").to_pylist(), often.column("n").to_numpy(), sums.n, sums.v)
    for d in range(1, DEPTH + 1):
        sent = spark.sparkContext.broadcast(model)
        grams = texts.select("__text").mapInArrow(_grams(sent, d), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
        if not grams.num_rows:
            break
        model.add_depth(grams.column("code").to_numpy(), grams.column("n").to_numpy())
    return model.close()


def _chunks(buckets: int):
    """Rows of kind 0 (chunk, bucket, words, counts) and of kind 1 (chunk; for each text its word numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in enumerate(slices(batches, "__text", CHUNK)):
            chunk = TaskContext.get().partitionId() << 24 | number
            learned = b.column("learn").to_numpy(zero_copy_only=False)
            offsets, words = as_words(b.column("__text"))
            tokens = np.diff(offsets) + 1
            stops = np.cumsum(tokens)
            coded = words.dictionary_encode()
            names = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END_WORD])])
            end = len(names) - 1
            numbers = np.full(int(stops[-1]), end, np.int64)
            inner = np.ones(len(numbers), bool)
            inner[stops - 1] = False
            numbers[inner] = coded.indices.to_numpy()
            counts = np.bincount(numbers, np.repeat(learned, tokens).astype(np.float64), end + 1).astype(np.int64)
            order, edge, own = _by_bucket(names, buckets)
            rank = np.empty(end + 1, "<u4")
            rank[order] = np.arange(end + 1)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(own), pa.int32()), pa.array([chunk] * len(own), pa.int64()), *_blocks(names, counts, order, edge, own), *(pa.nulls(len(own), t) for t in (b.schema.field(0).type, pa.bool_()))], NAMES)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.string())), _cut(rank[numbers], stops), b.column(0), pa.array(learned)], NAMES)

    return run


def _packed(values: np.ndarray) -> bytes:
    """The number of values, then their bytes, compressed plane by plane; blocks are most of what is stored and shuffled."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(4, "little") + CODEC.compress(planes, asbytes=True)


def _length(raw: bytes) -> int:
    return int.from_bytes(raw[:4], "little")


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = pa.decompress(memoryview(raw)[4:], decompressed_size=_length(raw) * size, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _cut(values: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The packed values, cut at the stops."""
    return pa.array([_packed(values[x:y]) for x, y in zip([0, *stops], stops, strict=False)], pa.binary())


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(_unpacked(raw, kind) for raw in column.to_pylist())])


def _total(buckets: int, least: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Corpus counts and symbols of a bucket's words, in the order in which each chunk sent them; chunk -1 has the sums."""
        names, total, at, stops = _summed(table)
        often = total >= least
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))  # frequent words have small symbols, which pack well
        symbol = np.where(often, 2 + key[0].as_py() + buckets * rank, RARE)
        if symbol.max() >= 1 << 32:
            raise ValueError("more than 2**32 symbols")
        if (end := names.index(END_WORD).as_py()) >= 0:
            symbol[end] = END
        out = pa.table({"chunk": table.column("chunk").combine_chunks(), "bucket": table.column("bucket").combine_chunks(), "counts": _cut(total[at], stops), "symbols": _cut(symbol.astype("<u4")[at], stops), "tokens": pa.nulls(len(stops), pa.int64()), "types": pa.nulls(len(stops), pa.int64())})
        sums = {"chunk": [-1], "bucket": [key[0].as_py()], "counts": [None], "symbols": [None], "tokens": [int(total.sum())], "types": [int(np.count_nonzero(total))]}
        return pa.concat_tables([out, pa.Table.from_pydict(sums, schema=out.schema)])

    return run


def _ranked(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of 32-bit numbers in order, as two arrays, and which pair each place has."""
    code, at = np.unique(high.astype(_U) << _U(32) | low.astype(_U), return_inverse=True)
    return (code >> _U(32)).astype(np.int64), (code & _U(_NONE)).astype(np.int64), at


def _place(texts: pa.Table, told: pa.Table, buckets: int, floor: float):
    """A chunk's different (last, first, symbol) by bucket with their learning counts, and what each text makes of them.

    The order of the contexts does not hang on the order of the texts, so both steps that need it compute it alike.
    """
    told = told.sort_by("bucket")
    count, symbols = _joined(told.column("counts"), "<i8"), _joined(told.column("symbols"), "<u4").astype(np.int64)
    number = _joined(texts.column("numbers"), "<u4")
    tokens = np.array([_length(x) for x in texts.column("numbers").to_pylist()])
    start = np.cumsum(tokens) - tokens
    w, weight = symbols[number], (np.log10(count + 1.0) - floor)[number]
    last = np.concatenate([[0], w[:-1]])
    last[start] = END
    first = np.concatenate([[0], last[:-1]])
    first[start] = RARE  # nothing stands before the first END
    some = last != RARE
    learned = np.repeat(texts.column("learned").to_numpy(), tokens)
    a, b, at = _ranked(last[some], first[some])
    pair, c, at = _ranked(at, w[some])
    n = np.bincount(at, learned[some].astype(np.float64), len(pair))
    a, b = a[pair], b[pair]
    bucket = (mix(a.astype(_U)) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sums = lambda x: np.add.reduceat(x, start)
    fixed = sums(np.where(some & (w != RARE), 0.0, weight))
    return (a[order], b[order], c[order], n[order], bucket[order]), (count, symbols), (some, place[at], start), (tokens, sums((count[number] > 0).astype(np.int64)), sums(weight), fixed)


def _contexts(buckets: int, floor: float):
    def run(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        """The chunk's different contexts and symbols, one row a bucket."""
        (a, b, c, n, bucket), (count, symbols), _, _ = _place(texts, told, buckets, floor)
        own = np.unique(bucket)
        stops = np.searchsorted(bucket, own, side="right")
        known = np.argsort(symbols, kind="stable")
        names, numbers = [], []
        for x, y in zip([0, *stops], stops, strict=False):
            u = np.unique(c[x:y])
            u = u[u != RARE]
            names.append(_packed(u.astype("<u4")))
            numbers.append(_packed(count[known[np.searchsorted(symbols, u, sorter=known)]]))
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(own), pa.int64()), pa.array(own, pa.int32()), *(_cut(x.astype("<u4"), stops) for x in (a, b, c, n)), pa.array(names, pa.binary()), pa.array(numbers, pa.binary())], _SENT)

    return run


def _states(context: np.ndarray, size: int, total: np.ndarray, n: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of the entries (``context`` is the place of each one's state), log10 of each state's rest, which diverge."""
    p = (n - DISCOUNT) / total[context]
    sums = lambda x: np.bincount(context, x, size)
    entries = np.bincount(context, minlength=size)
    rest = np.maximum(1 - sums(p), 1e-9) / np.maximum(1 - sums(suffix), 1e-9)
    gain = sums(n * np.log(p / suffix)) + (total - sums(n)) * np.log(rest)
    return np.log10(p), np.log10(rest), (entries > 0) & (gain > 0.5 * (entries + 1) * np.log(np.maximum(total, 2)))


def _scored(last: np.ndarray, first: np.ndarray, symbol: np.ndarray, sent: np.ndarray, name: np.ndarray, root: np.ndarray, least: int) -> np.ndarray:
    """Scores of contexts and symbols; all places of a last symbol are there."""
    last, first, at = _ranked(last, first)
    two, symbol, back = _ranked(at, symbol)
    n = np.bincount(back, sent.astype(np.float64), len(two))
    state, one = np.unique(last, return_inverse=True)  # depth 1: states, and the state of each longer context
    _, word, gram = _ranked(one[two], symbol)
    own = one[two]
    n1 = np.bincount(gram, n, len(word))
    of = np.empty(len(word), np.int64)
    of[gram] = own
    total1, total2 = np.bincount(own, n, len(state)), np.bincount(two, n, len(last))
    entry1 = (word != RARE) & (n1 >= least)
    entry2 = (first[two] != RARE) & (symbol != RARE) & (n >= least)
    p1, p2, base = np.zeros(len(word)), np.zeros(len(two)), np.ones(len(word))
    real = word != RARE
    base[real] = root[np.searchsorted(name, word[real])]
    p1[entry1], rest1, stay1 = _states(of[entry1], len(state), total1, n1[entry1], base[entry1])
    p2[entry2], rest2, stay2 = _states(two[entry2], len(last), total2, n[entry2], 10 ** p1[gram[entry2]])
    stay1[one[stay2]] = True
    # From the longest state down: an entry ends the symbol, else the state's rest is added.
    deep, flat = stay2[two], stay1[own]
    out = np.where(deep, np.where(entry2, p2, rest2[two]), 0.0)
    open_ = ~(deep & entry2)
    hit = entry1[gram]
    out += np.where(open_ & flat, np.where(hit, p1[gram], rest1[own]), 0.0)
    open_ &= ~(flat & hit)
    out += np.where(open_, np.log10(base)[gram], 0.0)  # a rare symbol's root is in its text's fixed part
    return out[back].astype("<f4")


def _scores(size: float, least: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Scores of the bucket's contexts and symbols, in the order in which each chunk sent them."""
        last, first, symbol, n = (_joined(table.column(x), "<u4") for x in ("last", "first", "symbol", "n"))
        stops = np.cumsum([_length(x) for x in table.column("n").to_pylist()])
        name, once = np.unique(_joined(table.column("own"), "<u4"), return_index=True)
        root = (_joined(table.column("own_count"), "<i8")[once] + 1.0) / size
        order = np.argsort(last, kind="stable")
        edges = np.flatnonzero(np.diff(last[order])) + 1
        out, a = np.empty(len(last), "<f4"), 0
        while a < len(order):  # whole symbols, ``PIECE`` places or more of them at a time
            later = np.searchsorted(edges, a + PIECE)
            z = int(edges[later]) if later < len(edges) else len(order)
            at = order[a:z]
            out[at] = _scored(last[at], first[at], symbol[at], n[at], name, root, least)
            a = z
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "scores": _cut(out, stops)})

    return run


def _finish(buckets: int, floor: float):
    def run(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        """The whole score of each text of a chunk, from its words' and its contexts' rows."""
        back = pc.is_valid(told.column("scores"))
        value = _joined(told.filter(back).sort_by("bucket").column("scores"), "<f4").astype(float)
        _, _, (some, place, start), (tokens, known, base, fixed) = _place(texts, told.filter(pc.invert(back)), buckets, floor)
        each = np.zeros(int(tokens.sum()))
        each[some] = value[place]
        return pa.table({"id": texts.column("id"), "learned": texts.column("learned"), "n_tokens": tokens.astype(np.int64), "n_known": known.astype(np.int64), "base_score": base, "score": fixed + np.add.reduceat(each, start)})

    return run


def score_texts(df: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row: the id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = df.sparkSession
    kind, buckets = df.schema[id_col].dataType.simpleString(), shuffle_partitions(spark)
    docs = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.coalesce(learn_from, F.lit(False)).alias("learn"))
    rows, rows_at = stored_by(docs.mapInArrow(_chunks(buckets), f"kind int, chunk long, bucket int, words array<string>, numbers binary, id {kind}, learned boolean"), "kind")
    told, told_at = stored_by(rows.where("kind = 0").select("chunk", "bucket", "words", "numbers").groupBy("bucket").applyInArrow(_total(buckets, least), "chunk long, bucket int, counts binary, symbols binary, tokens long, types long"))
    dropped(spark, f"{rows_at}/kind=0")
    sums = told.where("chunk < 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    size = sums.n + sums.v + 1.0
    texts = rows.where("kind = 1").select("chunk", "id", "learned", "numbers")
    words = told.where("chunk >= 0").select("chunk", "bucket", "counts", "symbols")
    floor = float(np.log10(size))
    contexts = texts.select("chunk", "learned", "numbers").groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(_contexts(buckets, floor), "chunk long, bucket int, last binary, first binary, symbol binary, n binary, own binary, own_count binary")
    scores = stored(contexts.groupBy("bucket").applyInArrow(_scores(size, least), "chunk long, bucket int, scores binary"))
    both = words.withColumn("scores", F.lit(None).cast("binary")).unionByName(scores, allowMissingColumns=True)
    out = texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(_finish(buckets, floor), f"id {kind}, learned boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", F.lit(int(sums.n)).cast("long").alias("train_tokens"), "base_score", "score")
