import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankspark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain():
    return Tokenizer.from_file(PATH)


def test_strings_of_added_tokens_are_the_tokens(spark):
    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|><|endoftext|>", 3: "x<|endoftext| >y <|endoftext", 4: "word " * 3000 + "<|endoftext|>tail's", 5: None, 6: " <|endoftext|>\n \n<|endoftext|>  é漢"}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH, public_tokenizers.PATTERN).collect()
    check(rows, texts, 2048)
    assert plain().encode("a <|endoftext|> b", add_special_tokens=False).ids[2] not in (1279, 27)


def check(rows, texts, capacity):
    t, pieces = plain(), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == texts.keys()
    used = defaultdict(list)
    for i, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(ids) and own[0].start == 0
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            used[r.sequence_id].append((r.offset, r.length))
        assert all(r.length == capacity for r in own[1:])
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "a" * 9000, None), (-4, "  x\n\n y<|endoftext|> 漢字", "z")], "doc_id long, text string, lang string"))
    rows = packing.pack(df, PATH, public_tokenizers.PATTERN).collect()
    n = check(rows, {r.doc_id: r.text for r in df.collect()}, 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 2
    assert packing.pack(df.where("false"), PATH, public_tokenizers.PATTERN).collect() == []


def test_many_tasks_leave_little_room(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(64, "doc_id")
    rows = packing.pack(df, PATH, public_tokenizers.PATTERN).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("places"), F.count("*").alias("pieces")).collect()
    least = -(-sum(r.n for r in rows) // 2048)
    assert all(r.n == r.end <= 2048 and r.places == r.pieces for r in rows) and len(rows) <= 1.01 * least, (len(rows), least)


class PlainBins:
    """Best fit by looking at every open bin."""

    def __init__(self, capacity, most):
        self.capacity, self.most, self.open, self.n = capacity, most, [], 0

    def put(self, length):
        fit = [b for b in self.open if b[1] >= length]
        if fit:
            least = min(b[1] for b in fit)
            own = [b for b in fit if b[1] == least][-1]
            self.open.remove(own)
        else:
            if len(self.open) == self.most:
                least = min(b[1] for b in self.open)
                self.open.remove([b for b in self.open if b[1] == least][-1])
            own = (self.n, self.capacity)
            self.n += 1
        if own[1] > length:
            self.open.append((own[0], own[1] - length))
        return own[0], self.capacity - own[1]


def test_bins_equal_plain_best_fit():
    draw = np.random.default_rng(2)
    for capacity, most in ((10, 1), (10, 3), (50, 4), (2048, 32)):
        fast, plain_bins = packing.OpenBins(capacity, most), PlainBins(capacity, most)
        for n in draw.integers(1, capacity + 1, 3000).tolist():
            assert fast.put(n) == plain_bins.put(n)


def test_query_rows_in_order_equal_plain_best_fit(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").coalesce(1)
    bins, closed = PlainBins(2048, packing.OPEN_BINS), 0
    for r in packing.pack_in_tasks(df, PATH, public_tokenizers.PATTERN).collect():
        closed += len(bins.open) == bins.most and all(b[1] < r.length for b in bins.open)
        assert (r.sequence_id, r.offset) == bins.put(r.length)
    assert closed > 0  # bins are closed by force


def test_large_and_null_ids_stay(spark):
    rows = [(2**60 + 1, "a b"), (None, "c"), (None, None), (2**60 + 1, "a b")]
    got = packing.pack(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, piece int"), PATH, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 2**60 + 1, 2**60 + 1]


def test_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 5, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]
    assert bins.put(5) == (2, 5)


def test_cuts():
    assert packing.cut_pieces(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut_pieces(4, 4) == [(0, 4)]
    assert packing.cut_pieces(1, 4) == [(0, 1)]


def test_fast_split_is_the_pattern():
    import random

    import regex

    from rankspark.llm.common import SPLIT, Splitter

    assert SPLIT == public_tokenizers.PATTERN
    split, exact, rng = Splitter(SPLIT), regex.compile(SPLIT), random.Random(4)
    signs = [*" \n\t\x1c\x0b　'stremvlld_9aé漢²Ⅷ٣🙂-​"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        assert split(text) == exact.findall(text)
    assert split.odd("plain text, é 12") is None


def test_a_worker_forgets_all_but_the_pieces_at_hand(monkeypatch):
    import public_tokenizers

    from rankspark.llm import packing as step

    assert step.REMEMBERED <= 250_000  # a worker keeps them through the steps after this one
    monkeypatch.setattr(step, "REMEMBERED", 3)
    tok = step.CachedTokenizer(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    learned, learn = [], tok._learn
    monkeypatch.setattr(tok, "_learn", lambda pieces: learned.append(sorted(pieces)) or learn(pieces))
    texts = ["alpha beta gamma delta", "beta gamma new", "other words"]
    got = [tok.encode_bytes([t])[0] for t in texts]
    assert got == [np.array(tok.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert learned[1] == [" new", "beta"] and " alpha" not in tok.known


def test_starts_of_pieces_are_those_of_the_pattern():
    import random

    import regex

    from rankspark.llm.common import SPLIT, piece_starts

    exact, rng = regex.compile(SPLIT).findall, random.Random(7)
    signs = [*" \n\t\x1c\x0b\x85\u3000'stremvlld_9aé漢²Ⅷ٣🙂𝐀-​﻿", "  ", "'s", "'ll"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for part in ([], [""], ["", " ", "", "'", "s"], texts):
        raw = [t.encode() for t in part]
        data = b"".join(raw)
        starts = piece_starts(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, raw)])).tolist()
        assert [data[a:b].decode() for a, b in zip(starts, [*starts[1:], len(data)], strict=False)] == [p for t in part for p in exact(t)]


def test_pieces_met_again_are_learned_once(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 8)
    tok = packing.CachedTokenizer(PATH, public_tokenizers.PATTERN)
    learned, learn = [], tok._learn
    monkeypatch.setattr(tok, "_learn", lambda pieces: learned.extend(pieces) or learn(pieces))
    for k in range(12):
        common = " common words" if k != 5 else ""
        text = f"{common} only{'abcdefghijkl'[k] * 3} once{'abcdefghijkl'[k] * 3} l'été\n\n {k}"
        assert tok.encode_bytes([text, ""]) == [np.array(plain().encode(text, add_special_tokens=False).ids, "<u4").tobytes(), b""]
    assert learned.count(" common") == learned.count(" words") == 1
    assert len(tok.known) < 20


def test_workers_forget_the_pieces_in_other_steps():
    from rankspark.llm.common import lean

    packing._tokenizer(PATH, public_tokenizers.PATTERN)
    assert list(lean(lambda batches: (b for b in batches), "packing")([1, 2])) == [1, 2] and packing._tokenizer.cache_info().currsize
    assert list(lean(lambda batches: (b for b in batches))([1, 2])) == [1, 2] and not packing._tokenizer.cache_info().currsize
