import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rankspark.llm import suffixes

SCHEMA = "doc_id long, text string, seg string"


def brute(texts, size):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + size] for r in raw for i in range(len(r) - size + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - size + 1):
            if seen[r[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_sort_is_the_suffix_order():
    rng = random.Random(5)
    for n in (1, 2, 30, 300):
        for alphabet in ("a", "ab", "abcdef"):
            text = "".join(rng.choice(alphabet) for _ in range(n)).encode() + b"\0"
            assert suffixes.sort_suffixes(np.frombuffer(text, np.uint8), 10**6).tolist() == sorted(range(n + 1), key=lambda i, t=text: t[i:])


@pytest.mark.parametrize("crowd", [256, 2])
def test_planted_cases_match_brute_force(spark, crowd):
    rng = random.Random(crowd)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    line, copy = noise(70), noise(700)
    texts = [None, "", "x", noise(199), noise(200), copy, copy, copy[:300] + noise(9) + copy[310:], "a" * 500, noise(90) + "b" * 260, "b" * 230 + noise(50), noise(4000)]
    texts += [noise(rng.randint(0, 90)) + line + noise(300) for _ in range(12)]
    texts += [noise(rng.randint(0, 90)) + line * 3 + noise(rng.randint(0, 90)) for _ in range(6)]
    texts += [copy[k : k + 230] + noise(30) for k in range(0, 60, 7)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(df, 100, gram=20, crowd=crowd).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 100)


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(300))
    df = spark.createDataFrame([(1, text, ""), (1, text, ""), (None, text[:250], None), (1, "other", None)], SCHEMA)
    got = sorted((tuple(r)[1:] for r in suffixes.remove_repeats(df, 200).collect()))
    assert got == sorted(brute([text, text, text[:250], "other"], 200))
    assert suffixes.remove_repeats(df.where("false"), 200).collect() == []


def test_documents_match_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = df.orderBy("doc_id").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(df, 200).collect()}
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows], 200)


def test_repeated_rows_and_large_keys(spark, monkeypatch):
    import random

    draw = random.Random(4)
    text = lambda n: "".join(draw.choices("abcdefghij ", k=n))
    same, part = text(900), text(400)
    rows = [(1, same, 1)] * 40 + [(2, part + text(300), 1), (2, text(200) + part, 1), (None, text(700), 1), (None, None, 1), (3, text(700), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    for limit in (32 << 20, 1):
        monkeypatch.setattr(suffixes, "KEY_BYTES", limit)
        got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(df, 200).collect())
        assert got == sorted([(0, 0, 0), (0, 700, 0), *[(1, 900, 900)] * 40, (2, 700, 400), (2, 600, 400), (3, 700, 0)])
    docs = df.where("doc_id = 1").selectExpr("1L AS k1", "2L AS k2", "cast(text AS binary) AS __text")
    (found,) = suffixes.repeated_runs(docs, 200).collect()
    assert sum(r["n"] for f in found.found for r in f["runs"]) == 701  # each window once, not once a pair of rows


def test_the_sort_takes_little_memory():
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(5000)]
    some = lambda k: " ".join(draw.choices(words, k=k))
    line = some(40)
    segments = [f"{some(30)} {line} {some(30)}".encode() for _ in range(1500)]
    tracemalloc.start()
    try:
        flags = suffixes.repeated_starts(segments, 200)
        most = tracemalloc.get_traced_memory()[1] / sum(map(len, segments))
    finally:
        tracemalloc.stop()
    assert [np.count_nonzero(f) >= len(line) - 199 for f in flags] == [True] * 1500
    assert most < 40  # bytes a byte
    assert most * suffixes.KEY_BYTES < 128 << 20  # of the largest key that is not split


def test_a_key_starts_a_new_sort_before_it_is_too_much(monkeypatch):
    draw = random.Random(9)
    calls, rows, sort = [], [], suffixes.repeated_starts
    monkeypatch.setattr(suffixes, "SORT_BYTES", 5000)
    monkeypatch.setattr(suffixes, "repeated_starts", lambda segments, size: calls.append(sum(map(len, segments))) or sort(segments, size))
    for key, m in enumerate([2, 4, 3, 11, 1, 2, 4]):  # segments of 900 bytes; one key alone has more than the limit
        part = bytes(draw.choices(range(97, 123), k=300))
        rows += [(key, b"%02d" % k, bytes(draw.choices(range(97, 123), k=300)) + part + bytes(draw.choices(range(97, 123), k=300)), 1, False) for k in range(m)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("key", "seg_id", "seg", "copies", "twice"), r, strict=True)) for r in rows])
    got = {(r["key"], r["seg_id"]): sum(x["n"] for x in r["runs"]) for b in suffixes._sort_groups(200)(iter([batch.slice(0, 7), batch.slice(7)])) for r in b.to_pylist()}
    assert got.keys() == {r[:2] for r in rows if r[0] != 4} and min(got.values()) >= 101
    assert calls == [1800, 3600, 2700, 9900, 1800, 3600]
