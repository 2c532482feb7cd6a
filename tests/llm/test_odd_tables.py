"""Odd rows for operators whose docstrings promise a result: clashing columns, null and repeated ids, long texts, no rows."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rankspark.llm import bpe, chroma, jaccard, pst, quality, suffixes

LONG = " ".join(random.Random(8).choices(["stone", "river", "cloud", "seven", "lamp", "of", "the"], k=60_000))
ROWS = [(1, LONG), (2, LONG), (3, None), (4, ""), (5, " \n\t"), (5, " \n\t"), (None, "three short words"), (None, None), (7, "three short words")]


@pytest.fixture(scope="module")
def docs(spark):
    """Columns that have the names of the operators' results and of their inner columns."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    names = ["n_tokens", "ids_sha256", "held_out", "score", "n_bytes", "kept_sha256", "found", "n_shingles", "component_id", "node", "label", "n_words", "kept", "stratum", "id", "same", "k1", "learn"]
    return df.select("*", F.lit("en").alias("lang"), *[F.lit("clash").alias(n) for n in names])


def test_encoding(docs):
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = sorted((r.doc_id or 0, r.n_tokens == 0, r.decoded_sha256) for r in out.collect())
    assert got == sorted((i or 0, not t, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe.encode_decode(docs.where("false"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect() == []


def test_language_model(docs):
    out = pst.score_texts(docs, F.col("doc_id") == 1)
    got = sorted(((r.doc_id or 0, r.n_tokens, r.n_known, r.held_out) for r in out.collect()))
    assert got == sorted([(1, 60_001, 60_001, False), (2, 60_001, 60_001, True), *[(i, 1, 1, True) for i in (3, 4, 5, 5, 0)], (0, 4, 1, True), (7, 4, 1, True)])
    same = {r.score for r in out.where("doc_id IN (1, 2)").collect()}
    assert max(same) - min(same) < 1e-6 * abs(max(same)) and {r.train_tokens for r in out.collect()} == {60_001}
    assert pst.score_texts(docs.where("false"), F.lit(True)).collect() == []


def test_repeats(docs):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(docs, 200).collect())
    assert got == sorted((i or 0, len(t or ""), len(LONG) if t == LONG else 0, int(t == LONG)) for i, t in ROWS)


def test_similar_sets(docs):
    out = jaccard.linked(docs).collect()
    assert len(out) == len(ROWS)
    got = {(r.doc_id, r.n_shingles > 0, r.component_id) for r in out if r.doc_id is not None}
    assert got == {(1, True, 1), (2, True, 1), (3, False, 3), (4, False, 4), (5, False, 5), (7, True, 7)}
    assert sorted((r.n_shingles, r.component_id or 0) for r in out if r.doc_id is None) == [(0, 0), (1, 7)]
    assert jaccard.linked(docs.where("false")).collect() == []


def test_rules(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (99, 1)], "doc_id long, quality int").withColumn("n_words", F.lit("clash"))
    got = sorted((r.doc_id or 0, r.n_words, r.kept) for r in quality.judge(docs, labels).collect())
    assert got == sorted((i or 0, len((t or "").split()), False) for i, t in ROWS)  # the long text repeats most of its words
    assert quality.judge(docs.where("false"), labels).collect() == [] and quality.judge(docs, labels.where("false")).count() == len(ROWS)


def test_recordings(spark):
    sound = bytes(random.Random(1).randbytes(64_000))
    df = spark.createDataFrame([(1, sound), (1, sound), (None, sound), (2, None), (3, b""), (4, b"\x01")], "rec long, audio binary").withColumn("prints", F.lit("clash")).withColumn("frames", F.lit("clash"))
    out = chroma.audio_fingerprints(df, "rec", "audio", 8000)
    assert {r.rec: bool(r.prints) for r in out.collect()} == {1: True, None: True, 2: False, 3: False, 4: False}
    assert chroma.audio_fingerprints(df.where("false"), "rec", "audio", 8000).collect() == []
