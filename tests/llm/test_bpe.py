import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rankspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.Bpe.read(PATH, public_tokenizers.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text_as_tiktoken_and_back(text):
    (ids,) = OURS.encode([text])
    assert ids.tolist() == TIKTOKEN.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


def test_long_pieces():
    rng = random.Random(1)
    for text in ("a" * 5000, "".join(rng.choice("abcdefghé") for _ in range(4000)), " " * 3000 + "x", "=" * 1000):
        assert OURS.encode([text])[0].tolist() == TIKTOKEN.encode_ordinary(text)


def test_matrix_and_heap_agree():
    rng = random.Random(2)
    pieces = ["".join(rng.choice("theandrstion") for _ in range(rng.randint(1, 200))).encode() for _ in range(200)]
    assert [x.tolist() for x in OURS.encode_pieces(pieces)] == [OURS._alone(p).tolist() for p in pieces]


def test_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    got = {r.doc_id: r for r in bpe.encode_decode(df, PATH, public_tokenizers.PATTERN).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = TIKTOKEN.encode_ordinary(text)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encode_decode(df.where("false"), PATH, public_tokenizers.PATTERN).collect() == []
