import base64
import random
import string
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from rankspark.llm.common import stored


def test_run_drops_copies_and_keeps_clean_documents(spark, tmp_path):
    draw = random.Random(5)
    words = {lang: ["".join(draw.choices(letters, k=draw.randint(3, 8))) for _ in range(400)] for lang, letters in (("aa", "abcdefgh"), ("bb", "nopqrstu"))}
    texts = [" ".join(draw.choices(words["aa" if i % 2 else "bb"], k=80)) for i in range(40)]
    near = texts[4].split(" ")
    near[40] = "otherword"
    rows = [(i, t, "aa" if i % 2 else "bb", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(103, texts[3], "aa", "s", 1), (104, " ".join(near), None, None, None), (105, None, "aa", "s", None), (106, "12345 !!!", None, "s", 9), (107, "", "bb", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(40))
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_near_duplicates_keep_rows_without_an_id(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "aa", "s", 1), (2, text, "aa", "s", 1), (None, "own " + text[:90], "aa", "s", 1), (None, text, "aa", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert len(got) == 3 and got.count(None) == 2 and got.count(1) == 1


def test_language_stage_rejects_gibberish_and_keeps_every_text(spark, sf):
    draw = random.Random(3)
    letters = [" ".join("".join(draw.choices(string.ascii_lowercase, k=draw.randint(2, 9))) for _ in range(200)) for _ in range(20)]
    odd = letters + [draw.randbytes(900).hex() for _ in range(10)] + [base64.b64encode(draw.randbytes(900)).decode() for _ in range(10)]
    odd.append("Kissa nukkuu pöydällä kun sade lankeaa hitaasti vanhan kaupungin kaduille ja ihmiset kävelevät kotiin")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    planted = spark.createDataFrame([(-1 - i, t, None, "s", len(t)) for i, t in enumerate(odd)], docs.schema)
    got = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs.union(planted), sf).collect()}
    assert got == {r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text))}


def test_stages_remove_planted_passages_and_pack_the_rest(spark, tmp_path):
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefghijklm", k=draw.randint(3, 8))) for _ in range(3000)]
    line = lambda n: " ".join(draw.choices(words, k=n))
    passage, shared = [line(9) for _ in range(12)], line(70)
    own = {i: [line(10) for _ in range(14)] for i in range(8)}
    texts = {i: "\n".join(rows) for i, rows in own.items()}
    for i in (0, 1, 2):
        texts[i] = "\n".join([*own[i][:5], *passage, *own[i][5:]])
    for i in (3, 4):
        texts[i] = f"{line(60)} {shared} {line(60)}"
    rows = [(i, t, "aa", "s", len(t)) for i, t in texts.items()] + [(7, texts[7], "aa", "s", 1), (None, texts[6][:300], "aa", "s", 300), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(k for k, _ in kept if k is not None) == [*range(8), 7]  # rows of one id stay together
    by_id = dict(kept)
    assert all(row in by_id[i] for i in (0, 1, 2) for row in own[i])
    assert sum(by_id[i].count(row) for i in (0, 1, 2) for row in passage) <= 12 + 4  # at most two lines at either end of one more copy
    assert not any(shared[a : a + 200] in by_id[i] for i in (3, 4) for a in range(0, len(shared) - 200, 50))
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    pieces = defaultdict(list)
    for r in corpus_pipeline.packing_stage(spark, docs, "").collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for i, text in by_id.items():
        if i not in (None, 7):
            ids = np.array([*encode(text, add_special_tokens=False).ids, 0], "<u4")
            assert sum(n for _, n, _ in pieces[i]) == len(ids)
            assert all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in pieces[i])


def test_run_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
