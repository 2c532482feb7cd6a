import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rankspark.llm import pst, queries


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(rows):
    c = Counter(t for _, text, learn in rows if learn for t in tokens_of(text))
    n, v = sum(c.values()), len(c)
    return {i: (not learn, len(k := tokens_of(text)), sum(c[t] > 0 for t in k), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in k)) for i, text, learn in rows}


def test_base_columns(spark, sf):
    got = queries.op4_suffix_tree_lm(spark, sf).collect()
    import zlib

    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert abs(r.base_score - w[4]) < 1e-6 * abs(w[4]) + 1e-9
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    rows = [(1, None, True), (2, "", True), (3, "A a\tb", True), (4, "  a\nB c ", False), (4, "  a\nB c ", False), (5, "é " * 5000, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = pst.score_texts(df, F.col("learn")).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6
    assert pst.score_texts(df.where("false"), F.col("learn")).collect() == []
    none = pst.score_texts(df, F.lit(False)).where("doc_id = 3").first()
    assert none.score == 0 and none.train_tokens == 0 and none.base_score == 0


def test_distributions_sum_to_one(spark, small):
    texts = spark.read.parquet(f"{small}/documents.parquet").selectExpr("text AS __text")
    model = pst.learn(texts)
    assert len(model.states[0][0]) > 20 and len(model.states[1][0]) > 0
    root = model.root / model.size
    n = len(root)
    rare = 1 - root[1:].sum() + root[np.flatnonzero(np.array([None, None, *model.words.to_pylist()], object) == pst.END_WORD)].sum()
    names = np.array([i for i in range(1, n) if i < 2 or model.words[i - 2].as_py() != pst.END_WORD])
    for d in (1, 2):
        for context in model.states[d - 1][0][:5].tolist():
            before = [context >> 20 * k & (1 << 20) - 1 for k in range(d)][::-1]
            p = 0.0
            for s in [0, *names.tolist()]:
                seq = np.array([*([] if before[0] == pst.END else [pst.END]), *before, s])
                scored = np.arange(len(seq)) > 0
                part, rooted = model.score(seq, scored)
                p += 10 ** part[-1] * ((rare if s == 0 else root[s]) if rooted[-1] else 1)
            assert abs(p - 1) < 1e-6


def test_scores_equal_the_model_in_memory(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id", "text", "doc_id % 5 > 0 AS learn")
    model = pst.learn(rows.where("learn").selectExpr("text AS __text"))
    got = {r.doc_id: r.score for r in pst.score_texts(rows, F.col("learn")).collect()}
    count = Counter(t for r in rows.collect() if r.learn for t in tokens_of(r.text))
    for r in rows.collect():
        tokens = tokens_of(r.text)
        coded = model.symbols(pst.pa.array(tokens[:-1], pst.pa.string()), np.array([0, len(tokens) - 1]))
        part, rooted = model.score(*coded)
        want = part.sum() + sum(math.log10((count[t] + 1) / model.size) for t, x in zip(tokens, rooted, strict=True) if x)
        assert abs(got[r.doc_id] - want) < 1e-6 * abs(want) + 1e-9, r.doc_id


def test_rare_pairs_of_a_large_corpus_stay(spark):
    rows = [(i, "filler " * 2000, True) for i in range(300)] + [(1000 + i, f"rare{i % 2500} pair{i % 2500}", True) for i in range(5000)]
    rows += [(9000 + i, f"rare{i} pair{i}", False) for i in range(2500)]
    got = pst.score_texts(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), F.col("learn")).where("held_out").collect()
    assert len(got) == 2500 and all(r.score - r.base_score > 4 for r in got)
