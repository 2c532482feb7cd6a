import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rankspark.llm import langid, queries


def test_held_out_accuracy(spark, sf):
    rows = queries.op2_language_id(spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 150
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "the cat and the hat", "en", 0.5), (2, "le chat et la souris", "fr", None), (3, None, "en", None), (4, "123 $$", "fr", None), (5, "", None, None), (6, "the hat", None, None), (6, "the hat", None, None)], "doc_id long, text string, lang string, score double")
    got = langid.identify(df, F.lit(True)).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got) == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (6, "en")]
    assert langid.identify(df.where("false"), F.lit(True)).collect() == []
    assert {r.lang_pred for r in langid.identify(df, F.lit(False)).collect()} == {"und"}


def test_profile_is_the_exact_top(spark):
    df = spark.createDataFrame([("abab a", "x"), ("ab", "x")], "text string, lang string")
    got = [r.gram for r in langid.learn_profiles(df, top=4).orderBy("rank").collect()]
    code = lambda s: sum(ord(c) << 21 * (len(s) - 1 - i) for i, c in enumerate(s))
    assert got == sorted([code("a"), code("b"), code("ab"), code(" a")], key=lambda g: (-{code("a"): 4, code("b"): 3, code("ab"): 3, code(" a"): 3}[g], g))


def plain_grams(text):
    s = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " ")
    return Counter(g for k in (1, 2, 3) for i in range(len(s) - k + 1) if (g := s[i : i + k]).strip())


def plain_rank(counts):
    order = sorted(counts, key=lambda g: (-counts[g], [0] * (3 - len(g)) + [ord(c) for c in g]))
    return {g: i for i, g in enumerate(order[:300])}


def test_query_equals_plain_out_of_place_distances(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs}
    sums = defaultdict(Counter)
    for r in docs:
        if r.lang is not None and not held[r.doc_id]:
            sums[r.lang].update(plain_grams(r.text))
    profiles = {lang: plain_rank(c) for lang, c in sums.items()}
    got = {r.doc_id: r for r in queries.op2_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        own, mine = plain_rank(plain_grams(r.text)), got[r.doc_id]
        assert mine.held_out == held[r.doc_id]
        if not own:
            assert (mine.lang_pred, mine.score) == ("und", 0.0)
            continue
        far = sorted((sum(abs(p[g] - i) if g in p else 300 for g, i in own.items()), lang) for lang, p in profiles.items())
        best, other = far[0][0], far[1][0]
        assert mine.lang_pred == far[0][1]
        assert abs(mine.score - other / (best + other)) < 1e-12
        assert abs(mine.closeness - (1 - best / (300 * len(own)))) < 1e-12


def test_long_texts_and_clashing_columns(spark):
    long = "the hat and the cat " * 400_000  # twice a task's bytes
    df = spark.createDataFrame([(1, long, "en", "mine"), (2, "le chat et la souris", "fr", "mine"), (3, "the cat", None, "mine")], "doc_id long, text string, lang string, lang_pred string")
    got = langid.identify(df, F.lit(True), keep=("doc_id", "lang_pred")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "en"), (2, "fr"), (3, "en")]
