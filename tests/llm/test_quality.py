import math
import re
from collections import Counter

from pyspark.sql import functions as F

from rankspark.llm import quality, queries


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [None, "", " \n\t", "a b c d", "a b c d e", "a b c d e f a b c d e", "a a a a a a a a", "x y\n\nx y\n x y", "é🙂 #*$%&|<>", "w " * 30000, "one two three four five\none two three four five six"]
    extra = spark.createDataFrame([(-1 - i, t, None, None, None) for i, t in enumerate(odd)], docs.schema)
    df = docs.unionByName(extra)
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in quality.text_counts(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), r.doc_id


def test_query(spark, sf):
    got = queries.op8_quality_rules(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        n, _, _, _, repeat = brute(texts[r.doc_id])
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n) and not (r.kept and r.base_failed)


def test_binomial_tail(spark):
    cases = [(1000, 0), (1000, 3), (1000, 9), (50, 20), (5000, 49)]
    want = [sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)) for n, k in cases]
    got = [r.p for r in spark.createDataFrame([(n, k, i) for i, (n, k) in enumerate(cases)], "n long, k long, i int").orderBy("i").select(quality.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want, strict=True))


def test_cutoffs_are_certified(spark):
    # 2000 good documents, 2 of them with many symbols; 300 bad ones with many.
    good = [(i, " ".join(["word"] + [f"w{i}x{k}" for k in range(30)]) + (" ####" * 20 if i < 2 else ""), "en") for i in range(2000)]
    bad = [(5000 + i, " ".join(f"b{i}y{k}#####" for k in range(30)), "en") for i in range(300)]
    few = [(9000 + i, " ".join(f"b{i}y{k}#####" for k in range(30)), "fr") for i in range(30)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad + few], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r for r in quality.judge(docs, labels, risk=0.05).collect()}
    assert sum(not kept[i].kept for i, *_ in good) <= 2
    assert not any(kept[i].kept for i, *_ in bad)
    assert all(kept[i].kept for i, *_ in few)  # no good labelled document there: nothing can be certified
    assert quality.judge(docs.where("false"), labels).collect() == []
    assert all(r.kept != r.base_failed for r in quality.judge(docs, labels.where("false")).collect())


def test_few_labels_certify_a_rule(spark):
    rows, labels = [], []
    for k, lang in enumerate(("de", "en", "es", "fr")):
        for i in range(280 if lang != "fr" else 240):
            rows.append((1000 * k + i, " ".join(f"w{i}x{j}" for j in range(20)), lang))
            labels.append((1000 * k + i, 1))
        for i in range(30):
            rows.append((1000 * k + 500 + i, " ".join(f"b{i}y{j}##" for j in range(20)), lang))
            labels.append((1000 * k + 500 + i, 0))
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    for i, good in labels:
        assert kept[i] == (good == 1 or i >= 3000), i  # 240 good labels are too few for a certificate, 280 are enough


def test_copies_and_repeated_labels_are_one_trial(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    rows = [(i, text(i % 40), "en", 1) for i in range(400)] + [(1000 + i, " ".join(f"b{i}y{j}##" for j in range(20)), "en", 1) for i in range(30)]
    labels = [(i, 1) for i in range(400)] * 3 + [(1000 + i, 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    assert all(r.kept for r in quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect())  # 40 texts certify nothing


def test_verdicts_equal_plain_certificates(spark):
    """The query's verdicts on a table with enough labels, recomputed from the counts in plain Python."""
    import random

    draw, rows, labels = random.Random(6), [], []
    for i in range(900):
        good = draw.random() < 0.75
        words = [f"w{i}x{j}" for j in range(25)]
        if not good and draw.random() < 0.8 or draw.random() < 0.0005:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en" if i % 3 else "de"))
        labels.append((i, int(good)))
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    good = dict(labels)
    for lang in ("en", "de"):
        values = {}
        for i, text, own in rows:
            n, chars, symbols, dup, repeat = brute(text)
            if own == lang and n >= 10 and 100 * repeat <= 20 * n:
                values[i] = {"symbol_share": symbols / chars, "dup_line_share": dup / 1, "repeat_share": repeat / n, "mean_word": chars / n, "tiny_word": -chars / n}
        best, chosen, ended = 0, {}, set()
        for chain, share, cutoffs in quality.verdicts():
            hit = {i for i, v in values.items() if any(v[r] > c for r, c in cutoffs.items())}
            n, k = sum(good[i] for i in values), sum(good[i] for i in hit)
            tail = sum(math.comb(n, j) * quality.RISK**j * (1 - quality.RISK) ** (n - j) for j in range(k + 1))
            if chain in ended or k >= n * quality.RISK or tail > quality.DOUBT * share / 2:
                ended.add(chain)
                continue
            gain = len(hit) - k - quality.PRICE * k
            if gain > best:
                best, chosen = gain, cutoffs
        for i, v in values.items():
            assert got[i] == all(v[r] <= c for r, c in chosen.items()), (lang, i)
        assert lang == "de" or chosen
