import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rankspark.llm import jaccard


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    where, up = {}, list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in enumerate(sets):
        near = set()
        for x in s:
            near.update(where.setdefault(x, []))
            where[x].append(i)
        for j in near:
            k = len(s & sets[j])
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows))


def run(spark, rows, hot=jaccard.HOT):
    df = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, node string")
    return sorted(tuple(r) for r in jaccard.linked(df, hot=hot).collect())


def changed(rng, words, share):
    return [rng.choice("abcdefghij") + str(rng.randint(0, 10**6)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("hot", [24, 3])
def test_planted_groups(spark, hot):
    rng = random.Random(hot)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 5000))
    texts = [None, "", " \n ", "One two", "one  TWO", "one two three four five", "one two three four five six", "x"]
    passage = [word() for _ in range(40)]
    for n in (6, 9, 14, 30, 33, 60, 64, 120, 300, 900):
        base = [word() for _ in range(n)]
        for share in (0, 0, 0.01, 0.02, 0.04, 0.05, 0.06, 0.1):
            texts.append(" ".join(changed(rng, base, share)))
        texts.append(" ".join(base[: max(1, int(n * 0.8))]))
    texts += [" ".join(passage + [word() for _ in range(rng.randint(5, 25))]) for _ in range(60)]
    big = [word() for _ in range(100)]
    texts += [" ".join(changed(rng, big, 0.02)) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100))
    assert run(spark, rows, hot) == brute(rows)


def test_pigeonhole_never_misses_a_pair():
    """Every similar pair shares a signature in a common place, under each layout in which a set has enough units."""
    rng = np.random.default_rng(3)
    for n in (*range(1, 70, 3), 120, 500):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = int(rng.integers(0, max(1, n // 4) + 1))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 6)), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common < 75 * (len(a) + len(b) - common):
                continue
            shared = set(jaccard.places(len(a))) & set(jaccard.places(len(b)))
            met = []
            for c in shared:
                for k in range(len(jaccard.LAYOUTS) + 1):
                    if all(jaccard.layout_of(x, c, k)[0] >= jaccard.needed(len(x), c) for x in (a, b)):
                        met.append(bool(len(np.intersect1d(jaccard.signatures(a, c, k), jaccard.signatures(b, c, k)))))
            top = max(jaccard.class_of(len(a)), jaccard.class_of(len(b)))
            assert top in shared and met and all(met[-1:])


def test_documents_match_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(tuple(r) for r in jaccard.linked(df).collect()) == brute(rows)


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, None), (4, None)]) == [(4, 0, 4), (4, 0, 4)]


def test_sets_that_share_a_passage_only_make_no_pairs(spark, monkeypatch):
    """Long texts with one passage in common share fewer signatures than they have units to spare: no pair is compared."""
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 10**6))
    passage = [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(700)] + passage + [word() for _ in range(700)]) for _ in range(16)]
    texts += [" ".join(changed(rng, texts[0].split(), share)) for share in (0.005, 0.03)]
    rows, made = list(enumerate(texts, 100)), []
    across = jaccard._across

    def counted(*args):
        found = across(*args)
        made.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "_across", counted)
    assert run(spark, rows) == brute(rows)
    assert made == [0]


def test_signatures_of_a_set_that_fall_on_one_are_counted():
    """In one bucket, some of 300000 signatures share their 32 bits; each still counts for the set's place."""
    text = " ".join(map(str, range(300_000)))
    blocks = [r for b in jaccard._emit({}, 1, 24)(iter([pa.RecordBatch.from_pydict({"__text": [text]})])) for r in b.to_pylist()]
    n = len(sets_of(text))
    assert sum(len(np.unique(np.frombuffer(r["sigs"], "<u4"))) for r in blocks) < n * len(jaccard.places(n))
    single = sum(len(np.unique(np.frombuffer(r["sigs"], "<u4")[np.repeat(np.frombuffer(r["nodes"], np.uint64), np.frombuffer(r["counts"], np.uint8)) % 2 == role])) for r in blocks for role in (0, 1))
    assert single + sum(len(r["hot"]) // 16 for r in blocks) == n * len(jaccard.places(n))


def test_signatures_of_a_batch_are_made_in_little_memory():
    import random
    import tracemalloc

    import pyarrow as pa

    from rankspark.llm import jaccard as step

    rng = random.Random(1)
    batch = pa.record_batch({"__text": [" ".join(str(rng.randrange(10**5)) for _ in range(300)) for _ in range(5000)]})
    tracemalloc.start()
    try:
        assert list(step._emit({}, 100, 24)(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 12 * batch.nbytes  # 19 when np.unique told the counts
    finally:
        tracemalloc.stop()
