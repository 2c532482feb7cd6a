import hashlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import duck

from rankspark.operators import sampling, tasks
from rankspark.plans import registry
from rankspark.plans import draws as _draws, folders as _folders, models as _models, tasks as _tasks  # noqa: F401  they register their queries


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, name):
    got, want = duck.spark_rows(registry.QUERIES[name](spark, sf)), duck.duck(sf, registry.ORACLES[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) > 0
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_query_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_majority_finetune_has_four_parts(spark):
    pos = spark.createDataFrame([("a", i) for i in range(5)] + [("a", 4), ("b", 9)], "peptide string, tcr long")
    pool = spark.createDataFrame([(i,) for i in [*range(12), 11]], "tcr long")
    rows = sampling.majority_finetune(pos, pool, "peptide", "tcr", 0.5, "m").collect()
    parts = {k: sum((r.peptide, r.known_label, r.label, r.set) == k for r in rows) for k in {(r.peptide, r.known_label, r.label, r.set) for r in rows}}
    assert sum(n for k, n in parts.items() if k[0] == "a") == 6 + 7 and sum(n for k, n in parts.items() if k[0] == "b") == 1 + 11
    assert parts[("a", "0", 0, "train")] == 3 and parts[("a", "Unknown", 0, "test")] == 4 and parts[("a", "1", 1, "train")] >= 3
    assert parts[("b", "Unknown", 1, "test")] == 1 and parts[("b", "Unknown", 0, "test")] == 11


def test_forest_has_the_default_size(spark, small, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    seen, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df: (seen.append((self.getNumTrees(), self.getMaxDepth())), fit(self, df))[1])
    registry.QUERIES["rf_train_predict"](spark, small)
    assert seen == [(100, 16)]


def test_forest_learns_in_many_tasks(spark, small, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    seen, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    registry.QUERIES["rf_train_predict"](spark, small)
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def test_forest_tells_held_out_names(spark, sf):
    from rankspark.operators import metrics

    kept = registry.QUERIES["rf_train_predict"](spark, sf).collect()
    every = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name").collect()
    names = {r.p_name for r in kept}
    assert len(kept) == sum(r.p_name in names for r in every) and len(names) == -(-len({r.p_name for r in every}) // 5)
    assert {r.fold for r in kept} == {1} and {r.label for r in kept} == {0.0, 1.0}
    area = metrics.auc_by_group(spark.createDataFrame([(1, r.score, int(r.label)) for r in kept], "g int, score double, label int"), ["g"], "score", "label").first()
    assert area.roc_auc > 0.85


def test_blocks_of_sets(spark):
    rows = [("a", "train", i, i % 2) for i in range(70)] + [("a", "test", 5, 1), ("a", "test", 5, 1), ("b", None, 1, 0)]
    df = spark.createDataFrame(rows, "key string, set string, item long, label int")
    got = {(r.key, r.set, r.block): (r["items"], r.labels) for r in tasks.set_blocks(df, "key", "item", "label", 32).collect()}
    assert [len(got[("a", "train", k)][0]) for k in range(3)] == [32, 32, 6]
    assert sum((got[("a", "train", k)][0] for k in range(3)), []) == list(range(70))
    assert sum((got[("a", "train", k)][1] for k in range(3)), []) == [i % 2 for i in range(70)]
    assert got[("a", "test", 0)] == ([5, 5], [1, 1]) and got[("b", None, 0)] == ([1], [0]) and len(got) == 5
    assert tasks.set_blocks(df.limit(0), "key", "item", "label", 32).count() == 0


def test_numbering_is_dealt_over_ranges(spark, capsys):
    pool = spark.range(20_000).toDF("tcr")
    needs = spark.createDataFrame([(1, 5), (2, 0), (3, 12_000)], "peptide long, n long")
    out = sampling.dealt(needs, pool, "peptide", "n", "tcr", "d")
    got = {(r.peptide, r.tcr, r.place) for r in out.collect()}
    order = sorted(range(20_000), key=lambda i: (hashlib.md5(f"d:{i}".encode()).hexdigest(), i))
    assert got == {(1 if p <= 5 else 3, order[p - 1], p) for p in range(1, 12_006)}
    out.explain()
    assert "row_number() windowspecdefinition(__range" in capsys.readouterr().out
    for n in (1, 3, 5, 7, 23):
        folds = {r.g: r.fold for r in sampling.group_folds(spark.range(n).selectExpr("concat('g', id) AS g"), "g", 5, "s").collect()}
        by_draw = sorted(folds, key=lambda g: hashlib.md5(f"s:{g}".encode()).hexdigest())
        assert [folds[g] for g in by_draw] == [k + 1 for k in range(5) for _ in range(n // 5 + (k < n % 5))]
