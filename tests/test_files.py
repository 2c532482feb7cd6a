import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankspark.operators import external, features, metrics, tasks
from rankspark.plans import registry, tasks as _tasks  # noqa: F401  it registers its queries
from rankspark.sources import npz, positions, tables
from rankspark.streaming.evaluate import evaluate_new_files, ledger, score_new_files


def test_positions_over_several_splits(spark, tmp_path):
    texts = {"a": 5000, "b": 3, "c": 0}
    for name, n in texts.items():
        (tmp_path / f"{name}.csv").write_text("item,score\n" + "".join(f"{name}{i},{i * 7 % 11}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = positions.with_positions(spark, str(tmp_path), "csv", "item string, score int")
        assert spark.read.csv(str(tmp_path)).select("_metadata.file_block_start").distinct().count() > 4
        got = {(r.file_name, r.pos): r.item for r in rows.collect()}
        records = spark.createDataFrame([("a.parquet", 0, [4999, 0, 2500], [7, 5000])], "original_file string, sample_index int, label_1_indices array<int>, label_0_indices array<int>")
        picked = tasks.apply_indices(records, rows, "file_name", "pos").orderBy("place").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(f"{name}.csv", i): f"{name}{i}" for name, n in texts.items() for i in range(n)}
    assert [r.item for r in picked] == ["a4999", "a0", "a2500", "a7"]
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "p"))
    other = positions.with_positions(spark, str(tmp_path / "p"), "parquet")
    both = positions.zipped_by_position(other, rows.where("file_name = 'a.csv'"))
    assert both.count() == 100 and both.where("item <> concat('a', id)").count() == 0


def test_encodings_from_an_archive(spark, tmp_path):
    path = str(tmp_path / "dict.npz")
    arrays = {f"SEQ{i}": np.arange(i, i + 6, dtype=np.float32).reshape(2, 3) for i in range(40)}
    np.savez(path, **arrays)
    npz.register(spark)
    df = spark.read.format("npz").option("taskBytes", "1000").load(path)
    assert df.rdd.getNumPartitions() > 3
    got = {r.name: (r.shape, r.encoding) for r in df.collect()}
    assert got == {k: ([2, 3], v.astype(float).ravel().tolist()) for k, v in arrays.items()}
    wanted = spark.createDataFrame([("SEQ3",), ("ACD",)], "name string")
    out = {r.name: (r.hit, len(r.encoding)) for r in features.with_encoding(wanted, df.drop("shape"), "name", 3).collect()}
    assert out == {"SEQ3": (True, 6), "ACD": (False, 15)}
    np.savez(path, bad=np.array([{}], dtype=object))
    with pytest.raises(Exception, match="[Oo]bject arrays"):
        spark.read.format("npz").load(path).collect()


def test_foreign_models(spark):
    seen = []
    frames = [pd.DataFrame({"x": range(a, b)}) for a, b in ((0, 7), (7, 7), (7, 30), (30, 31))]

    def model(rows):
        seen.append(len(rows))
        if rows["x"].isin([3, 17, 18]).any():
            raise KeyError("no")
        return rows["x"] * 2

    sizes = [len(b) for b in external.batches_of(iter(frames), 10)]
    assert sizes == [10, 10, 10, 1]
    out = [r for b in external.batches_of(iter(frames), 10) for r in external.judged(model, b)]
    assert out == [(0.0, "KeyError: 'no'") if x in (3, 17, 18) else (2.0 * x, None) for x in range(31)]
    assert max(seen) == 10
    df = spark.range(1000).withColumn("y", F.col("id") % 5).coalesce(1)
    got = external.score_external(df, lambda: lambda rows: [1.0] if len(rows) > 1 else [2.0], ["id"], 64).collect()
    assert [r.id for r in got] == list(range(1000)) and all(r.score == 2.0 and r.error is None for r in got)


def test_early_recognition_of_batches(spark, tmp_path):
    rows = [("g", 0.9, 1), ("g", 0.8, 0), ("g", 0.7, 1), ("g", 0.7, 0), ("g", 0.1, 0), ("h", 0.5, 1)]
    schema = "name string, score double, label int"
    call = lambda: evaluate_new_files(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check"), ["name"], "score", "label")
    scored = lambda: score_new_files(spark, str(tmp_path / "in"), schema, str(tmp_path / "rows"), str(tmp_path / "check2"), lambda df: df.withColumn("twice", F.col("score") * 2))
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = {r.name: (r.roc_auc, r.bedroc) for r in call().collect()}
        assert scored().count() == scored().count() == len(rows[:2] if part == rows[:2] else rows)
    whole = metrics.bedroc_of_steps(metrics.auc_steps(spark.createDataFrame(rows, schema), ["name"], "score", "label"), ["name"])
    assert {k: v[1] for k, v in got.items()} == {r.name: r.bedroc for r in whole.collect()} and got["h"][1] == 1.0
    assert sorted(r.n_rows for r in ledger(scored()).collect()) == [2, 4]
    # A batch whose commit was lost is written anew, not twice.
    import shutil

    commits = sorted((tmp_path / "check2" / "commits").iterdir())
    for f in [f for f in commits if f.name.lstrip(".").startswith("1")]:
        f.unlink()
    assert scored().count() == len(rows)
    shutil.rmtree(tmp_path / "rows")


def test_blocks_of_one_are_the_ranks(spark):
    df = spark.range(500).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 1009).cast("double").alias("s"), (F.col("id") % 9 == 0).cast("int").alias("label"), "id")
    from rankspark.operators import ranking

    a = metrics.bedroc(ranking.ranked(df, ["g"], "s", ["id"]), ["g"], "label").first().bedroc
    b = metrics.bedroc_of_steps(metrics.auc_steps(df, ["g"], "s", "label"), ["g"]).first().bedroc
    assert abs(a - b) < 1e-9


def test_trees_are_mirrored_and_committed_whole(spark, tmp_path):
    from rankspark.sources import trees

    rows = [("x/deep", "a.csv", i, i * 37 % 101) for i in range(100)] + [("", "b.parquet", 1, 1), ("x", "c.csv", 5, 2)]
    df = spark.createDataFrame(rows, "directory string, file_name string, i int, score int").repartition(7)
    root = tmp_path / "out"
    trees.write_files(df.repartition(5), str(root), trees.sorted_name("directory", "file_name", "csv"), [F.desc("score"), "i"])
    assert {str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()} == {"x/deep/a_sorted.csv", "b_sorted.csv", "x/c_sorted.csv"}
    got = pd.read_csv(root / "x/deep/a_sorted.csv")
    assert list(got.columns) == ["directory", "file_name", "i", "score"] and list(got["score"]) == sorted((r[3] for r in rows[:100]), reverse=True)
    samples = spark.createDataFrame([(s, k, i) for s in range(3) for k in ("p/1", "q") for i in range(4)], "sample int, key string, i int")
    trees.write_files(samples, str(root), trees.sample_name("sample", "key"), ["i"])
    assert list(pd.read_csv(root / "sample_2/p_1.csv")["i"]) == [0, 1, 2, 3] and (root / "b_sorted.csv").exists()
    # One task fails: no file of any task is there, and an old one stays as it was.
    bad = samples.withColumn("i", F.when((F.col("sample") == 2) & (F.col("key") == "q"), F.expr("raise_error('lost')").cast("int")).otherwise(F.col("i") + 10))
    with pytest.raises(Exception, match="lost"):
        trees.write_files(bad, str(root), F.concat(F.lit("new/"), trees.sample_name("sample", "key")), [])
    with pytest.raises(Exception, match="not a name below the root"):
        trees.write_files(samples, str(root), F.lit("../up.csv"), [])
    assert not (root / "new").exists() and not list(root.glob("_staging-*")) and list(pd.read_csv(root / "sample_2/q.csv")["i"]) == [0, 1, 2, 3]
    trees.write_files(df, str(root), F.lit("all.parquet"), ["i"], kind="parquet")
    assert len(pd.read_parquet(root / "all.parquet")) == 102


def test_builders_by_name(spark):
    from rankspark.operators import pair_tables

    pair_tables.register(spark)
    rows = spark.createDataFrame([("p", i, float(i % 7), "x") for i in range(30)] + [("q", 1, None, "y")], "peptide string, tcr long, score double, other string")
    out = spark.sql("SELECT * FROM build_pairs(TABLE({rows}) PARTITION BY peptide ORDER BY (score DESC, tcr), 'ranked')", rows=rows)
    want = sorted(range(30), key=lambda i: (-(i % 7), i))
    assert [r.tcr for r in out.where("peptide = 'p'").orderBy("place").collect()] == want and out.columns == ["peptide", "tcr", "score", "other", "place"]
    assert [r.fault for r in spark.sql("SELECT * FROM build_pairs(name => 'valid', rows => TABLE({rows}) PARTITION BY peptide)", rows=rows.where("peptide = 'q'")).collect()] == ["no score"]
    with pytest.raises(Exception, match="first_ten"):
        spark.sql("SELECT * FROM build_pairs(name => 'none', rows => TABLE({rows}) PARTITION BY peptide)", rows=rows)
    with pytest.raises(Exception, match="missing columns"):
        spark.sql("SELECT * FROM build_pairs(name => 'valid', rows => TABLE({rows}) PARTITION BY peptide)", rows=rows.drop("score"))


def test_forests_are_kept(spark, tmp_path):
    from rankspark.operators import sampling, scoring

    words = [("".join(["ACDE", "CDEF", "KLMN", "WYVT"][(i * k) % 4] for k in range(1, 4)), "AC" if i % 3 else "KL", f"g{i % 20}") for i in range(600)]
    df = spark.createDataFrame(words, "tcr string, peptide string, g string").withColumn("feature", features.pair_feature("peptide", "tcr")).withColumn("label", F.col("tcr").startswith("A").cast("int"))
    folds = sampling.group_folds(df, "g", 5, "42")
    model = scoring.forest(folds.where("fold > 1"), ["feature"], "label", trees=10, depth=5)
    held = folds.where("fold = 1").select("tcr", "feature", "label")
    assert len(held.first().feature) == 200
    scored = model(held)
    right = scored.where((F.col("score") > 0.5) == (F.col("label") == 1)).count()
    assert right > 0.9 * held.count() and scored.columns == ["tcr", "feature", "label", "score"]
    model.save(str(tmp_path / "m"))
    again = scoring.load_forest(str(tmp_path / "m"))
    assert sorted(map(str, again(held).select("tcr", "score").collect())) == sorted(map(str, scored.select("tcr", "score").collect()))
    odd = held.limit(1).select("tcr", F.lit(None).cast("array<double>").alias("feature"), "label")
    assert [r.score for r in again(odd).collect()] == [0.0]
    rows = spark.read.parquet(str(tmp_path / "m" / "features")).collect()
    spark.createDataFrame([(r.place, "other", r.fingerprint) for r in rows], "place int, feature string, fingerprint string").write.mode("overwrite").parquet(str(tmp_path / "m" / "features"))
    with pytest.raises(ValueError, match="not those"):
        scoring.load_forest(str(tmp_path / "m"))


def test_alike_rows_that_fail_take_few_calls(spark):
    calls = []

    def model(rows):
        calls.append(len(rows))
        if (rows["kind"] == 7).any():
            raise ValueError(f"bad {rows['x'].iloc[0]}")
        return rows["x"] / 2

    rows = pd.DataFrame({"kind": [(x * 37) % 50 for x in range(1000)], "x": [float(x) for x in range(1000)]})
    out = external.judged(model, rows)
    assert out == [(0.0, f"ValueError: bad {x}") if k == 7 else (x / 2, None) for k, x in zip(rows["kind"], rows["x"], strict=True)]
    assert len(calls) < 100  # twenty rows fail; about 265 calls where they are anywhere
    mixed = pd.DataFrame({"kind": [7, "a", None], "x": [1.0, 2.0, 3.0]})
    assert external.judged(model, mixed) == [(0.0, "ValueError: bad 1.0"), (1.0, None), (1.5, None)]


def test_a_hit_alone_needs_no_encodings(spark, capsys):
    part = spark.createDataFrame([("ACD",), ("W",)], "seq string")
    dictionary = spark.createDataFrame([("ACD", [1.0]), ("ACD", [0.5])], "seq string, encoding array<double>")
    looked = features.with_encoding(part, dictionary, "seq", 3)
    assert {r.seq: (r.hit, len(r.encoding)) for r in looked.collect()} == {"ACD": (True, 1), "W": (False, 15)}
    features.hit_ratio(looked).explain()
    assert "min(encoding" not in capsys.readouterr().out


def test_trees_keep_a_task_for_few_files(spark, tmp_path, capsys):
    df = spark.range(300).select((F.col("id") % 12).alias("k"), (F.col("id") % 7).cast("double").alias("score"))
    tables.write_tree(df, str(tmp_path / "t"), ["k"], ["score"], "csv", "none")
    files = tables.load_folder(spark, str(tmp_path / "t"), "csv", "score double")
    assert {(r.directory, r["count"]) for r in files.groupBy("directory").count().collect()} == {(f"k={k}", 25) for k in range(12)}
    assert {r.top for r in tables.first_level(files).select("top").distinct().collect()} == {f"k={k}" for k in range(12)}
    tables.first_level(files).explain()
    assert "regexp_replace" not in capsys.readouterr().out
    root = tables.load_folder(spark, str(tmp_path / "t" / "k=3"), "csv", "score double")
    assert {r.directory for r in root.collect()} == {""} and tables.first_level(root).count() == 0


def test_lookups_deal_their_rows(spark, small, capsys):
    registry.QUERIES["encoding_lookup_fallback"](spark, small).explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
