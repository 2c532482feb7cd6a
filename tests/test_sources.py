import pytest
from pyspark.sql import functions as F

from rankspark.operators import features, metrics, pairs, tasks
from rankspark.sources import tables
from rankspark.streaming.evaluate import evaluate_new_files


def test_folders_of_both_formats(spark, tmp_path):
    root = str(tmp_path / "in")
    one = spark.createDataFrame([("a", 0.5)], "tcr string, score double")
    one.coalesce(1).write.parquet(f"{root}/x/deep")
    one.coalesce(1).write.option("header", True).csv(f"{root}/y/deep")
    (tmp_path / "in" / "y" / "k_shot_1.csv").write_text("tcr,score\nz,1\n")
    (tmp_path / "in" / "top.csv").write_text("tcr,score\nb,0.25\n")
    got = tables.load_folder(spark, root, "any", "tcr string, score double")
    assert {(r.tcr, r.directory) for r in got.collect()} == {("a", "x/deep"), ("a", "y/deep"), ("b", "")}
    assert [r.directory for r in tables.data_directories(got).collect()] == ["", "x/deep", "y/deep"]
    assert {r.top for r in tables.first_level(got).collect()} == {"x", "y"}
    below = tables.load_folder(spark, root, "csv", "tcr string, score double", directory="y")
    assert {(r.tcr, r.directory) for r in below.collect()} == {("a", "y/deep")}
    with pytest.raises(ValueError):
        tables.load_folder(spark, root, "orc")
    with pytest.raises(ValueError):
        tables.load_table(spark, f"{root}/x.txt")
    assert tables.load_table(spark, f"{root}/top.csv").columns == ["tcr", "score"]
    assert [r.a for r in tables.load_plain_table(spark, f"{root}/top.csv", ["a"]).orderBy("a").collect()] == ["b", "tcr"]
    assert [r.value for r in tables.file_names(got.where("directory = ''")).collect()] == ["'top.csv'"]


def test_lists_names_and_sinks(spark, tmp_path):
    (tmp_path / "pool.txt").write_text("\ufeffCAVS\n\n \tCASS \n", encoding="utf-8")
    assert sorted(r.tcr for r in tables.load_list(spark, str(tmp_path / "pool.txt")).collect()) == ["CASS", "CAVS"]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "\ufeff` id` long, `name ` string".replace("\ufeff` id`", "id").replace("`name `", "name"))
    assert tables.normal_names(df.toDF(" id", "\ufeffname")).columns == ["id", "name"]
    with pytest.raises(ValueError):
        tables.require(df, ["id", "other"])
    tables.write_both(df, str(tmp_path / "both"))
    assert spark.read.parquet(str(tmp_path / "both.parquet")).count() == spark.read.option("header", True).csv(str(tmp_path / "both.csv")).count() == 2
    tables.write_tree(df, str(tmp_path / "tree"), ["name"], ["id"])
    assert {r.name for r in spark.read.parquet(str(tmp_path / "tree")).collect()} == {"a", "b"}
    assert [r.id for r in tables.not_done(df, df.where("id = 1"), ["id"]).collect()] == [2]


def test_streaming_joins_groups_of_several_batches(spark, tmp_path):
    rows = [("g", 0.9, 1), ("g", 0.8, 0), ("g", 0.7, 1), ("g", 0.1, 0), ("h", 0.5, 1)]
    schema = "name string, score double, label int"
    call = lambda: evaluate_new_files(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check"), ["name"], "score", "label")
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = {r.name: (r.roc_auc, r.status) for r in call().collect()}
    want = {r.name: (r.roc_auc, r.status) for r in metrics.auc_by_group(spark.createDataFrame(rows, schema), ["name"], "score", "label").collect()}
    assert got == want == {r.name: (r.roc_auc, r.status) for r in call().collect()} and got["g"][0] == 0.75


def test_scores_that_are_no_numbers_are_an_error(spark):
    df = spark.createDataFrame([("a", float("nan"), 1), ("a", 0.5, 0), ("b", None, 0), ("c", 0.1, 0), ("c", 0.2, 1)], "g string, s double, y int")
    got = {r.g: (r.roc_auc, r.status[:5]) for r in metrics.auc_by_group(df, ["g"], "s", "y").collect()}
    assert got == {"a": (None, "error"), "b": (None, "error"), "c": (1.0, "succe")}


def test_sequences_and_pairs(spark):
    words = ["acd", "\tACD \n", "ACD\n", "AXD", "", None, " "]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [tuple(r) for r in df.select(pairs.clean_sequence("w"), pairs.clean_sequence("w", strict=True)).collect()]
    assert got == [("ACD", None), ("ACD", None), ("ACD", None), (None, None), (None, None), (None, None), (None, None)]
    df = spark.createDataFrame([("acd", "ggg", "x"), ("b", "ggg", "a"), (None, "ggg", "a")], "item string, key string, other string")
    assert [tuple(r) for r in pairs.valid_pairs(df, "item", "key", "other").collect()] == [("ACD", "GGG", "UNK")]
    assert pairs.resolve_column(df.toDF(" Item", "key", "x"), ["tcr", "item"], 0) == " Item"
    assert pairs.resolve_column(df, ["none"], 2) == "other"
    pos = spark.createDataFrame([(1, "p"), (1, "q"), (2, "q"), (1, "p")], "k int, i string")
    pool = spark.createDataFrame([("q",), ("r",), ("q",)], "i string")
    got = sorted(tuple(r) for r in pairs.candidate_pairs(pos, pool, pos, "k", "i").collect())
    assert got == [(1, "p", 1), (1, "q", 1), (1, "r", 0), (2, "q", 1), (2, "r", 0)]


def test_small_task_operators(spark):
    df = spark.createDataFrame([("a", 1)], "k string, x int")
    assert tasks.typed_empty(df).schema == df.schema and tasks.typed_empty(df).count() == 0
    assert tasks.with_default(df, "label", 0).columns == ["k", "x", "label"] and tasks.with_default(df, "x", 9).first().x == 1
    assert tasks.routed(df.withColumn("l", F.lit(None).cast("string")), "l").first().role == "query"
    assert tasks.routed(df, "x").first()["set"] == ""
    rows = spark.createDataFrame([("f.par", 0, "u"), ("f.par", 1, "v")], "file string, pos long, item string")
    records = spark.createDataFrame([("f.csv", 3, [1, 7], None)], "original_file string, sample_index int, label_1_indices array<int>, label_0_indices array<int>")
    assert [(r.item, r.place) for r in tasks.apply_indices(records, rows, "file", "pos").collect()] == [("v", 0)]
    assert features.hit_ratio(df.where("false").withColumn("hit", F.lit(True))).first().hit_ratio is None
