from pyspark.sql import functions as F

from rankspark.operators import draws, sampling


def test_permutations_are_permutations(spark):
    for n in (1, 2, 3, 5, 17, 100, 1009):
        df = spark.range(n).select(draws.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(f"s{n}")).alias("y"))
        got = [r.y for r in df.collect()]
        assert sorted(got) == list(range(n)) and (n < 17 or got != list(range(n)))
    two = spark.range(50).select(*[draws.permuted(F.col("id"), F.lit(50).cast("long"), F.lit(s)).alias(s) for s in "ab"]).collect()
    assert [r.a for r in two] != [r.b for r in two]


def test_draws_leave_out_what_is_barred(spark, capsys):
    pos = spark.createDataFrame([(k, i) for k in range(30) for i in range(k, 200, 3)], "k long, i long")
    pool = spark.range(200).toDF("i")
    out = draws.drawn_support(pos, pool, "k", "i", 4, "s", negatives=6)
    rows, own = out.collect(), {(r.k, r.i) for r in pos.collect()}
    assert all(((r.k, r.i) in own) == (r.label == 1) for r in rows)
    for k in range(30):
        yes, no = ([r.i for r in rows if r.k == k and r.label == n] for n in (1, 0))
        assert len(set(yes)) == len(yes) == 4 and len(set(no)) == len(no) == 6
    draws.drawn_support(pos, pool, "k", "i", 4, "s").explain()
    assert "CartesianProduct" not in capsys.readouterr().out


def test_attempts_are_bounded_and_small_pools_are_used_up(spark):
    pos = spark.createDataFrame([(1, i) for i in range(990)] + [(2, 5)], "k long, i long")
    pool = spark.range(1000).toDF("i")
    got = [r.k for r in draws.drawn_support(pos, pool, "k", "i", 3, "s").where("label = 0").collect()]
    assert got.count(2) == 3 and got.count(1) <= 3  # ten of a thousand are left to key 1, in 30 attempts
    small = spark.range(4).toDF("i")
    assert sorted(r.i for r in draws.drawn_support(pos.where("k = 2"), small, "k", "i", 9, "s").where("label = 0").collect()) == [0, 1, 2, 3]
    assert draws.drawn_support(pos, pool.where("false"), "k", "i", 3, "s").where("label = 0").collect() == []


def test_epochs_share_one_plan(spark):
    pos = spark.createDataFrame([(k, i) for k in range(5) for i in range(k * 20, k * 20 + 12)], "k long, i long")
    pools = spark.range(300).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("pool"), F.col("id").alias("i"))
    epochs = spark.range(500).select(F.col("id").cast("int").alias("epoch"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("pool"))
    out = draws.drawn_tasks(pos, pools, "k", "i", 3, 5, epochs, "s", 100)
    each = out.groupBy("k", "epoch", "label", "role").agg(F.count_distinct("i").alias("n")).collect()
    assert len(each) == 5 * 500 * 4 and all(r.n == (3 if r.role == "support" else 5) for r in each)
    assert out.where("label = 0 AND i % 2 <> epoch % 2").count() == 0
    assert len({tuple(sorted(r.x)) for r in out.where("k = 0 AND label = 1 AND role = 'support'").groupBy("epoch").agg(F.collect_list("i").alias("x")).collect()}) > 50


def test_blocks_of_draws_are_the_draws(spark):
    for n in (1, 2, 5, 17, 300, 1009):
        size, name = F.lit(n).cast("long"), F.lit(f"s{n}")
        one = [r.y for r in spark.range(n).select(draws.permuted(F.col("id"), size, name).alias("y")).collect()]
        block = draws.permuted_block(F.lit(0).cast("long"), F.lit(n - 1).cast("long"), size, name, draws.network_words(size, name))
        assert spark.range(1).select(block.alias("y")).first().y == one


def test_many_draws_of_few_keys_are_dealt_over_tasks(spark, capsys):
    df = spark.range(400).select((F.col("id") % 2).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("label"), "id")
    out = draws.drawn_balanced(df, "g", "label", "id", 20, "s")
    out.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out  # such partitions are not joined for being small
    each = out.groupBy("g", "sample", "label").agg(F.count_distinct("id").alias("n"), F.count("*").alias("m")).collect()
    assert len(each) == 80 and all(r.n == r.m and r.n in (66, 67) for r in each)


def test_balanced_samples_are_made_in_many_tasks(spark, capsys):
    rows = [(g, i, int(i % 3 == 0)) for g in ("a", None) for i in range(30)] + [("n", i, 0) for i in range(5)] + [("p", i, 1) for i in range(4)]
    out = sampling.balanced(spark.createDataFrame(rows, "g string, id long, label int"), ["g"], "label", "id", 7, "s", most=3)
    out.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
    each = {(r.g, r.label): r["count"] for r in out.groupBy("g", "label").count().collect()}
    assert each == {("a", 0): 70, ("a", 1): 70, (None, 0): 70, (None, 1): 70, ("n", 0): 21, ("p", 1): 28}


def test_networks_run_backwards(spark):
    for n in (1, 2, 3, 5, 17, 300, 1009):
        size, name = F.lit(n).cast("long"), F.lit(f"s{n}")
        there = spark.range(n).select("id", draws.permuted(F.col("id"), size, name).alias("y"))
        back = there.select("id", draws.unpermuted(F.col("y"), size, draws.network_words(size, name)).alias("x")).collect()
        assert [r.x for r in back] == [r.id for r in back]


def test_draws_of_much_of_a_pool_are_looked_up_from_its_places(spark, monkeypatch):
    pools = [(p, i) for p, n in (("a", 1), ("b", 40), ("c", 1500)) for i in range(n)] + [("b", 7), ("b", None), (None, 3)]
    pools = spark.createDataFrame(pools, "pool string, i long")
    wants = [(p, s, p, k) for p, most in (("a", 2), ("b", 60), ("c", 1500)) for s, k in enumerate((0, 1, most // 5, most // 2, most))]
    wants = spark.createDataFrame([*wants, (None, 0, "b", 30), ("d", 0, "d", 3), ("e", 0, None, 3)], "key string, sample int, pool string, __k long")
    joined, own = [], draws._by_draws
    monkeypatch.setattr(draws, "_by_draws", lambda open_, *rest: (joined.append(open_), own(open_, *rest))[1])
    tries = wants.withColumn("__tries", F.col("__k"))
    expected = draws.tried(tries, pools, ["key", "sample"], "i", "s").select("key", "sample", "i")
    joined.clear()
    got = draws.drawn_freely(wants, pools, ["key", "sample"], "i", "s")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, expected.collect()))
    assert {(r.key, r["__k"]) for r in joined[0].collect()} == {("b", 1), ("c", 1), ("c", 300)}  # the only draws that are made and sent to the places
    # Balanced samples of labels that are about as common make no draw at all.
    df = spark.range(400).select((F.col("id") % 2).alias("g"), (F.col("id") % 4 > 1).cast("int").alias("label"), "id")
    assert draws.drawn_balanced(df, "g", "label", "id", 20, "s").count() == 8000 and joined[-1].isEmpty()
