import random

from pyspark.sql import functions as F

from rankspark.operators import metrics, ranges, ranking


def test_one_long_file_is_split_and_ties_at_borders_are_ordered(spark):
    draw = random.Random(2)
    rows = [("long", draw.choice([0.5, 0.5, 0.5, draw.random()]), i, int(draw.random() < 0.1)) for i in range(40_000)]
    rows += [("a", 0.1, 1, 0), ("a", 0.1, 0, 1), ("none", 0.3, 0, 0), (None, float("nan"), 0, 1), (None, 2.0, 1, 0), (None, None, 2, 0)]
    df = spark.createDataFrame(rows, "f string, s double, i long, label int").repartition(8)
    out = ranking.ranked(df, ["f"], "s", ["i"], ["label"], parts=8)
    assert out.where("f = 'long'").select(ranges.PART).distinct().count() >= 4
    assert out.groupBy("f", ranges.PART).count().agg(F.max("count")).first()[0] < 20_000
    got = {(r.f, r.i): (r["rank"], r.n) for r in out.collect()}
    hits = {(r.f, r.i): r.hits for r in out.select("f", "i", ranges.running(out, ["f"], "label").alias("hits")).collect()}
    for f in ("long", "a", "none", None):
        own = sorted((r for r in rows if r[0] == f), key=lambda r: (-(r[1] if r[1] is not None and r[1] == r[1] else -1.0), r[2]))
        seen = 0
        for k, r in enumerate(own):
            seen += r[3]
            assert got[f, r[2]] == (k + 1, len(own)) and hits[f, r[2]] == seen
    curve = {r.top_k: r.success_rate for r in ranking.rate_curve(out, ["f"], "f", "label", 0.5).where("f = 'long'").collect()}
    own = sorted((r for r in rows if r[0] == "long"), key=lambda r: (-r[1], r[2]))
    assert len(curve) == 20_000 and abs(curve[20_000] - sum(r[3] for r in own[:20_000]) / sum(r[3] for r in own)) < 1e-12
    assert {(r.f, r.position, r.ordinal) for r in ranking.positive_positions(out, ["f"], "label").where("f IS NULL OR f <> 'long'").collect()} == {("a", 0.0, 1), ("none", -1.0, 0), (None, 1 / 3, 1)}
    assert ranking.ranked(df.where("false"), ["f"], "s", ["i"], ["label"]).collect() == []


def test_areas_of_a_long_curve(spark, monkeypatch):
    deal = ranges.in_ranges
    monkeypatch.setattr(ranges, "in_ranges", lambda *a: deal(*a, 6))
    n = 30_000
    df = spark.range(n).select(F.lit("d").alias("d"), F.col("id").cast("double").alias("x"), (F.col("id") * F.col("id") % 997).cast("double").alias("y"))
    ys = [i * i % 997 for i in range(n)]
    want = {c: sum((a + b) / 2 for a, b in zip(ys[: int(c * (n - 1)) + 1], ys[1 : int(c * (n - 1)) + 1], strict=False)) for c in (0.5, 1.0)}
    half = 0.5 * (n - 1)
    cut = ys[int(half)] + (half - int(half)) * (ys[int(half) + 1] - ys[int(half)])
    want[0.5] += (half - int(half)) * (ys[int(half)] + cut) / 2
    got = {r.cutoff: r.area for r in metrics.partial_areas(df, "d", "x", "y", [0.5, 1.0]).collect()}
    assert all(abs(got[c] - want[c] / (n - 1)) < 1e-6 for c in want)
