import numpy as np
from pyspark.sql import functions as F

from rankspark.operators import adaptation


def plain(x, y, rate, steps, clip, weights, patience, progress):
    """The loop for one key with both classes' weights."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, c = np.zeros((2, x.shape[1])), np.where(y == 1, weights[1], weights[0])
    best, best_loss, losses, wait = w, np.inf, [], 0
    for k in range(steps):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = float(-(c * np.log(p[np.arange(len(y)), y])).sum() / c.sum())
        losses.append(loss)
        if k and loss < best_loss - progress:
            best, best_loss, wait = w, loss, 0
        elif k:
            wait += 1
        if wait >= patience:
            break
        g = ((p - np.eye(2)[y]) * c[:, None]).T @ x / c.sum()
        w = w - rate * g * (min(1.0, clip / (np.sqrt((g**2).sum()) + 1e-6)) if clip else 1.0)
        if k == 0:
            best, best_loss = w, loss
    z = x @ best.T
    return losses, best[1] - best[0]


def test_all_keys_equal_a_plain_loop(spark):
    draw, data = np.random.default_rng(1), {}
    for key in range(6):
        n = int(draw.integers(4, 40))
        y = draw.integers(0, 2, n)
        data[key] = draw.normal(size=(n, 3)) + (y[:, None] * (key - 2)), y
    rows = [(k, [float(v) for v in r], int(t)) for k, (x, y) in data.items() for r, t in zip(x, y, strict=True)] + [(0, None, 1), (0, [1.0, 2.0, 3.0], None), (9, None, 0)]
    df = spark.createDataFrame(rows, "k int, x array<double>, y int")
    for rate, steps, clip, weights, progress in ((0.3, 18, None, (1.0, 1.0), 1e-4), (0.5, 15, 0.2, (2.0, 1.0), 5e-3), (8.0, 16, None, (1.0, 1.0), 1e-4)):
        got = {r.k: r for r in adaptation.adapt(df, "k", "x", "y", 3, rate, steps, clip=clip, class_weights=weights, progress=progress).collect()}
        assert set(got) == set(data)
        stopped = 0
        for k, (x, y) in data.items():
            losses, best = plain(x, y, rate, steps, clip, weights, 10, progress)
            assert np.allclose(got[k].losses, losses) and np.allclose(got[k].weights, best), (k, rate)
            stopped += len(losses) < steps
    assert stopped
    scores = adaptation.adapted_scores(df.where("x IS NOT NULL AND k = 5"), adaptation.adapt(df, "k", "x", "y", 3, 0.3, 10), "k", "x")
    assert scores.where((F.col("score") > 0.5).cast("int") == F.col("y")).count() > 0.8 * len(data[5][1])


def test_memory_of_one_slot_is_its_layer(spark):
    slots = adaptation.memory(spark.createDataFrame([(0, [1.0, 0.0], [0.0, 0.0, 2.0])], "s int, a array<double>, w array<double>"), "s", "a", "w")
    keys = spark.createDataFrame([("p", [3.0, 4.0]), ("q", [0.0, 0.0])], "k string, q array<double>")
    pairs = spark.createDataFrame([("p", 1, [5.0, 6.0]), ("q", 2, [5.0, 6.0])], "k string, i int, x array<double>")
    got = {r.i: r.score for r in adaptation.memory_scores(keys, pairs, slots, "k", "q", "x").collect()}
    assert abs(got[1] - 1 / (1 + np.exp(-2.0))) < 1e-12 and abs(got[2] - got[1]) < 1e-12
