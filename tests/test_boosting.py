"""Leaf-wise boosting against a plain single-machine version that splits one leaf at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexcast.operators import boosting as B


def plain_fit(x, y, edges, shape):
    """Best-first growth with full histograms of every leaf, one split at a time."""
    bins = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    width = max(len(e) for e in edges) + 1
    pred = np.full(len(y), y.mean())
    for _ in range(shape.trees):
        g = y - pred

        def split(rows, g=g):
            hist = np.zeros((x.shape[1], width, 2))
            for k in range(x.shape[1]):
                hist[k, :, 0] = np.bincount(bins[rows, k], g[rows], width)
                hist[k, :, 1] = np.bincount(bins[rows, k], minlength=width)
            return B.best_split(hist, shape)

        leaves = [(np.arange(len(y)), 0)]
        while len(leaves) < shape.leaves:
            ready = [(s[0], k, s) for k, (rows, depth) in enumerate(leaves) if depth < shape.depth and (s := split(rows))]
            if not ready:
                break
            _, k, (_, f, b) = max(ready, key=lambda r: r[0])
            rows, depth = leaves.pop(k)
            left = bins[rows, f] <= b
            leaves += [(rows[left], depth + 1), (rows[~left], depth + 1)]
        for rows, _ in leaves:
            pred[rows] += shape.rate * B._value(g[rows].sum(), len(rows), shape)
    return pred


def table(n=900, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 3)
    y = np.round(np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) * x[:, 2] + rng.normal(size=n) * 0.1, 4)
    return x, y


@pytest.mark.parametrize("shape", [B.Shape(trees=4, rate=0.3, leaves=7, depth=5, rows=20, bins=16), B.Shape(trees=3, rate=0.5, leaves=63, depth=4, rows=5, bins=8)])
def test_equal_to_the_plain_version(spark, shape):
    x, y = table()
    rows = spark.createDataFrame([(h, *map(float, r), float(t) * h) for h in (1, 2) for r, t in zip(x, y, strict=True)], "horizon int, a double, b double, c double, d double, y double")
    rows = rows.unionByName(rows.limit(3).withColumn("y", F.lit(None).cast("double")))
    model = B.fit(rows, list("abcd"), "y", "horizon", shape)
    got = {(r["horizon"], r["a"], r["b"]): r["p"] for r in model.predict(rows, "horizon", "p").collect()}
    for h in (1, 2):
        want = plain_fit(x, y * h, model.edges, shape)
        assert max(abs(got[h, r[0], r[1]] - w) for r, w in zip(x.tolist(), want, strict=True)) < 1e-6
        assert np.abs(want - y * h).mean() < np.abs(y * h - (y * h).mean()).mean()


def test_absent_features_nulls_and_unknown_groups(spark):
    x, y = table(200)
    rows = spark.createDataFrame([(1, *map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "horizon int, a double, b double, c double, d double, y double")
    model = B.fit(rows, list("abcd"), "y", "horizon", B.Shape(trees=2, leaves=5, rows=10))
    zero = model.predict(rows.withColumn("c", F.lit(0.0)), "horizon", "p").select("a", "b", "p")
    bare = model.predict(rows.drop("c"), "horizon", "p").select("a", "b", "p")
    null = model.predict(rows.withColumn("c", F.lit(None).cast("double")), "horizon", "p").select("a", "b", "p")
    assert sorted(map(tuple, zero.collect())) == sorted(map(tuple, bare.collect())) == sorted(map(tuple, null.collect()))
    assert [r["p"] for r in model.predict(rows.limit(2).withColumn("horizon", F.lit(9)), "horizon", "p").collect()] == [None, None]
    none = B.fit(rows.where("false"), ["a"], "y", "horizon", B.Shape(trees=1))
    assert none.predict(rows.limit(1), "horizon", "p").first()["p"] is None
