"""Least values in boxes against all pairs, with slabs small enough for small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparlane.operators import boxes, minima


def plain(x, y, values, box):
    inside = (x >= box[0]) & (x <= box[1]) & (y >= box[2]) & (y <= box[3])
    return inside.any(), [np.nan if np.isnan(v[inside]).all() else np.nanmin(v[inside]) for v in values]


@pytest.mark.parametrize("m", [0, 1, 2, 7, 64, 300])
def test_range_minima(m):
    rng = np.random.default_rng(m)
    x, y, v = rng.integers(0, 20, m).astype(float), rng.normal(size=m).round(1), rng.normal(size=(2, m))
    v[rng.random((2, m)) < 0.2] = np.nan
    a, b = rng.integers(-2, 20, 400).astype(float), rng.normal(size=400).round(1)
    box = np.stack([a, a + rng.integers(0, 9, 400), b, b + rng.exponential(1, 400)], 1)
    box[:9, 0], box[5:15, 3] = -np.inf, np.inf
    least, hit = minima.range_minima(x, y, v, box)
    for k in range(400):
        some, want = plain(x, y, v, box[k])
        assert hit[k] == some and np.array_equal(least[:, k], want if some else [np.nan] * 2, equal_nan=True)


@pytest.mark.parametrize(("slab", "chunk"), [(40, 30), (7, 1000), (10_000, 100)])
@pytest.mark.parametrize("axes", [1, 2])
def test_stable_minima_over_slabs(spark, monkeypatch, slab, chunk, axes):
    monkeypatch.setattr(minima, "SLAB", slab)
    monkeypatch.setattr(minima, "CHUNK", chunk)
    rng = np.random.default_rng(slab)
    n = 500
    x = np.where(rng.random(n) < 0.4, 5.0, rng.normal(5, 3, n).round(1))
    y, o = rng.integers(0, 50, n).astype(float), rng.integers(0, 1000, n)
    rows = [(i, float(x[i]), float(y[i]), float(o[i]) if i % 11 else None, int(o[n - 1 - i])) for i in range(n)] + [(n, None, 3.0, -5.0, 1), (n + 1, float("nan"), 4.0, -6.0, 2), (3, 5.0, 7.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "id int, x double, y double, a double, b int")
    wanted = [boxes.Axis("x", rad_rel=0.2, lo=1.0), boxes.Axis("y", rad_abs=4)][:axes]
    got = {r[0]: tuple(r) for r in boxes.stable_minima(df, "id", wanted, ["a", "b"]).collect()}
    want = {r[0]: tuple(r) for r in boxes._joined_minima(df, "id", wanted, ["a", "b"]).collect()}
    assert got == want and [f.dataType.simpleString() for f in boxes.stable_minima(df, "id", wanted, ["a", "b"]).schema] == ["int", "double", "int"]


def test_minima_of_nothing(spark):
    df = spark.createDataFrame([], "id int, x double, y double, a double")
    assert boxes.stable_minima(df, "id", [boxes.Axis("x", rad_abs=1), boxes.Axis("y", rad_abs=1)], ["a"]).count() == 0
    three = spark.range(20).select(F.col("id").cast("int").alias("id"), *[(F.col("id") % k).cast("double").alias(c) for c, k in (("x", 3), ("y", 4), ("z", 5))], F.col("id").cast("double").alias("a"))
    assert boxes.stable_minima(three, "id", [boxes.Axis(c, rad_abs=1) for c in "xyz"], ["a"]).count() == 20
