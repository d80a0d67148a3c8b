"""Bounds and exploration of networks and polynomials against dense sampling and closed forms."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparlane.functions import expressions as ex
from sparlane.operators import models, smooth
from sparlane.operators.network import forward, initial, interval_forward
from sparlane.sources import spec as sp


def test_network_bounds_hold_and_are_closer_than_intervals():
    rng = np.random.default_rng(0)
    wider = 0
    for seed in range(12):
        layers = [(w, b + rng.normal(0, 0.3, b.size)) for w, b in initial([3, 8, 6, 2], seed)]
        a = rng.uniform(-1, 1, (5, 3))
        lo, hi = a, a + rng.uniform(0, 0.6, (5, 3))
        low, high = smooth.network_bounds(layers, lo, hi)
        for k in range(5):
            y = forward(layers, rng.uniform(lo[k], hi[k], (3000, 3)))[-1]
            assert (y >= low[k]).all() and (y <= high[k]).all()
            plain = interval_forward(layers, lo[k], hi[k])
            wider += ((plain[1] - plain[0]) >= (high[k] - low[k]) - 1e-9).all()
    assert wider >= 55


def test_bernstein_bounds_hold_and_are_exact_in_corners():
    rng = np.random.default_rng(1)
    for shape in ((4,), (3, 3), (2, 4, 3)):
        coef = rng.normal(size=shape)
        m = smooth.Smooth(list("abc")[: len(shape)], {"y": coef})
        a = rng.uniform(-2, 2, (6, len(shape)))
        lo, hi = a, a + rng.uniform(0, 1.5, a.shape)
        low, high = smooth.bernstein_bounds(coef, lo, hi)
        for k in range(6):
            x = rng.uniform(lo[k], hi[k], (2000, len(shape)))
            y = m.values(x)["y"]
            want = sum(c * np.prod([x[:, j] ** p for j, p in enumerate(i)], 0) for i, c in np.ndenumerate(coef))
            assert np.allclose(y, want) and (y >= low[k]).all() and (y <= high[k]).all()
            corners = m.values(np.array(list(itertools.product(*zip(lo[k], hi[k], strict=True)))))["y"]
            tiny = smooth.bernstein_bounds(coef, lo[k : k + 1], lo[k : k + 1] + 1e-7)
            assert tiny[1][0] - tiny[0][0] < 1e-4 and low[k] <= corners.min() + 1e-9
    line = np.array([[0.0, 2.0], [3.0, 0.0]])  # linear: exact
    assert np.allclose(smooth.bernstein_bounds(line, np.array([[0.0, 1.0]]), np.array([[2.0, 4.0]])), [[2.0], [14.0]])


def _spec(**more):
    variables = [
        {"label": "a", "interface": "knob", "type": "real", "range": [-2, 2], "rad-abs": 0.25}, {"label": "b", "interface": "knob", "type": "int", "range": [-2, 3], "rad-abs": 0.5},
        {"label": "c", "interface": "input", "type": "real", "range": [-1, 1]}, {"label": "y", "interface": "output", "type": "real"},
    ]
    return sp.from_dict({"version": "1.2", "variables": variables} | more)


#: y = 5 - (a - 1)^2 - (b - 2)^2 + c / 2
HILL = smooth.Smooth(["a", "b", "c"], {"y": smooth.polynomial_tensor({(0, 0, 0): 0.0, (1, 0, 0): 2.0, (2, 0, 0): -1.0, (0, 1, 0): 4.0, (0, 2, 0): -1.0, (0, 0, 1): 0.5})})


def test_stable_queries_on_a_polynomial(spark):
    # greatest stable minimum: a = 1, b = 2, at the edges of the box and c = -1: 5 - 1/16 - 1/4 - 1/2
    top = 5 - 0.0625 - 0.25 - 0.5
    got = {r["name"]: r for r in smooth.as_queries(spark, HILL, _spec(), {str(t): f"y >= {t}" for t in (top - 0.05, top + 0.02, 1.0)}).collect()}
    assert [got[str(t)].status for t in (1.0, top - 0.05, top + 0.02)] == ["PASS", "PASS", "FAIL"]
    at = got[str(top - 0.05)].witness
    assert at.b == 2 and abs(at.a - 1) < 0.15
    best = smooth.optimize(spark, HILL, _spec(), "y", epsilon=0.01)
    assert best["lower"] <= top <= best["upper"] and best["upper"] - best["lower"] < 0.5 and best["configuration"]["b"] == 2
    none = smooth.query(spark, HILL, _spec(eta="a + b <= 0"), "y >= 3")
    assert none[0] == "FAIL" and smooth.query(spark, HILL, _spec(eta="a + b <= 0"), "y >= -5")[0] == "PASS"


def test_verify_many_configurations(spark):
    rows = spark.range(60).select(F.col("id").alias("configuration"), (F.col("id") % 9 / 2 - 2).alias("a"), (F.col("id") % 6 - 2).alias("b"))
    got = {r.box: r for r in smooth.verify(HILL, rows, _spec(), "y >= 1").collect()}
    for r in rows.collect():
        worst = 5 - max((r.a + s * 0.25 - 1) ** 2 for s in (-1, 1)) - max((r.b + s * 0.5 - 2) ** 2 for s in (-1, 1)) - 0.5
        assert got[r.configuration].status == ("PASS" if worst >= 1 else "FAIL")
        x = got[r.configuration].counter_example
        assert (x is None) == (worst >= 1) and (x is None or HILL.values(np.array([x]))["y"][0] < 1)
    assert {r.status for r in smooth.verify(HILL, rows.limit(1), _spec(), "y * y >= -1 and y <= y", budget=1, rounds=1).collect()} == {"UNKNOWN"}


def test_stable_queries_on_a_network(spark):
    x = spark.range(900).select(((F.col("id") % 30) / 7.5 - 2).alias("a"), (F.floor(F.col("id") / 30) / 6 - 2).alias("b"))
    data = x.withColumn("y", 4 - F.abs(F.col("a") - 0.5) - F.abs(F.col("b") - 1))
    m = models.train(data, ["a", "b"], ["y"], "nn")
    net = smooth.smooth_model(m)
    s = sp.from_dict({"version": "1.2", "variables": [{"label": n, "interface": "knob", "type": "real", "range": [-2, 2], "rad-abs": 0.2} for n in "ab"] + [{"label": "y", "interface": "output", "type": "real"}]})
    grid = np.stack(np.meshgrid(np.linspace(-2, 2, 81), np.linspace(-2, 2, 81), indexing="ij"), -1).reshape(-1, 2)
    wide = np.stack(np.meshgrid(np.linspace(-2.2, 2.2, 89), np.linspace(-2.2, 2.2, 89), indexing="ij"), -1)
    value = net.values(wide.reshape(-1, 2))["y"].reshape(89, 89)
    least = np.array([value[i : i + 9, j : j + 9].min() for i in range(81) for j in range(81)])
    top = float(least.max())
    assert smooth.query(spark, net, s, f"y >= {top - 0.15}")[0] == "PASS" and smooth.query(spark, net, s, f"y >= {top + 0.1}")[0] == "FAIL"
    some = spark.createDataFrame([(i, float(grid[i, 0]), float(grid[i, 1])) for i in range(0, 6561, 400)], "configuration int, a double, b double")
    for r in smooth.verify(net, some, s, f"y >= {top - 1}").collect():
        assert r.status == "FAIL" if least[r.box] < top - 1.02 else r.status == "PASS" if least[r.box] > top - 0.98 else True


@pytest.mark.parametrize("kind", ["poly", "linear"])
def test_fitted_polynomials_give_their_predictions(spark, kind):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(2 * a - b + (a * b - a * a if kind == "poly" else 0))) for a, b in rng.uniform(-1, 1, (80, 2))]
    data = spark.createDataFrame(rows, "a double, b double, y double")
    m = models.train(data, ["a", "b"], ["y"], kind)
    got = smooth.smooth_model(m).values(np.array([r[:2] for r in rows]))["y"]
    want = [r[f"y_{kind}"] for r in m.predict(data).collect()]
    assert np.allclose(got, want, atol=1e-6)
    assert isinstance(ex.parse("y >= 1"), ex.Node)


def test_more_boxes_than_the_budget_are_all_opened(spark):
    model = smooth.Smooth(["x"], {"y": smooth.polynomial_tensor({(0,): 0.0, (1,): 1.0})})
    boxes = spark.range(12_000).select(F.col("id").alias("box"), F.col("id").cast("double").alias("lo_x"), (F.col("id") + 0.5).alias("hi_x")).coalesce(1)
    got = {r["status"]: r["count"] for r in smooth.verify_boxes(model, boxes, "y >= 5999.75", budget=1, rounds=1).groupBy("status").count().collect()}
    assert got == {"PASS": 6000, "FAIL": 6000}
