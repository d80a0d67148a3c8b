"""Whole modes with their report files, models of all kinds saved and loaded, and the stable search against brute force."""

import glob
import json
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparlane import modes
from sparlane.operators import models, network, stable
from sparlane.sources import files, reports
from sparlane.sources import spec as sp


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), "red" if a > 4 else "blue", float(3 * a - 2 * b + (5 if a > 4 else 0))) for i, (a, b) in enumerate(rng.uniform(0, 10, (400, 2)).round(3))]
    return spark.createDataFrame(rows, "id long, a double, b double, colour string, y double").cache()


SPEC = {"version": "1.2", "variables": [
    {"label": "a", "interface": "knob", "type": "real", "range": [0, 10], "rad-abs": 0.5}, {"label": "b", "interface": "input", "type": "real", "range": [2, 3]}, {"label": "y", "interface": "output", "type": "real"},
]}


@pytest.mark.parametrize("kind", models.KINDS)
def test_models_are_saved_and_loaded(spark, points, tmp_path, kind):
    options = {"nn": {"epochs": 15}, "rf": {"numTrees": 3}, "et": {"numTrees": 3}, "gbr": {"maxIter": 2}}.get(kind, {})
    m = models.train(points, ["a", "b"], ["y"], kind, **options)
    m.save(f"{tmp_path}/{kind}")
    again = models.Fitted.load(f"{tmp_path}/{kind}")
    both = again.predict(m.predict(points).withColumnRenamed(f"y_{kind}", "first"))
    assert both.where(F.abs(F.col("first") - F.col(f"y_{kind}")) > 1e-9).count() == 0
    assert (again.kind, again.features, again.responses) == (kind, ["a", "b"], ["y"])


def test_nearest_neighbours_are_those_of_brute_force(points):
    got = models.train(points, ["a", "b"], ["y"], "knn", k=3).predict(points).toPandas()
    x, y = got[["a", "b"]].to_numpy(), got.y.to_numpy()
    want = [y[np.argsort(((x - p) ** 2).sum(1), kind="stable")[:3]].mean() for p in x]
    assert got.y_knn.to_numpy() == pytest.approx(want)


@pytest.mark.parametrize("kind", ["dt", "rf", "et", "gbr"])
def test_trees_are_their_cells(spark, points, kind):
    m = models.train(points, ["a", "b"], ["y"], kind, maxDepth=3, **{"rf": {"numTrees": 3}, "et": {"numTrees": 2}, "gbr": {"maxIter": 2}}.get(kind, {}))
    cells = stable.model_cells(spark, m)
    p, c = m.predict(points).alias("p"), cells.alias("c")
    inside = F.expr("p.a > c.lo_a AND p.a <= c.hi_a AND p.b > c.lo_b AND p.b <= c.hi_b")
    met = p.join(c, inside).select("p.id", F.col(f"p.y_{kind}").alias("x"), F.col("c.y").alias("v")).toPandas()
    assert len(met) == 400 and met.x.to_numpy() == pytest.approx(met.v.to_numpy())


def test_random_thresholds_differ_by_tree(points):
    m = models.train(points, ["a", "b"], ["y"], "et", numTrees=4, maxDepth=4).models["y"]
    cuts = {t[1] for t in m.trees}
    seen = {r["a"] for r in points.select("a").collect()} | {r["b"] for r in points.select("b").collect()}
    assert len(cuts) == 4 and not cuts & seen


def test_network_tuner(points):
    net, trials = network.tune_network(points, ["a", "b"], "y", "p", "id", {"hidden": [(2,), (8,)], "epochs": [5, 40]})
    assert len(trials) == 4 and trials[0]["score"] == min(t["score"] for t in trials)
    assert net(points).where("p IS NULL").count() == 0


def brute(spec, cells, p, f):
    """Extreme of f over the cells that a configuration's box meets."""
    out = []
    for c in cells:
        ok = True
        for v in spec.variables:
            if v.interface == "output":
                continue
            if v.interface == "knob":
                r = float(v.rad_abs) if v.rad_abs is not None else float(v.rad_rel) * abs(p[v.label])
                lo, hi = p[v.label] - r, p[v.label] + r
            else:
                lo, hi = map(float, v.range)
            ok &= hi > c[f"lo_{v.label}"] and lo <= c[f"hi_{v.label}"]
        if ok:
            out.append(f(c))
    return min(out)


@pytest.mark.parametrize("seed", range(4))
def test_stable_optimum_is_that_of_a_fine_grid(spark, seed):
    rng = np.random.default_rng(seed)
    inf = float("inf")
    xs, ys, zs = [-inf, *sorted(rng.integers(-8, 9, 4).tolist()), inf], [-inf, *sorted(rng.integers(0, 12, 3).tolist()), inf], [-inf, 0.5, inf]
    rows = [(a, b, c, d, e, f, float(rng.integers(0, 30))) for a, b in zip(xs, xs[1:]) if a < b for c, d in zip(ys, ys[1:]) if c < d for e, f in zip(zs, zs[1:])]
    cells = spark.createDataFrame([tuple(map(float, r)) for r in rows], "lo_x double, hi_x double, lo_n double, hi_n double, lo_u double, hi_u double, y double")
    s = sp.from_dict({"version": "1.2", "variables": [
        {"label": "x", "interface": "knob", "type": "real", "range": [-10, 10], "rad-rel": 0.25}, {"label": "n", "interface": "knob", "type": "int", "range": [0, 12], "rad-abs": 1},
        {"label": "u", "interface": "input", "type": "real", "range": [0, [1, 0.25][seed % 2]]}, {"label": "y", "interface": "output", "type": "real"},
    ]})
    table = [r.asDict() for r in cells.collect()]
    fine = {(x, n): brute(s, table, {"x": x, "n": n}, lambda c: c["y"]) for x in np.arange(-10, 10.001, 0.05).round(6).tolist() for n in range(13)}
    got = stable.optimize(spark, s, cells, "y").first()
    assert got["least"] >= max(fine.values())  # a narrow stable interval may lie between grid points
    assert got["least"] == brute(s, table, {"x": got["x"], "n": got["n"]}, lambda c: c["y"])
    for t in (5, 12, 20):
        status = stable.query(spark, s, cells, {"q": f"y >= {t}"}).first()
        assert status["status"] == ("PASS" if got["least"] >= t else "FAIL")
    firsts = stable.safe_points(spark, s, cells, "y >= 3", 3).collect()
    assert len(firsts) <= 3 and all(brute(s, table, {"x": r["x"], "n": r["n"]}, lambda c: c["y"]) >= 3 for r in firsts)


def test_thresholds_are_the_last_values_that_hold():
    v = sp.Variable("x", "knob", rad_abs=Fraction("0.1"))
    for e in (0.3, 1.1, -7.7, 0.0):
        low, high = stable.thresholds(v, [e])
        assert low + 0.1 <= e < np.nextafter(low, np.inf) + 0.1 and high - 0.1 <= e < np.nextafter(high, np.inf) - 0.1
    v = sp.Variable("x", "knob", rad_rel=Fraction("0.3"))
    for e in (5.0, -5.0):
        for p in stable.thresholds(v, [e]):
            up = np.nextafter(p, np.inf)
            assert (p + 0.3 * abs(p) <= e < up + 0.3 * abs(up)) or (p - 0.3 * abs(p) <= e < up - 0.3 * abs(up))


def test_train_writes_its_files_and_predict_reads_them(spark, points, tmp_path):
    out = f"{tmp_path}/out"
    common = {"features": ["a", "b", "colour"], "responses": ["y"], "row_id": "id", "out": out, "name": "run", "model_path": f"{tmp_path}/model", "scale": True, "log": "WARNING"}
    got = modes.run(spark, "train", data=points, new_data=points.drop("y"), **common)
    assert {r["part"] for r in got.collect()} == {"training", "test", "labeled"} and got.where("r2 < 0.9").count() == 0
    names = {p.split("/run_")[-1] for p in glob.glob(f"{out}/*")}
    assert {"training_predictions_summary.csv", "test_prediction_precisions.csv", "new_predictions_summary.csv"} <= names
    assert json.load(open(f"{tmp_path}/model/levels.json"))["colour"][0] in ("red", "blue")
    assert set(reports.load_scaling(f"{tmp_path}/model/scaling.json")) == {"a", "b", "colour", "y"}
    pred = modes.run(spark, "predict", data=points, new_data=points.drop("y"), use_model=True, **common)
    direct = spark.read.option("header", True).csv(f"{out}/run_new_predictions_summary.csv")
    assert pred.count() == 400 == direct.count()
    assert pred.agg(F.corr("y_dt", F.col("a") * 3 - F.col("b") * 2)).first()[0] > 0.9


def test_exploration_of_a_trained_tree(spark, points, tmp_path):
    common = {"data": points, "row_id": "id", "out": f"{tmp_path}", "name": "x", "model_options": {"maxDepth": 5}, "log": "WARNING", "train_share": 1}
    best = modes.run(spark, "optimize", spec=SPEC | {"objectives": {"y": "y"}}, **common).first()
    assert best["a"] > 8 and json.load(open(f"{tmp_path}/x_optimization_results.json"))["y"]["threshold"] == best["threshold"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/x_optimization_progress.csv").count() > 2
    got = modes.run(spark, "query", spec=SPEC | {"queries": {"low": "y >= 0", "high": f"y >= {best['threshold'] + 0.5}"}}, **common).collect()
    assert {r["name"]: r["status"] for r in got} == {"low": "PASS", "high": "FAIL"}
    assert json.load(open(f"{tmp_path}/x_query_results.json"))["low"]["witness"]["a"] is not None
    assert json.load(open(f"{tmp_path}/x_consistency.json")) == {"interface_consistent": True, "model_consistent": True}
    got = modes.run(spark, "refine", spec=SPEC | {"objectives": {"y": "y"}, "system": {"y": "3 * a - 2 * b + 5"}}, **common).first()
    assert got["rmse"] < 3
    none = modes.run(spark, "optimize", spec=SPEC | {"objectives": {"y": "y"}, "beta": "y >= 1000"}, **common)
    assert none.count() == 0 and json.load(open(f"{tmp_path}/x_optimization_results.json")) == {"status": "ERROR"}
    two = modes.run(spark, "optimize", spec=SPEC | {"objectives": {"up": "y", "down": "0 - y"}}, pareto=True, **common).collect()
    assert {r["objective"] for r in two} == {"up", "down"} and len({r["a"] for r in two}) == 1


def test_constraint_texts_make_failures_unknown(spark):
    cells = spark.createDataFrame([(0.0, 5.0, 1.0), (5.0, 10.0, 2.0)], "lo_a double, hi_a double, y double")
    s = sp.from_dict(SPEC | {"eta": "a < 3 or a > 6"})
    assert [r["status"] for r in stable.query(spark, s, cells, {"p": "y >= 2", "f": "y >= 3"}).collect()] == ["PASS", "UNKNOWN"]


def test_command_line(spark, points, tmp_path, capsys):
    points.write.parquet(f"{tmp_path}/points.parquet")
    assert modes.main(["correlate", "--data", f"{tmp_path}/points.parquet", "--features", '["a", "b"]', "--responses", '["y"]', "--estimators", '["pearson"]', "--log", "WARNING"]) == 0
    assert "ranking" in capsys.readouterr().out
    files.save_json(f"{tmp_path}/saved.json", {"bins": 3, "features": ["a"]})
    out = modes.run(spark, "discretize", data=f"{tmp_path}/points.parquet", config=f"{tmp_path}/saved.json", log="WARNING")
    assert {r["a"] for r in out.select("a").distinct().collect()} == {"Bin0", "Bin1", "Bin2"}
    with pytest.raises(ValueError):
        modes.run(spark, "nothing")
    with pytest.raises(ValueError):
        modes.run(spark, "correlate", unknown=1)


def test_missing_values_as_a_file(spark, tmp_path):
    places = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "column string, row long")
    reports.save_missing(f"{tmp_path}/missing.json", places)
    assert json.load(open(f"{tmp_path}/missing.json")) == {"a": [1, 3], "b": [2]}
    with pytest.raises(ValueError):
        reports.save_missing(f"{tmp_path}/missing.json", places, most=2)


HILL = {
    "version": "1.2",
    "variables": [{"label": "a", "interface": "knob", "type": "real", "range": [0, 20], "rad-abs": 1.0}, {"label": "b", "interface": "knob", "type": "real", "range": [-5, 5], "rad-abs": 0.5}, {"label": "y", "interface": "output", "type": "real"}],
    "queries": {"high": "y >= 90", "low": "y >= 60"}, "assertions": {"fair": "y >= 60"}, "configurations": {"top": {"a": "12", "b": "1"}, "edge": {"a": "0", "b": "-5"}},
    "witnesses": {"low": {"a": "12", "b": "1"}, "high": {"a": "0", "b": "0"}}, "objectives": {"best": "y"},
}


def _hill(spark):
    x = spark.range(1600).select(((F.col("id") % 40) / 2).alias("a"), (F.floor(F.col("id") / 40) / 4 - 5).alias("b"))
    return x.withColumn("y", 80 - F.pow(F.col("a") - 12, 2) - F.pow(F.col("b") - 1, 2))


@pytest.mark.parametrize("scale", [False, True])
def test_polynomials_are_explored(spark, scale, tmp_path):
    """y = 80 - (a - 12)^2 - (b - 1)^2: 78.75 is the greatest least value of a box. Scaled and unscaled, trained and loaded."""
    common = {"spec": HILL, "model": "poly", "scale": scale, "train_share": 1, "log": "WARNING"}
    got = {r["name"]: r for r in modes.run(spark, "query", data=_hill(spark), model_path=f"{tmp_path}/m", **common).collect()}
    assert got["high"].status == "FAIL" and got["low"].status == "PASS" and (got["low"].witness.a - 12) ** 2 < 20
    again = {r["name"]: r["status"] for r in modes.run(spark, "query", use_model=True, model_path=f"{tmp_path}/m", **common).collect()}
    assert again == {"high": "FAIL", "low": "PASS"}
    verified = {r["configuration"]: r for r in modes.run(spark, "verify", data=_hill(spark), **common).collect()}
    assert verified["top"].status == "PASS" and verified["edge"].status == "FAIL" and verified["edge"].counter_example.a <= 1
    certified = {r["query"]: r["status"] for r in modes.run(spark, "certify", data=_hill(spark), **common).collect()}
    assert certified == {"low": "stable witness", "high": "not a witness"}
    best = modes.run(spark, "optimize", data=_hill(spark), epsilon=0.02, **common).first()
    assert abs(best["threshold"] - 78.75) < 0.02 * 400 and abs(best["a"] - 12) < 4
    assert modes.run(spark, "synthesize", data=_hill(spark), **common).first()["status"] == "PASS"


def test_scaled_trees_are_explored(spark):
    common = {"spec": HILL, "model": "dt", "data": _hill(spark), "train_share": 1, "log": "WARNING"}
    got = [[tuple(r) for r in modes.run(spark, "query", scale=scale, **common).select("name", "status").collect()] for scale in (False, True)]
    assert got[0] == got[1]
    best = [modes.run(spark, "optimize", scale=scale, **common).first()["threshold"] for scale in (False, True)]
    assert best[0] == pytest.approx(best[1], rel=1e-6)


def test_a_saved_model_predicts_alone(spark, tmp_path):
    data = _hill(spark).withColumn("kind", F.when(F.col("a") > 6, "late").otherwise("early"))
    for kind in ("dt", "nn"):
        common = {"features": ["a", "b", "kind"], "responses": ["y"], "scale": True, "train_share": 1, "model": kind, "model_path": f"file://{tmp_path}/{kind}", "log": "WARNING"}
        both = modes.run(spark, "predict", data=data, new_data=data.drop("y"), **common)
        alone = modes.run(spark, "predict", new_data=data.drop("y"), use_model=True, model_path=f"file://{tmp_path}/{kind}", log="WARNING")
        key = lambda df, kind=kind: sorted((r["a"], r["b"], round(r[f"y_{kind}"], 6)) for r in df.collect())
        assert key(both) == key(alone) and alone.count() == 1600


def test_given_rows_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(i):
        seen.add(1)
        return (i, float(i % 7), float(i % 3), float(i % 7 > 4))

    df = spark.createDataFrame(spark.sparkContext.parallelize(range(140), 2).map(read), "id long, a double, b double, y double")
    out = modes.run(spark, "subgroups", data=df, row_id="id", features=["a", "b"], responses=["y"], measure="mean_1", depth=2, top=3, log="WARNING")
    assert out.count() > 0 and seen.value == 140
