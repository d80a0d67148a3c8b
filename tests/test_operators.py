"""Operators against brute force on small tables, and their edges."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparlane.functions import expressions as ex
from sparlane.operators import association, boxes, design, discretize, explore, models, prep, ranks, selection, subgroups, windows
from sparlane.sources import files
from sparlane.sources import spec as sp


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(-9, 9), round(rng.uniform(-5, 5), 2), rng.randint(0, 6), rng.randint(0, 6)) for i in range(120)] + [(200, 0, 0.0, 3, 3), (201, 0, 0.0, 3, 3)]
    return spark.createDataFrame(rows, "id long, x int, y double, u int, v int"), rows


def test_skyline_and_box_join(points):
    df, rows = points
    want = {r[0] for r in rows if not any(s[3] >= r[3] and s[4] >= r[4] and (s[3] > r[3] or s[4] > r[4]) for s in rows)}
    assert {r["id"] for r in boxes.skyline(df.repartition(5), ["u", "v"]).collect()} == want
    axes = [boxes.Axis("x", rad_abs=2), boxes.Axis("y", rad_rel=0.5)]
    low = {r["id"]: (r["u"], r["v"]) for r in boxes.stable_minima(df, "id", axes, ["u", "v"]).collect()}
    for r in rows:
        near = [s for s in rows if abs(s[1] - r[1]) <= 2 and r[2] - abs(r[2]) * 0.5 <= s[2] <= r[2] + abs(r[2]) * 0.5]
        assert low[r[0]] == (min(s[3] for s in near), min(s[4] for s in near))
    b = boxes.with_boxes(df, axes).select("id", "lo_x", "hi_x", "lo_y", "hi_y")
    assert boxes.box_join(df, b, ["x", "y"], salt=3).count() == boxes.box_join(df, b, ["x", "y"]).count()
    assert boxes.skyline(df.where("id < 0"), ["u", "v"]).count() == 0


def test_open_boxes_fall_back(points):
    df, rows = points
    axes = [boxes.Axis("x"), boxes.Axis("y", lo=-1)]
    got = boxes.stable_minima(df, "id", axes, ["u"]).agg(F.max("u")).first()[0]
    assert got == min(r[3] for r in rows)


def test_kendall_mi_and_jenks(spark, points):
    df, rows = points
    c = d = tx = ty = 0
    for a, b in itertools.combinations(rows, 2):
        s = (a[3] - b[3]) * (a[4] - b[4])
        c, d = c + (s > 0), d + (s < 0)
        tx, ty = tx + (a[3] == b[3] and a[4] != b[4]), ty + (a[4] == b[4] and a[3] != b[3])
    got = association.kendall(df, "u", "v").first()
    assert got["tau_b"] == pytest.approx((c - d) / math.sqrt((c + d + tx) * (c + d + ty)))
    assert got["tau_a"] == pytest.approx((c - d) / (len(rows) * (len(rows) - 1) / 2))
    assert association.adjusted_mi(df, "u", "u") == pytest.approx(1)
    values, counts = np.array([1.0, 2, 10, 11, 12, 50]), np.array([2.0, 1, 1, 3, 1, 1])
    best = min(itertools.combinations(range(5), 2), key=lambda cut: sum(((values[i:j] - (values[i:j] * counts[i:j]).sum() / counts[i:j].sum()) ** 2 * counts[i:j]).sum() for i, j in zip((0, cut[0] + 1, cut[1] + 1), (cut[0] + 1, cut[1] + 1, 6), strict=True)))
    assert discretize.natural_breaks(values, counts, 3) == [values[i] for i in best]


def test_ranks_and_bins_keep_nulls(spark):
    df = spark.createDataFrame([(i, float(i % 7) if i % 5 else None) for i in range(60)], "id int, v double")
    got = ranks.with_rank(df, "v", "r", "average").toPandas()
    assert got.v.isna().equals(got.r.isna())
    want = got.v.rank(method="average")
    assert np.allclose(got.r.dropna(), want.dropna())
    for a in ("uniform", "quantile", "kmeans", "jenks", "ordinals", "ranks"):
        out = discretize.discretize(df, ["v"], a, 3)
        assert out.where("v IS NULL").count() == 12 and out.columns == ["id", "v"]
    constant = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert discretize.discretize(constant, ["v"], "uniform", 4, result="integer").distinct().count() == 1
    nothing = spark.createDataFrame([(None,)], "v double")
    assert discretize.discretize(nothing, ["v"], "jenks", 4).first()[0] is None


def test_prep_edges(spark):
    df = spark.createDataFrame([(1, "b", None, 3.0), (2, "a", None, 3.0), (3, "b", None, float("nan"))], "id int, c string, n double, k double")
    clean = files.nan_to_null(df)
    assert prep.constant_columns(clean, keep=["id"]) == ["n", "k"]
    assert [tuple(r) for r in prep.levels(df, "c", "id").orderBy("code").collect()] == [("b", 0), ("a", 1)]
    new = spark.createDataFrame([(9, "z")], "id int, c string")
    with pytest.raises(Exception, match="unknown level"):
        prep.encode(new, "c", prep.levels(df, "c", "id")).collect()
    assert prep.impute_mode(clean, ["k", "n", "c"]).select("k", "n").distinct().collect() == [(3.0, None)]
    swapped = prep.relabel(spark.createDataFrame([(0,), (1,), (None,)], "y int"), "y", 0, 1)
    assert [r[0] for r in swapped.collect()] == [1, 0, None]
    with pytest.raises(ValueError):
        prep.check_responses(df, ["nope"])
    assert not prep.check_responses(df, ["nope"], new=True)
    assert prep.sample(df, "id", 10).count() == 10
    assert prep.identical_columns(df.withColumn("d", F.col("id"))) == [("id", "d")]


def test_spec(spark):
    old = {"version": "1.1", "spec": [{"label": "x", "interface": "knob", "type": "float", "bounds": [-2, None], "rad-rel": 0.1, "safe": [1, 2, 3, 4, 5]}, {"label": "y", "interface": "response", "type": "float"}], "objectives": {"o": "y"}}
    s = sp.from_dict(old)
    assert s.variables[0].range == (Fraction(-2), None) and s.variables[1].interface == "output"
    assert [tuple(map(int, p.variables[0].grid)) for p in sp.split(s, {"x": 2})] == [(1, 3, 5), (2, 4)]
    assert s.table(spark).count() == 2 and sp.grid_points(spark, s).count() == 5
    for bad in ({"interface": "output", "range": [0, 1]}, {"interface": "knob"}, {"interface": "knob", "rad-abs": 1, "rad-rel": 1}, {"interface": "input", "grid": [1]}):
        with pytest.raises(sp.SpecError):
            sp.from_dict({"version": "1.2", "variables": [{"label": "x", "type": "real", **bad}]})
    assert files.parse_domain("x -- [0, 1/2]\ny -- {1, 2}") == {"x": (0, Fraction(1, 2)), "y": [1, 2]}


def test_designs(spark):
    levels = {"a": [0, 1], "b": [10, 20], "c": [5, 6]}
    lhs = design.latin_hypercube(spark, levels, 37).toPandas()
    for c, (lo, hi) in levels.items():
        assert sorted(np.floor((lhs[c] - lo) / (hi - lo) * 37).astype(int).clip(0, 36)) == list(range(37))
    pb = design.plackett_burman(spark, {f"x{i}": [-1, 1] for i in range(11)}).toPandas().to_numpy()
    assert (pb.T @ pb == 12 * np.eye(11)).all()
    ccd = design.central_composite(spark, levels).toPandas()
    assert len(ccd) == 8 + 6 + 8
    h = design.halton(spark, {"a": [0, 1]}, 7).toPandas().a.tolist()
    assert h == [0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]


def test_tree_boxes_are_the_tree(spark, points):
    df, _ = points
    for kind in ("dt", "rf"):
        m = models.train(df, ["x", "y"], ["u"], kind, maxDepth=4, **({"numTrees": 3} if kind == "rf" else {}))
        leaves = models.leaf_boxes(spark, m.models["u"], ["x", "y"])
        one = models.forest_boxes(leaves, ["x", "y"])
        j = m.predict(df).alias("d").join(one.alias("l"), (F.col("d.x") > F.col("l.lo_x")) & (F.col("d.x") <= F.col("l.hi_x")) & (F.col("d.y") > F.col("l.lo_y")) & (F.col("d.y") <= F.col("l.hi_y")))
        got = j.select("d.id", F.abs(F.col(f"u_{kind}") - F.col("l.value")).alias("gap")).toPandas()
        assert len(got) == df.count() and got.gap.max() < 1e-9
    p = models.train(df, ["x", "y"], ["u"], "poly")
    col, text = models.polynomial_term(p.models["u"], ["x", "y"])
    assert p.predict(df).select(F.max(F.abs(col - F.col("u_poly")))).first()[0] < 1e-9 and "x * y" in text


def test_explore_statuses():
    box = {"x": (-2.0, 2.0)}
    assert explore.decide(ex.parse("x * x < 0.25 and x > 0.1"), box)[0] == "sat"
    assert explore.decide(ex.parse("x * x < -0.1"), box)[0] == "unsat"
    assert explore.decide(ex.parse("x * x == 2"), box, rounds=4)[0] == "unknown"
    lo, hi, at = explore.maximum(ex.parse("x - x * x"), box, 1e-3)
    assert lo <= 0.25 <= hi + 1e-9 and hi - lo <= 2e-3 and abs(at["x"] - 0.5) < 0.1


def test_selection_and_subgroups(spark):
    rng = random.Random(1)
    rows = [(rng.random(), rng.random(), rng.choice("ab")) for _ in range(300)]
    df = spark.createDataFrame([(a, b, c, 3 * a + 0.1 * b, int(c == "a" and a > 0.5)) for a, b, c in rows], "a double, b double, c string, y double, t int")
    assert selection.mrmr(df, ["a", "b"], "y")[0][0] == "a"
    best = subgroups.beam_search(df, ["a", "c"], "t", "wracc", depth=2, top=5)
    assert best[0][1][0].feature == "c" and any({s.feature for s in g} == {"a", "c"} for _, g in best)
    assert subgroups.ranking_table(df, best[:2], "t").count() == 2
    assert selection.combine(["a", "b"], ["b", "c"]) == ["a", "b", "c"]


def test_fractional_radius(spark):
    df = spark.createDataFrame([(t, float(t)) for t in range(10)], "t int, d double").withColumn("g", F.lit(1))
    got = {r["t"]: (r["width"], r["height"]) for r in windows.eye(df, ["g"], "t", "d", 2.5).collect()}
    for t in range(10):
        near = [s for s in range(10) if -2.5 <= s - t < 2.5]
        assert got[t] == (max(near) - min(near) + 1, float(min(near)))


def test_streaming(spark, tmp_path):
    from sparlane.streaming import scoring

    spark.range(6).selectExpr("id", "timestamp_seconds(id * 300) AS ts", "double(id) AS v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, v double").parquet(str(tmp_path / "in"))
    scored = scoring.score(stream, {"w": "v * 2 + 1"})
    q = scoring.each_batch(scored, lambda b: prep.first_rows(b, "id", 3), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["w"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()] == [1.0, 3.0, 5.0]
    q = scoring.windowed(stream, "ts", "v", []).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() == 3
