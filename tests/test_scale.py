"""Operators that deal their work to cells, with cells made small enough for small tables, against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparlane.operators import association, boxes, design, subgroups, windows


@pytest.mark.parametrize("seed", range(3))
def test_concordant_weight(seed):
    rng = np.random.default_rng(seed)
    x, y, n = rng.integers(0, [3, 8, 100][seed], 60), rng.normal(size=60).round(seed), rng.integers(1, 5, 60)
    want = sum(int(n[i] * n[j]) for i, j in itertools.product(range(60), repeat=2) if x[i] < x[j] and y[i] < y[j])
    assert association.concordant_weight(x, y, n) == want


@pytest.mark.parametrize("cell", [3, 20, 10_000])
def test_concordance_over_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(association, "CELL_PAIRS", cell)
    rng = np.random.default_rng(cell)
    rows = [(float(a), float(b)) for a, b in zip(np.where(rng.random(90) < 0.3, 5, rng.integers(0, 12, 90)), rng.integers(0, 9, 90), strict=True)] + [(None, 1.0), (1.0, None)]
    got = association.concordance_counts(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    full = [r for r in rows if None not in r]
    want = [0] * 5
    for (a, b), (c, d) in itertools.combinations(full, 2):
        s = (a - c) * (b - d)
        want[0 if s > 0 else 1 if s < 0 else 4 if a == c and b == d else 2 if a == c else 3] += 1
    assert list(got)[:5] == want and got["n"] == 90


def test_concordance_of_nothing(spark):
    got = association.kendall(spark.createDataFrame([], "x double, y double"), "x", "y").first()
    assert got["tau_a"] is None and got["tau_b"] is None


@pytest.mark.parametrize("factors, resolution", [(3, 3), (7, 4), (7, 5), (8, 6), (9, 4), (11, 3)])
def test_fraction_has_its_resolution(spark, factors, resolution):
    rows = np.array([tuple(r) for r in design.fractional_factorial(spark, {f"f{i}": [-1, 1] for i in range(factors)}, resolution).collect()])
    assert len(np.unique(rows, axis=0)) == len(rows) < 2**factors
    for size in range(1, resolution):  # no product of fewer factors than the resolution is constant
        for some in itertools.combinations(range(factors), size):
            assert abs(rows[:, some].prod(1).sum()) < len(rows)


def test_every_level_is_searched(spark):
    rows = [(f"level{i % 120}", float(i % 120 == 77)) for i in range(2400)]
    found = subgroups.beam_search(spark.createDataFrame(rows, "f string, y double"), ["f"], "y", depth=1, top=3)
    assert found[0][1][0].level == "level77"
    with pytest.raises(ValueError):
        subgroups.selectors(spark.createDataFrame(rows, "f string, y double"), ["f"], most=100)


def front(rows):
    return sorted(r for r in rows if not any(all(b >= a for a, b in zip(r[1:], s[1:], strict=True)) and s[1:] != r[1:] for s in rows))


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("block", [7, 4096])
def test_skyline_in_blocks(spark, monkeypatch, k, block):
    monkeypatch.setattr(boxes, "FRONT", block)
    rng = np.random.default_rng(k)
    v = rng.random((300, k)).round(1 if k > 1 else 2)
    if k == 2:  # anti-correlated: a large front
        v[:150, 1] = 1 - v[:150, 0]
    rows = [(i, *map(float, r)) for i, r in enumerate(v.tolist())] + [(900, *map(float, v[0]))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"o{i} double" for i in range(k))).repartition(5)
    assert sorted(map(tuple, boxes.skyline(df, [f"o{i}" for i in range(k)]).collect())) == front(rows)
    assert boxes.skyline(df.where("false"), ["o0"]).count() == 0


@pytest.mark.parametrize("cell", [5, 1_000_000])
def test_box_join_with_dense_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(boxes, "CELL_ROWS", cell)
    rng = np.random.default_rng(2)
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.where(rng.random((200, 1)) < 0.4, 3.0, rng.uniform(0, 10, (200, 2))))]
    box = [(i, float(a - r), float(a + r), None if i % 9 == 0 else float(b - 2), float(b + 2)) for i, (a, b, r) in enumerate(np.column_stack([rng.uniform(0, 10, (60, 2)), rng.choice([0.1, 4.0], 60)]))]
    p, b = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(box, "k long, lo_x double, hi_x double, lo_y double, hi_y double")
    got = boxes.box_join(p, b, ["x", "y"]).select("p.id", "b.k").collect()
    want = [(i, k) for i, x, y in points for k, a, z, c, d in box if a <= x <= z and (c is None or y >= c) and y <= d]
    assert sorted(map(tuple, got)) == sorted(want)
    semi = boxes.box_join(p, b, ["x", "y"], "left_anti").select("p.id").collect()
    assert {r[0] for r in semi} == {r[0] for r in points} - {i for i, _ in want}
    assert p.where(F.lit(False)).count() == 0


def test_radii_are_frames_over_one_sort(spark):
    rng = np.random.default_rng(8)
    rows = [(int(a), int(b), float(c)) for a, b, c in np.column_stack([rng.integers(0, 4, 300), rng.integers(0, 60, 300), rng.integers(0, 9, 300)])]
    df = spark.createDataFrame(rows + rows[:50], "g long, t long, v double")
    got = windows.radii(df, ["g"], "t", "v", [3, 10, 3])
    want = {(g, t, v, max(b) - min(b) + 1, min(c), float(r)) for r in (3, 10) for g, t, v in rows for b, c in [zip(*[(y, z) for x, y, z in rows if x == g and t - r <= y < t + r], strict=True)]}
    assert got.columns == ["g", "t", "v", "width", "height", "radius"] and sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.index("Aggregate") > plan.index("Window [")


@pytest.mark.parametrize("few, copied, rows", [(10_000, 100_000, 40), (0, 100_000, 5), (0, 10, 5), (0, 10, 200_000)])
def test_balls_of_many_configurations(spark, monkeypatch, few, copied, rows):
    for name, value in (("FEW_POINTS", few), ("COPIED", copied), ("CELL_ROWS", rows)):
        monkeypatch.setattr(boxes, name, value)
    rng = np.random.default_rng(4)
    conf = [(i, int(a), float(b)) for i, (a, b) in enumerate(np.column_stack([rng.integers(0, 12, 90), rng.uniform(0, 3, 90)]))]
    data = [(int(a), float(b), float(v)) for a, b, v in np.column_stack([rng.integers(0, 12, 400), rng.integers(0, 4, 400), rng.integers(0, 9, 400)])]
    want = {}
    for i, a, b in conf:
        near = [v for x, y, v in data if a - 2 <= x < a + 2 and b - 0.5 <= y <= b + 0.5]
        if near:
            want[i] = (len(near), sum(v >= 4 for v in near), sum(v < 4 for v in near))
    got = boxes.ball_check(spark.createDataFrame(data, "q long, t double, v double"), spark.createDataFrame(conf, "id long, q long, t double"), [boxes.Axis("q", rad_abs=2), boxes.Axis("t", rad_abs=0.5)], "id", F.col("v"), 4, ints=["q"])
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    if few:  # the points are copied, and a configuration's pairs are summed where its boxes are, a few configurations in each task
        assert "BuildLeft" in plan and got.rdd.getNumPartitions() == 9
    elif copied < 90:
        assert "SortMergeJoin" in plan
