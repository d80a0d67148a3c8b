"""Branch and bound over configurations against all configurations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparlane.operators import explore, search, stable
from sparlane.sources import spec as sp


def grow(rng, box, depth, names):
    """Leaves (box, value) of a random tree over the unit cube."""
    if depth == 0 or rng.random() < 0.08:
        return [(box, float(rng.integers(0, 6)))]
    f = str(rng.choice(names))
    lo, hi = box.get(f, (-math.inf, math.inf))
    cut = round(float(rng.uniform(max(lo, 0), min(hi, 1))), 2)
    if not lo < cut < hi:
        return [(box, float(rng.integers(0, 6)))]
    return grow(rng, box | {f: (lo, cut)}, depth - 1, names) + grow(rng, box | {f: (cut, hi)}, depth - 1, names)


def table_of(spark, leaves, names):
    rows = [tuple(x for f in names for x in b.get(f, (-math.inf, math.inf))) + (v,) for b, v in leaves]
    return spark.createDataFrame(rows, ", ".join(f"lo_{f} double, hi_{f} double" for f in names) + ", y double")


def knobs(names, **more):
    variables = [{"label": f, "interface": "knob", "type": "real", "range": [0, 1], "rad-abs": 0.04} for f in names]
    return sp.from_dict({"version": "1.2", "variables": [*variables, {"label": "y", "interface": "output", "type": "real"}]} | more)


@pytest.mark.parametrize("seed", range(2))
def test_search_equals_all_configurations(spark, monkeypatch, seed):
    monkeypatch.setattr(search, "FIRST", [1, 3, 200, 7][seed])
    monkeypatch.setattr(search, "BUDGET", [5, 40, 4000, 11][seed])
    rng = np.random.default_rng(seed)
    names = ["a", "b", "c"]
    cells = table_of(spark, grow(rng, {}, 5, names), names).cache()
    variables = [
        {"label": "a", "interface": "knob", "type": "real", "range": [0, 1], "rad-abs": 0.05}, {"label": "b", "interface": "knob", "type": "real", "range": [0.1, 0.9], "rad-rel": 0.1},
        {"label": "c", "interface": "input", "type": "real", "range": [0.2, 0.6]} if seed % 2 else {"label": "c", "interface": "knob", "type": "real", "range": [0, 1], "grid": [0.1, 0.25, 0.5, 0.7], "rad-abs": 0.01},
        {"label": "y", "interface": "output", "type": "real"},
    ]
    for more in ({}, {"eta": "a + b <= 1"}):
        s = sp.from_dict({"version": "1.2", "variables": variables} | more)
        points = stable.critical_points(spark, s, cells).cache()
        labels = [v.label for v in s.knobs]
        values = explore.stable_values(points, s, cells, "y").orderBy(F.desc("least"), *labels).collect()
        assert [tuple(r) for r in stable.optimize(spark, s, cells, "y").collect()] == [tuple(values[0])]
        for level in (1, 3):
            firm = stable.stable(points, s, cells, f"y >= {level}").orderBy(*labels).collect()
            got = stable.query(spark, s, cells, {"q": f"y >= {level}"}).first()
            assert got.status == ("PASS" if firm else "UNKNOWN" if more else "FAIL")
            assert (got.witness and tuple(got.witness)) == (tuple(map(float, firm[0])) if firm else None)
            assert [tuple(r) for r in stable.safe_points(spark, s, cells, f"y >= {level}", 4).collect()] == [tuple(r) for r in firm[:4]]
        boxes = stable.region(spark, s, cells, "y >= 3").collect()
        every, firm = points.collect(), set(map(tuple, stable.stable(points, s, cells, "y >= 3").collect()))
        ends = [np.array([[b[f"{e}_{k}"] for k in labels] for b in boxes]).reshape(-1, len(labels)) for e in ("lo", "hi")]
        held = [int(((ends[0] < np.array(p)) & (np.array(p) <= ends[1])).all(1).sum()) for p in every]
        assert held == [int(tuple(p) in firm) for p in every]
        under = stable.optimize(spark, s, cells, "y", "y <= 3").collect()
        want = explore.stable_values(stable.stable(points, s, cells, "y <= 3"), s, cells, "y").orderBy(F.desc("least"), *labels).collect()
        assert [tuple(r) for r in under] == [tuple(r) for r in want[:1]]
        assert stable.feasible(spark, s, cells) == {"interface_consistent": True, "model_consistent": True}
    none = sp.from_dict({"version": "1.2", "variables": variables, "eta": "a + b >= 5"})
    assert stable.feasible(spark, none, cells) == {"interface_consistent": False, "model_consistent": False}


def test_eight_knobs_and_a_deep_tree(spark):
    """Their cross product has over 10^12 configurations."""
    rng = np.random.default_rng(11)
    names = [f"k{i}" for i in range(8)]
    leaves = grow(rng, {}, 12, names)
    cells, s = table_of(spark, leaves, names).cache(), knobs(names)
    assert len(leaves) > 500 and math.prod(map(len, stable.knob_values(s, cells))) > 10**12
    best = stable.optimize(spark, s, cells, "y").first()

    def least(at):
        return min(v for b, v in leaves if all(at[f] + 0.04 > lo and at[f] - 0.04 <= hi for f, (lo, hi) in b.items()))

    assert least(best.asDict()) == best["least"]
    tries = rng.uniform(0, 1, (4000, 8))
    assert max(least(dict(zip(names, t, strict=True))) for t in tries) <= best["least"]
    got = {r["name"]: r for r in stable.query(spark, s, cells, {f"{t}": f"y >= {t}" for t in (best["least"], best["least"] + 0.5)}).collect()}
    assert got[str(best["least"])].status == "PASS" and got[str(best["least"] + 0.5)].status == "FAIL"
    assert least(got[str(best["least"])].witness.asDict()) >= best["least"]


def test_parts_of_a_cut_do_not_overlap():
    lo, hi, last = np.array([0, 0, 2]), np.array([3, 2, 5]), np.array([1, 4, 3])
    parts = []
    end = search._cut(lambda a, b: parts.append((a, b)), lo, hi, last)
    inside = [p for p in itertools.product(range(4), range(3), range(2, 6)) if (np.array(p) <= last).all()]
    seen = [p for a, b in [*parts, (lo, end)] for p in itertools.product(*(range(x, y + 1) for x, y in zip(a, b, strict=True)))]
    assert len(seen) == len(set(seen)) == 4 * 3 * 4 and {p for p in seen if (np.array(p) <= end).all()} == set(inside)
