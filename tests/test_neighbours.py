"""Nearest neighbours by a k-d partition against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparlane.operators import models, neighbours


@pytest.mark.parametrize("k", [1, 4])
def test_table_neighbours_are_those_of_brute_force(spark, monkeypatch, tmp_path, k):
    for name, size in (("CELL", 30), ("CHUNK", 50), ("SHARE", 60), ("SAMPLE", 20)):
        monkeypatch.setattr(neighbours, name, size)
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(0, 1, (300, 3)).round(1), rng.normal(6, 0.2, (100, 3)).round(1), np.full((150, 3), 2.0)])
    train = spark.createDataFrame([(*map(float, p), float(i % 17)) for i, p in enumerate(x)], "a double, b double, c double, y double")
    ask = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(np.concatenate([rng.normal(1, 3, (120, 3)).round(1), x[-3:]]))] + [(900, None, 1.0, 1.0)], "id int, a double, b double, c double")
    plain = models.train(train, ["a", "b", "c"], ["y"], "knn", k=k)
    table = models.train(train, ["a", "b", "c"], ["y"], "knn", k=k, most=100)
    assert isinstance(table.models["y"], neighbours.TableNeighbours)
    rows = lambda m: {r["id"]: None if r["id"] == 900 else round(r["y_knn"], 9) for r in m.predict(ask).collect()}
    want = rows(plain)
    assert rows(table) == want and len(want) == 124
    table.save(f"{tmp_path}/m")
    assert rows(models.Fitted.load(f"{tmp_path}/m")) == want
    assert table.predict(ask.where(F.col("id") == 900)).first()["y_knn"] is None


def test_cells_of_the_tree():
    rng = np.random.default_rng(0)
    p = rng.normal(size=(500, 2))
    axis, cut = neighbours.tree(p, 4)
    cells = neighbours.cell_of(axis, cut, p)
    assert set(cells) == set(range(16)) and np.bincount(cells).max() <= 40
    assert (neighbours.cell_of(*neighbours.tree(p, 0), p) == 0).all() and neighbours.cell_of(axis, cut, p[:0]).size == 0
