"""Small table operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparlane.operators import ranks, tables
from sparlane.sources import spec as sp


@pytest.mark.parametrize("cell", [4, 500_000])
def test_quantiles_are_linear(spark, monkeypatch, cell):
    monkeypatch.setattr(ranks, "CELL_VALUES", cell)
    v = np.random.default_rng(1).integers(0, 40, 77).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    shares = [0, 0.1, 0.25, 0.5, 0.77, 1]
    assert tables.quantiles(df, "v", shares) == pytest.approx(np.quantile(v, shares).tolist())
    assert tables.quantiles(df.where("v IS NULL"), "v", shares) is None
    got = ranks.with_rank(df, "v", "r", "average").where("v IS NOT NULL").toPandas()
    assert got.r.tolist() == got.v.rank(method="average").tolist()


def test_describe_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None), (None, None)], "a double, b double")
    a, b = tables.describe(df, ["a", "b"]).collect()
    assert (a["n"], a["missing"], a["min"], a["q50"], a["max"]) == (3, 1, 1.0, 2.0, 4.0) and b["n"] == 0 and b["q50"] is None


def test_by_category(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7), (None, 1, 8)], "x string, y int, v int")
    got = {tuple(k.values()): [r["v"] for r in part.collect()] for k, part in tables.by_category(df, ["x", "y"])}
    assert got == {("a", 1): [5], ("a", 2): [6], ("b", 1): [7], ("b", 2): []}
    with pytest.raises(ValueError):
        list(tables.by_category(df, ["x", "y"], most=3))


def test_casts_and_rounding(spark):
    df = spark.createDataFrame([("1", "x", "lo", 2.5), ("no", None, "hi", 3.5)], "a string, b string, c string, d double")
    assert [tuple(r) for r in tables.cast_to(df, {"a": "int", "b": "bool", "c": ["lo", "mid", "hi"]}).collect()] == [(1, None, 0, 2.5), (None, None, 2, 3.5)]
    assert [r["d"] for r in tables.rounded(df, {"d": 0}, half_even=True).collect()] == [2.0, 4.0]


def test_agreement_of_labelings(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, None)], "x int, y string")
    assert tuple(tables.rand_index(df, "x", "y").first()) == (1.0, 1.0)
    apart = spark.createDataFrame([(i % 2, i // 2) for i in range(4)], "x int, y int")
    r = tables.rand_index(apart, "x", "y").first()
    assert r["rand"] == pytest.approx(1 / 3) and r["adjusted"] == pytest.approx(-0.5)


def test_stored_tables(spark, tmp_path):
    s = sp.from_dict({"version": "1.2", "variables": [{"label": "k", "interface": "knob", "type": "real", "range": [0, 0.3], "grid": [0, 0.1], "rad-rel": 0.1}, {"label": "y", "interface": "output", "type": "int"}]})
    tables.store(spark.createDataFrame([(1, 0.1, "z")], "y long, k double, other string"), s, str(tmp_path))
    df, again = tables.load_stored(spark, str(tmp_path))
    assert again == s and df.columns == ["k", "y", "other"] and df.schema["k"].metadata == {"interface": "knob"}
    df.drop("k").withColumn("q", F.lit(1)).write.mode("overwrite").parquet(f"{tmp_path}/x/data.parquet")


def test_auroc_without_both_classes(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True)], "s double, y boolean")
    assert tables.auroc(df, "s", "y").first()["auroc"] is None
    both = spark.createDataFrame([(1.0, False), (2.0, True), (2.0, False)], "s double, y boolean")
    assert tables.auroc(both, "s", "y").first()["auroc"] == pytest.approx(0.75)
