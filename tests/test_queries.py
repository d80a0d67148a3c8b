"""Every query of the engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from sparlane.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df, columns):
    cell = lambda v: None if pd.isna(v) else float(v) if not isinstance(v, (str, bool)) and hasattr(v, "__float__") else str(v)
    return sorted((tuple(cell(v) for v in r) for r in df[columns].itertuples(index=False)), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, rel=1e-6, abs=2e-6) if all(isinstance(v, float) for v in (*x, *y)) else x == y


def test_ball_check_takes_every_part(spark, tmp_path):
    parts = [(k, k % 50 + 1, 900.0 + k % 100) for k in range(0, 2000, 7)]
    items = [(i % 50 + 1, (i % 9) / 100, 20000.0 + 50 * i) for i in range(400)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(items, "l_quantity int, l_tax double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for k, size, price in parts:
        hit = [v for q, t, v in items if size - 3 <= q < size + 3 and price / 20000 - 0.01 <= t <= price / 20000 + 0.01]
        if hit:
            want[k] = (len(hit), sum(v >= 30000 for v in hit), sum(v < 30000 for v in hit))
    got = {r["config"]: (r["inside"], r["passed"], r["failed"]) for r in registry.QUERIES["ball_check"](spark, str(tmp_path)).collect()}
    assert got == want and max(want) > 200


def test_entry(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
