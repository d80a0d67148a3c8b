"""Queries that run whole modes from a specification."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import modes
from ..operators import smooth
from ..sources import spec as sp
from ..stored import shared_folder
from . import exploring as xp
from .registry import ORACLE_SQL, query, table

_FIT = "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), e AS (SELECT l_extendedprice AS y, a + b * l_quantity AS p FROM lineitem, m)"


@query(f"{_FIT} SELECT part, 'l_extendedprice' AS response, round(avg((y - p) * (y - p)), 0) AS mse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 5) AS r2 FROM e, (SELECT unnest(['training', 'test', 'labeled']) AS part) GROUP BY part")
def mode_train(spark, d):
    """Q-9 Q-11 Q-12 A15 A16: the mode `train`, all rows for both parts."""
    out = modes.run(spark, "train", data=f"{d}/lineitem.parquet", features=["l_quantity"], responses=["l_extendedprice"], model="linear", train_share=1, log="WARNING")
    return out.select("part", "response", F.round("mse", 0).alias("mse"), F.round("r2", 5).alias("r2"))


@query(f"{_FIT} SELECT o_custkey AS l_quantity, round(a + b * o_custkey, 2) AS predicted FROM (SELECT o_custkey FROM orders), m")
def mode_predict(spark, d):
    """Q-10 B30: the mode `predict` on a table without responses."""
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("l_quantity"))
    out = modes.run(spark, "predict", data=f"{d}/lineitem.parquet", new_data=new, features=["l_quantity"], responses=["l_extendedprice"], model="linear", train_share=1, log="WARNING")
    return out.select("l_quantity", F.round("l_extendedprice_linear", 2).alias("predicted"))


@query(f"{_FIT} SELECT o_custkey AS l_quantity, round(a + b * o_custkey, 2) AS predicted FROM (SELECT o_custkey FROM orders), m")
def mode_predict_saved(spark, d):
    """Q-10 A14: a model that one run saves and another loads, which has no training data."""
    path = f"{shared_folder(spark)}/sparlane-model-{uuid.uuid4().hex}"
    modes.run(spark, "train", data=f"{d}/lineitem.parquet", features=["l_quantity"], responses=["l_extendedprice"], model="linear", train_share=1, model_path=path, log="WARNING")
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("l_quantity"))
    out = modes.run(spark, "predict", new_data=new, use_model=True, model_path=path, log="WARNING")
    return out.select("l_quantity", F.round("l_extendedprice_linear", 2).alias("predicted"))


_HILL = "SELECT avg(l_discount) * 100 AS c0, avg(l_quantity) AS m1, avg(l_tax) * 1000 AS m2 FROM lineitem"


@query(f"WITH m AS ({_HILL}), p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice / 20 AS b, c0, m1, m2 FROM part, m), e AS (SELECT p_partkey, c0 + 0.02 * CASE WHEN m1 BETWEEN a - 2 AND a + 2 THEN 0 ELSE least((a - 2 - m1) * (a - 2 - m1), (a + 2 - m1) * (a + 2 - m1)) END - 0.01 * greatest((b - 3 - m2) * (b - 3 - m2), (b + 3 - m2) * (b + 3 - m2)) AS least FROM p) SELECT p_partkey, CASE WHEN least >= 2 THEN 'PASS' ELSE 'FAIL' END AS status FROM e WHERE abs(least - 2) > 1e-6")
def verify_polynomial(spark, d):
    """Whether a polynomial with coefficients from the data keeps a limit in the stability box of every part, by Bernstein bounds."""
    c0, m1, m2 = table(spark, d, "lineitem").agg(F.avg("l_discount") * 100, F.avg("l_quantity"), F.avg("l_tax") * 1000).first()
    c0, m1, m2 = float(c0), float(m1), float(m2)
    terms = {(0, 0): c0 + 0.02 * m1 * m1 - 0.01 * m2 * m2, (1, 0): -0.04 * m1, (2, 0): 0.02, (0, 1): 0.02 * m2, (0, 2): -0.01}
    model = smooth.Smooth(["a", "b"], {"y": smooth.polynomial_tensor(terms)})
    knob = lambda label, rad: {"label": label, "interface": "knob", "type": "real", "rad-abs": rad}
    spec = sp.from_dict({"version": "1.2", "variables": [knob("a", 2), knob("b", 3), {"label": "y", "interface": "output", "type": "real"}]})
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 20).alias("b"))
    return smooth.verify(model, parts, spec, "y >= 2", "p_partkey").select(F.col("box").alias("p_partkey"), "status").where("status <> 'UNKNOWN'")


@query("SELECT x, y, x * x - 3 * y AS z FROM (SELECT unnest([-1.0::DOUBLE, 0.0, 2.0]) AS x), (SELECT unnest([5.0::DOUBLE, 7.0]) AS y)")
def mode_doe(spark, d):
    """The mode `doe` with a system that makes the design training data."""
    variables = [{"label": "x", "interface": "knob", "type": "real", "grid": [-1, 0, 2], "rad-abs": 0}, {"label": "y", "interface": "input", "type": "real", "range": [5, 7]}, {"label": "z", "interface": "output", "type": "real"}]
    return modes.run(spark, "doe", spec={"version": "1.2", "variables": variables, "system": {"z": "x * x - 3 * y"}}, log="WARNING").withColumn("z", F.col("z").cast("double"))


@query("SELECT l_orderkey, l_linenumber, CAST(least(floor((l_quantity - lo) / (hi - lo) * 10), 9) AS VARCHAR) AS quantity FROM lineitem, (SELECT min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi FROM lineitem)")
def mode_discretize(spark, d):
    """The mode `discretize`."""
    out = modes.run(spark, "discretize", data=f"{d}/lineitem.parquet", features=["l_quantity"], log="WARNING")
    return out.select("l_orderkey", "l_linenumber", F.concat(F.regexp_replace("l_quantity", "Bin", ""), F.lit(".0")).alias("quantity"))


@query("WITH c AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([abs(corr(l_quantity, l_extendedprice)), abs(corr(l_discount, l_extendedprice)), abs(corr(l_tax, l_extendedprice))]) AS v FROM lineitem) SELECT feature, round(v / max(v) OVER (), 6) AS ranking FROM c")
def mode_correlate(spark, d):
    """The mode `correlate`."""
    out = modes.run(spark, "correlate", data=f"{d}/lineitem.parquet", features=["l_quantity", "l_discount", "l_tax"], responses=["l_extendedprice"], estimators=["pearson"], log="WARNING")
    return out.select("feature", F.round("ranking", 6).alias("ranking"))


@query(ORACLE_SQL["frontier_pipeline"])
def mode_frontier(spark, d):
    """2.O A17 B4: the mode `frontier` from a specification."""
    variables = [{"label": "p_size", "interface": "knob", "type": "int", "rad-abs": 2}, {"label": "p_retailprice", "interface": "knob", "type": "real", "rad-rel": 0.1}, {"label": "qty", "interface": "output", "type": "real"}, {"label": "disc", "interface": "output", "type": "real"}]
    out = modes.run(spark, "frontier", data=xp._parts(spark, d), row_id="p_partkey", spec={"version": "1.2", "variables": variables, "beta": "qty >= 450", "objectives": {"qty": "qty", "disc": "disc"}}, log="WARNING")
    return out.select("p_partkey", "p_size", F.round("p_retailprice", 6).alias("p_retailprice"), F.col("objective_qty").alias("qty"), F.col("objective_disc").alias("disc"))


def _spec(**more):
    variables = [{"label": "qty", "interface": "knob", "type": "real", "range": [1, 50], "rad-abs": 3}, {"label": "line", "interface": "knob", "type": "int", "range": [1, 7], "rad-abs": 1}, {"label": "ret", "interface": "output", "type": "real"}, {"label": "tax", "interface": "output", "type": "real"}]
    return {"version": "1.2", "variables": variables} | more


@query(ORACLE_SQL["query_cells"])
def mode_query(spark, d):
    """The mode `query`."""
    return modes.run(spark, "query", data=xp._table_cells(spark, d), spec=_spec(queries={f"ret >= {t}": f"ret >= {t}" for t in xp._LEVELS}), log="WARNING").select("name", "status")


@query(ORACLE_SQL["verify_cells"])
def mode_verify(spark, d):
    """The mode `verify`."""
    at = {"low": {"qty": 3, "line": 2}, "mid": {"qty": 25.5, "line": 4}, "high": {"qty": 48, "line": 6}}
    out = modes.run(spark, "verify", data=xp._table_cells(spark, d), spec=_spec(configurations=at, assertions={"few": "ret >= 0 and ret <= 0.335", "any": "ret >= 0 and ret <= 1", "some": "ret >= 0.32"}), log="WARNING")
    return out.select("configuration", "assertion", "status")


@query(ORACLE_SQL["certify_cells"])
def mode_certify(spark, d):
    """The mode `certify`."""
    at = {"low": {"qty": 3, "line": 2}, "mid": {"qty": 25.5, "line": 4}, "high": {"qty": 48, "line": 6}, "edge": {"qty": 10, "line": 1}}
    return modes.run(spark, "certify", data=xp._table_cells(spark, d), spec=_spec(witnesses=at, queries={"level": "ret >= 0.33"}), log="WARNING").select("name", "status")


@query(ORACLE_SQL["synthesize_cells"])
def mode_synthesize(spark, d):
    """The mode `synthesize`."""
    return modes.run(spark, "synthesize", data=xp._table_cells(spark, d), spec=_spec(beta="ret >= 0.3", assertions={"top": "ret <= 0.38", "tax": "tax <= 0.0425"}), log="WARNING").select("name", "status")


@query(f"WITH c AS ({xp._CELLS}), g AS ({xp._FINE}) SELECT 'ret' AS objective, round(max(least), 6) AS threshold, round((max(least) - (SELECT min(ret) FROM c)) / (SELECT max(ret) - min(ret) FROM c), 6) AS scaled FROM g WHERE most_tax <= 0.0425 UNION ALL SELECT 'tax', round(max(least_tax), 6), round((max(least_tax) - (SELECT min(tax) FROM c)) / (SELECT max(tax) - min(tax) FROM c), 6) FROM g WHERE most_tax <= 0.0425")
def mode_optimize(spark, d):
    """The mode `optimize`, each objective by itself."""
    out = modes.run(spark, "optimize", data=xp._table_cells(spark, d), spec=_spec(beta="tax <= 0.0425", objectives={"ret": "ret", "tax": "tax"}), log="WARNING")
    return out.select("objective", F.round("threshold", 6).alias("threshold"), F.round("scaled", 6).alias("scaled"))


@query(f"WITH c AS ({xp._CELLS}), g AS ({xp._FINE}) SELECT 'ret' AS objective, round(max(least), 6) AS threshold FROM g WHERE most_tax <= 0.0425 AND most <= 0.36")
def mode_optsyn(spark, d):
    """The mode `optsyn`, with assertions on top of beta."""
    out = modes.run(spark, "optsyn", data=xp._table_cells(spark, d), spec=_spec(beta="tax <= 0.0425", assertions={"top": "ret <= 0.36"}, objectives={"ret": "ret"}), log="WARNING")
    return out.select("objective", F.round("threshold", 6).alias("threshold"))


@query()
def mode_subgroups(spark, d):
    """The mode `subgroups`."""
    out = modes.run(spark, "subgroups", data=xp._parts(spark, d), row_id="p_partkey", features=["p_size", "p_retailprice"], responses=["qty"], measure="mean_1", depth=2, top=5, log="WARNING")
    return out.select("response", "feature_1", "feature_2", F.round("quality", 4).alias("quality"))
