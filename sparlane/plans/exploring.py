"""Queries of box joins, frontiers, designs, models and exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import boxes, design, explore, models, stable, tables
from ..sources import spec as sp
from ..stored import stored
from .registry import query, table

_PARTS = "SELECT p_partkey, p_size, p_retailprice, round(sum(l_quantity), 6) AS qty, round(avg(l_discount), 6) AS disc FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2, 3"
_AXES = [boxes.Axis("p_size", rad_abs=2), boxes.Axis("p_retailprice", rad_rel=0.1)]


def _parts(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_discount"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_partkey", "p_size", "p_retailprice").agg(F.round(F.sum("l_quantity"), 6).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"))


_NEAR = "abs(a.p_size - b.p_size) <= 2 AND a.p_retailprice BETWEEN b.p_retailprice - 0.1 * abs(b.p_retailprice) AND b.p_retailprice + 0.1 * abs(b.p_retailprice)"
_MIN = f"SELECT b.p_partkey, min(a.qty) AS qty, min(a.disc) AS disc FROM p a JOIN p b ON {_NEAR} GROUP BY 1"


@query(f"WITH p AS ({_PARTS}), m AS ({_MIN}), v AS (SELECT DISTINCT p_size, p_retailprice FROM p WHERE NOT qty >= 450), s AS (SELECT a.* FROM p a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE {_NEAR})), j AS (SELECT s.p_partkey, s.p_size, round(s.p_retailprice, 6) AS p_retailprice, m.qty, m.disc FROM s JOIN m USING (p_partkey)) SELECT * FROM j a WHERE NOT EXISTS (SELECT 1 FROM j b WHERE b.qty >= a.qty AND b.disc >= a.disc AND (b.qty > a.qty OR b.disc > a.disc))")
def frontier_pipeline(spark, d):
    """2.O D1 D2 D3 D4 B16 B17 B19 A17: stable minima by a box join, beta's anti join, and the skyline."""
    df = _parts(spark, d)
    out = boxes.frontier(df.withColumnsRenamed({"qty": "q0", "disc": "d0"}), "p_partkey", _AXES, ["p_size", "p_retailprice"], {"qty": "q0", "disc": "d0"}, beta="q0 >= 450")
    return out.select("p_partkey", "p_size", F.round("p_retailprice", 6).alias("p_retailprice"), "qty", "disc")


@query(f"WITH p AS ({_PARTS}) {_MIN}")
def stable_minima(spark, d):
    """Least objectives in each row's stability box."""
    return boxes.stable_minima(_parts(spark, d), "p_partkey", _AXES, ["qty", "disc"])


@query(f"WITH p AS ({_PARTS}), v AS (SELECT DISTINCT p_size, p_retailprice FROM p WHERE NOT qty >= 450) SELECT a.p_partkey FROM p a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE {_NEAR})")
def universal_beta(spark, d):
    """Rows outside the boxes of all violators."""
    return boxes.drop_near_violators(_parts(spark, d), _AXES, F.col("qty") >= 450).select("p_partkey")


@query("WITH s AS (SELECT s_suppkey, round(s_acctbal, 6) AS balance, count(*) AS n, round(sum(l_quantity), 6) AS qty FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2) SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.balance >= a.balance AND b.n >= a.n AND b.qty >= a.qty AND (b.balance > a.balance OR b.n > a.n OR b.qty > a.qty))")
def skyline(spark, d):
    """Rows that no other dominates."""
    s = table(spark, d, "supplier").join(table(spark, d, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_suppkey", F.round("s_acctbal", 6).alias("balance")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("qty"))
    return boxes.skyline(s, ["balance", "n", "qty"])


@query("SELECT c.p_partkey AS config, count(*) AS inside, count(*) FILTER (WHERE l_extendedprice >= 30000) AS passed, count(*) FILTER (WHERE l_extendedprice < 30000) AS failed FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS q, p_retailprice / 20000 AS t FROM part) c JOIN (SELECT CAST(l_quantity AS BIGINT) AS q, l_tax AS t, l_extendedprice FROM lineitem) l ON l.q >= c.q - 3 AND l.q < c.q + 3 AND l.t >= c.t - 0.01 AND l.t <= c.t + 0.01 GROUP BY 1")
def ball_check(spark, d):
    """Rows in each configuration's ball, half-open on integers."""
    conf = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("q"), (F.col("p_retailprice") / 20000).alias("t"))
    data = table(spark, d, "lineitem").select(F.col("l_quantity").cast("bigint").alias("q"), F.col("l_tax").alias("t"), "l_extendedprice")
    return boxes.ball_check(data, conf, [boxes.Axis("q", rad_abs=3), boxes.Axis("t", rad_abs=0.01)], "p_partkey", F.col("l_extendedprice"), 30000, ints=["q"])


@query("SELECT greatest(max(lo1), max(lo2)) AS lo, least(min(hi1), min(hi2)) AS hi FROM (SELECT min(l_quantity) AS lo1, max(l_quantity) AS hi1 FROM lineitem WHERE l_returnflag = 'R') , (SELECT min(l_quantity) AS lo2, max(l_quantity) AS hi2 FROM lineitem WHERE l_linestatus = 'O')")
def safe_range(spark, d):
    """Intersection of ranges."""
    li = table(spark, d, "lineitem")
    parts = [li.where(c).agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi")) for c in ("l_returnflag = 'R'", "l_linestatus = 'O'")]
    return tables.overlap(parts[0].unionByName(parts[1]))


LEVELS = {"a": [5, 7], "b": [-1, 1], "c": [0, 1]}


@query("SELECT a, b, c FROM (SELECT unnest([5.0::DOUBLE, 7.0]) AS a), (SELECT unnest([-1.0::DOUBLE, 1.0]) AS b), (SELECT unnest([0.0::DOUBLE, 1.0]) AS c)")
def design_full_factorial(spark, d):
    """All combinations."""
    return design.full_factorial(spark, LEVELS)


@query("SELECT a, b, CASE WHEN (a - 6) * b > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS c FROM (SELECT unnest([5.0::DOUBLE, 7.0]) AS a), (SELECT unnest([-1.0::DOUBLE, 1.0]) AS b)")
def design_fractional(spark, d):
    """Half of the two-level design, the third factor the product of the others."""
    return design.fractional_factorial(spark, LEVELS, 3)


@query()
def design_plackett_burman(spark, d):
    """P3."""
    return design.plackett_burman(spark, LEVELS | {f"x{i}": [0, 1] for i in range(6)})


@query("SELECT a, b FROM (SELECT unnest([1.25::DOUBLE, 3.75, 6.25, 8.75]) AS a), (SELECT unnest([0.125::DOUBLE, 0.375, 0.625, 0.875]) AS b)")
def design_sukharev(spark, d):
    """Centers of grid cells."""
    return design.sukharev(spark, {"a": [0, 10], "b": [0, 1]}, 16)


@query("SELECT a, b, c FROM (SELECT unnest([0.0::DOUBLE, 1, 2]) AS a), (SELECT unnest([0.0::DOUBLE, 1, 2]) AS b), (SELECT unnest([0.0::DOUBLE, 1, 2]) AS c) WHERE (CASE WHEN a = 1 THEN 1 ELSE 0 END) + (CASE WHEN b = 1 THEN 1 ELSE 0 END) + (CASE WHEN c = 1 THEN 1 ELSE 0 END) IN (1, 3)")
def design_box_behnken(spark, d):
    """P5: midpoints of edges, and the center."""
    return design.box_behnken(spark, {k: [0, 1, 2] for k in "abc"})


@query()
def design_central_composite(spark, d):
    """P6."""
    return design.central_composite(spark, LEVELS)


@query()
def design_latin_hypercube(spark, d):
    """P7."""
    return design.latin_hypercube(spark, {"a": [0, 1], "b": [10, 20]}, 50)


@query()
def design_space_filling(spark, d):
    """P8."""
    return design.space_filling(spark, {"a": [0, 1], "b": [10, 20]}, 30)


@query()
def design_random_kmeans(spark, d):
    """P9."""
    return design.random_kmeans(spark, {"a": [0, 1], "b": [10, 20]}, 8)


@query()
def design_maximin(spark, d):
    """P10."""
    return design.maximin(spark, {"a": [0, 1], "b": [10, 20]}, 12)


@query("WITH RECURSIVE n AS (SELECT unnest(range(1, 101)) AS i), h(i, b, k, f, v) AS (SELECT i, b, i, 1.0::DOUBLE / b, 0.0::DOUBLE FROM n, (SELECT unnest([2, 3]) AS b) UNION ALL SELECT i, b, k // b, f / b, v + (k % b) * f FROM h WHERE k > 0) SELECT round(max(v) FILTER (WHERE b = 2), 6) AS a, round(10 + 10 * max(v) FILTER (WHERE b = 3), 6) AS b FROM h WHERE k = 0 GROUP BY i")
def design_halton(spark, d):
    """Radical inverses."""
    return design.halton(spark, {"a": [0, 1], "b": [10, 20]}, 100).select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query()
def design_uniform_random(spark, d):
    """P12."""
    return design.uniform_random(spark, {"a": [0, 1], "b": [10, 20]}, 40)


def _model_report(spark, d, kind, **options):
    p = _parts(spark, d)
    m = models.train(p, ["p_size", "p_retailprice"], ["qty"], kind, **options)
    out = models.precision(m.predict(p), {"qty": f"qty_{kind}"})
    return out.select("response", *[F.round(c, 4).alias(c) for c in ("mse", "r2", "rmse")])


@query()
def model_decision_tree(spark, d):
    """Q-1 Q-9 Q-10 Q-11 Q-12 E16."""
    return _model_report(spark, d, "dt", maxDepth=5)


@query()
def model_random_forest(spark, d):
    """Q-2."""
    return _model_report(spark, d, "rf", numTrees=10, maxDepth=4)


@query()
def model_extra_trees(spark, d):
    """Q-3: trees with thresholds drawn at random."""
    return _model_report(spark, d, "et", numTrees=10, maxDepth=4)


@query()
def model_polynomial(spark, d):
    """Q-4."""
    return _model_report(spark, d, "poly", degree=2)


@query()
def model_network(spark, d):
    """Q-5 Q-7: a dense network with rounded weights."""
    return _model_report(spark, d, "nn", epochs=30, digits=4)


@query()
def model_boosted(spark, d):
    """Q-8."""
    return _model_report(spark, d, "gbr", maxIter=5)


@query("SELECT 'l_extendedprice' AS response, round(avg((l_extendedprice - 1400 * l_quantity) * (l_extendedprice - 1400 * l_quantity)), 2) AS mse, round(1 - avg((l_extendedprice - 1400 * l_quantity) * (l_extendedprice - 1400 * l_quantity)) / var_pop(l_extendedprice), 6) AS r2, round(sqrt(avg((l_extendedprice - 1400 * l_quantity) * (l_extendedprice - 1400 * l_quantity))), 4) AS rmse FROM lineitem")
def prediction_precision(spark, d):
    """Errors of given predictions."""
    df = table(spark, d, "lineitem").withColumn("p", 1400 * F.col("l_quantity"))
    return models.precision(df, {"l_extendedprice": "p"}).select("response", F.round("mse", 2).alias("mse"), F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"))


@query()
def model_refine(spark, d):
    """Q-13: model against system in the box of a configuration."""
    s = sp.from_dict({"version": "1.2", "variables": [{"label": "x", "interface": "knob", "type": "real", "range": [0, 10], "rad-abs": 1}, {"label": "y", "interface": "output", "type": "real"}]})
    pts = design.halton(spark, {"x": [0, 10]}, 200).withColumn("y", ex.column("x * x"))
    m = models.train(pts, ["x"], ["y"], "dt", maxDepth=6)
    return models.refine(spark, s, {"x": 5.0}, m, {"y": "x * x"}, 60).select("response", F.round("rmse", 4).alias("rmse"))


def _spec():
    return sp.from_dict({"version": "1.2", "variables": [{"label": "p_size", "interface": "knob", "type": "int", "range": [1, 50], "grid": list(range(1, 51, 7)), "rad-abs": 2}, {"label": "p_retailprice", "interface": "knob", "type": "real", "grid": [950, 1150, 1350, 1550, 1750, 1950], "rad-rel": 0.05}, {"label": "qty", "interface": "output", "type": "real"}], "objectives": {"qty": "qty"}})


def _tree(spark, d):
    m = models.train(_parts(spark, d), ["p_size", "p_retailprice"], ["qty"], "dt", maxDepth=4).models["qty"]
    return models.leaf_boxes(spark, m, ["p_size", "p_retailprice"])


@query()
def tree_boxes(spark, d):
    """A fitted tree as a relation of boxes."""
    return _tree(spark, d)


@query()
def tree_rules(spark, d):
    """Leaves as rules, by coverage."""
    return models.rules_text(_tree(spark, d), ["p_size", "p_retailprice"], "qty")


@query()
def forest_as_boxes(spark, d):
    """A forest as disjoint boxes with mean values."""
    m = models.train(_parts(spark, d), ["p_size", "p_retailprice"], ["qty"], "rf", numTrees=3, maxDepth=3).models["qty"]
    return models.forest_boxes(models.leaf_boxes(spark, m, ["p_size", "p_retailprice"]), ["p_size", "p_retailprice"])


@query()
def optimize_stable(spark, d):
    """The candidate with the greatest stable minimum."""
    s = _spec()
    return explore.optimize(sp.grid_points(spark, s), s, _tree(spark, d))


@query()
def synthesize_stable(spark, d):
    """Candidates whose stable minimum reaches a limit."""
    s = _spec()
    return explore.optimize(sp.grid_points(spark, s), s, _tree(spark, d), at_least=300.0)


_GRID = "SELECT x, y, x * x - 3 * y AS z FROM (SELECT unnest(range(-5, 6)) AS x), (SELECT unnest(range(-5, 6)) AS y)"


def _points(spark):
    return spark.range(-5, 6).withColumnRenamed("id", "x").crossJoin(spark.range(-5, 6).withColumnRenamed("id", "y")).withColumn("z", ex.column("x ** 2 - 3 * y"))


def _xy():
    return sp.from_dict({"version": "1.2", "variables": [{"label": "x", "interface": "knob", "type": "int", "rad-abs": 1}, {"label": "y", "interface": "knob", "type": "int", "rad-abs": 1}, {"label": "z", "interface": "output", "type": "int"}], "alpha": "x + y < 9"})


@query(f"WITH g AS ({_GRID}) SELECT * FROM g a WHERE z >= 4 AND NOT EXISTS (SELECT 1 FROM g b WHERE abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.x + b.y < 9 AND b.z < 4)")
def query_stable(spark, d):
    """Candidates whose whole box satisfies the condition."""
    p = _points(spark)
    return explore.query(p, p, _xy(), "z >= 4")


@query(f"WITH g AS ({_GRID}) SELECT CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM g WHERE abs(x - 4) <= 1 AND abs(y) <= 1 AND x + y < 9 AND NOT z >= 8")
def verify_assertion(spark, d):
    """An assertion over the box of a configuration."""
    return explore.verify(_points(spark), {"x": 4, "y": 0}, _xy(), "z >= 8").select("status")


@query(f"WITH g AS ({_GRID}), w AS (SELECT * FROM (VALUES ('deep', 5, -3), ('edge', 2, 0), ('none', 0, 4)) AS t(name, x, y)) SELECT name, CASE WHEN NOT EXISTS (SELECT 1 FROM g WHERE g.x = w.x AND g.y = w.y AND z >= 4) THEN 'not a witness' WHEN EXISTS (SELECT 1 FROM g WHERE abs(g.x - w.x) <= 1 AND abs(g.y - w.y) <= 1 AND g.x + g.y < 9 AND z < 4) THEN 'witness, not stable' ELSE 'stable witness' END AS status FROM w")
def certify_witness(spark, d):
    """Three witnesses."""
    p, s = _points(spark), _xy()
    ws = {"deep": {"x": 5, "y": -3}, "edge": {"x": 2, "y": 0}, "none": {"x": 0, "y": 4}}
    return spark.createDataFrame([(n, explore.certify(p, w, s, "z >= 4")) for n, w in ws.items()], "name string, status string")


@query()
def pareto_thresholds(spark, d):
    """Max-min thresholds of two objectives."""
    s = _spec()
    leaves = _tree(spark, d).withColumn("other", -F.col("value") + 1000)
    got = explore.thresholds(sp.grid_points(spark, s), s, leaves, ["value", "other"])
    return spark.createDataFrame([(i, str(x)) for i, x in enumerate(got)], "step int, state string")


@query()
def interval_refinement(spark, d):
    """Boxes decided by interval evaluation."""
    b = spark.createDataFrame([(-2.0, 2.0, -2.0, 2.0)], "lo_x double, hi_x double, lo_y double, hi_y double")
    return explore.refine_boxes(b, ["x", "y"], ex.parse("x * x + y * y <= 1"), 8)


@query()
def solve_expressions(spark, d):
    """Decisions and bounds without a solver."""
    box = {"x": (-5.0, 5.0), "y": (-5.0, 5.0)}
    a = explore.decide(ex.parse("x * x + y * y < 1 and x > 0.5"), box)[0]
    b = explore.decide(ex.parse("x * x < -1"), box)[0]
    lo, hi, _ = explore.maximum(ex.parse("4 - x * x - (y - 1) * (y - 1)"), box, 0.01)
    return spark.createDataFrame([("inside", a, None, None), ("outside", b, None, None), ("maximum", "sat", round(lo, 1), round(hi, 1))], "name string, status string, lower double, upper double")


_CELLS = "SELECT 5 * (ceil(l_quantity / 5) - 1) AS qlo, 5 * ceil(l_quantity / 5) AS qhi, 2 * (ceil(l_linenumber / 2.0) - 1) AS nlo, 2 * ceil(l_linenumber / 2.0) AS nhi, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS ret, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1, 2, 3, 4"
#: A fine grid of configurations for the SQL side: all ends of boxes that matter are integers.
_FINE = "SELECT qty, line, min(ret) AS least, max(ret) AS most, min(tax) AS least_tax, max(tax) AS most_tax FROM (SELECT i / 2.0 AS qty FROM range(2, 101) AS t(i)), (SELECT n AS line FROM range(1, 8) AS u(n)), c WHERE qty + 3 > qlo AND qty - 3 <= qhi AND line + 1 > nlo AND line - 1 <= nhi GROUP BY 1, 2"


def _table_cells(spark, d):
    """Shares of returned lines and mean taxes by cell of quantity and line number: a model that is constant on boxes."""
    cell = lambda c, w: F.ceil(F.col(c) / w).cast("double") * w
    return table(spark, d, "lineitem").groupBy(cell("l_quantity", 5).alias("hi_qty"), cell("l_linenumber", 2).alias("hi_line")).agg(F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 6).alias("ret"), F.round(F.avg("l_tax"), 6).alias("tax")).select((F.col("hi_qty") - 5).alias("lo_qty"), "hi_qty", (F.col("hi_line") - 2).alias("lo_line"), "hi_line", "ret", "tax")


def _cell_spec(**more):
    variables = [{"label": "qty", "interface": "knob", "type": "real", "range": [1, 50], "rad-abs": 3}, {"label": "line", "interface": "knob", "type": "int", "range": [1, 7], "rad-abs": 1}, {"label": "ret", "interface": "output", "type": "real"}, {"label": "tax", "interface": "output", "type": "real"}]
    return sp.from_dict({"version": "1.2", "variables": variables} | more)


@query(f"WITH c AS ({_CELLS}), g AS ({_FINE}) SELECT max(least) AS least FROM g WHERE most_tax <= 0.0425")
def optimize_cells(spark, d):
    """The greatest stable minimum over all real configurations, with a condition on another output."""
    return stable.optimize(spark, _cell_spec(), _table_cells(spark, d), "ret", "tax <= 0.0425").agg(F.max("least").alias("least"))


_LEVELS = [0.2, 0.3, 0.32, 0.33, 0.335, 0.34, 0.4]


@query(f"WITH c AS ({_CELLS}), g AS ({_FINE}), t AS (SELECT unnest({_LEVELS}) AS lim) SELECT 'ret >= ' || CAST(CAST(lim AS DOUBLE) AS VARCHAR) AS name, CASE WHEN EXISTS (SELECT 1 FROM g WHERE least >= lim) THEN 'PASS' ELSE 'FAIL' END AS status FROM t")
def query_cells(spark, d):
    """Whether any real configuration is stable, by threshold."""
    return stable.query(spark, _cell_spec(), _table_cells(spark, d), {f"ret >= {t}": f"ret >= {t}" for t in _LEVELS}).select("name", "status")


@query(f"WITH c AS ({_CELLS}), w AS (SELECT * FROM (VALUES ('low', 3.0, 2), ('mid', 25.5, 4), ('high', 48.0, 6)) AS t(configuration, qty, line)), a AS (SELECT * FROM (VALUES ('few', 0.0, 0.335), ('any', 0.0, 1.0), ('some', 0.32, 1.0)) AS t(assertion, lo, hi)) SELECT configuration, assertion, CASE WHEN EXISTS (SELECT 1 FROM c WHERE qty + 3 > qlo AND qty - 3 <= qhi AND line + 1 > nlo AND line - 1 <= nhi AND NOT (ret >= lo AND ret <= hi)) THEN 'FAIL' ELSE 'PASS' END AS status FROM w, a")
def verify_cells(spark, d):
    """Assertions over the whole boxes of configurations."""
    at = {"low": {"qty": 3, "line": 2}, "mid": {"qty": 25.5, "line": 4}, "high": {"qty": 48, "line": 6}}
    return stable.verify(spark, _cell_spec(), _table_cells(spark, d), at, {"few": "ret >= 0 and ret <= 0.335", "any": "ret >= 0 and ret <= 1", "some": "ret >= 0.32"}).select("configuration", "assertion", "status")


@query(f"WITH c AS ({_CELLS}), w AS (SELECT * FROM (VALUES ('low', 3.0, 2), ('mid', 25.5, 4), ('high', 48.0, 6), ('edge', 10.0, 1)) AS t(name, qty, line)) SELECT name, CASE WHEN EXISTS (SELECT 1 FROM c WHERE qty > qlo AND qty <= qhi AND line > nlo AND line <= nhi AND NOT ret >= 0.33) THEN 'not a witness' WHEN EXISTS (SELECT 1 FROM c WHERE qty + 3 > qlo AND qty - 3 <= qhi AND line + 1 > nlo AND line - 1 <= nhi AND NOT ret >= 0.33) THEN 'witness, not stable' ELSE 'stable witness' END AS status FROM w")
def certify_cells(spark, d):
    """Given points."""
    at = {"low": {"qty": 3, "line": 2}, "mid": {"qty": 25.5, "line": 4}, "high": {"qty": 48, "line": 6}, "edge": {"qty": 10, "line": 1}}
    return stable.certify(spark, _cell_spec(), _table_cells(spark, d), at, "ret >= 0.33")


@query(f"WITH c AS ({_CELLS}), g AS ({_FINE}) SELECT 'synthesis' AS name, CASE WHEN EXISTS (SELECT 1 FROM g WHERE least >= 0.3 AND most <= 0.38 AND most_tax <= 0.0425) THEN 'PASS' ELSE 'FAIL' END AS status")
def synthesize_cells(spark, d):
    """Beta and the assertions together."""
    s = _cell_spec(beta="ret >= 0.3", assertions={"top": "ret <= 0.38", "tax": "tax <= 0.0425"})
    return stable.synthesize(spark, s, _table_cells(spark, d)).select("name", "status")


@query(f"WITH RECURSIVE c AS ({_CELLS}), g AS ({_FINE}), s AS (SELECT 0 AS step, NULL::DOUBLE AS threshold, NULL::VARCHAR AS status, (SELECT min(ret) FROM c) AS lower, (SELECT max(ret) FROM c) AS upper, (SELECT max(least) FROM g) AS best, (SELECT (max(ret) - min(ret)) * 0.05 FROM c) AS wide UNION ALL SELECT step + 1, (lower + upper) / 2, CASE WHEN best >= (lower + upper) / 2 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN best >= (lower + upper) / 2 THEN (lower + upper) / 2 ELSE lower END, CASE WHEN best >= (lower + upper) / 2 THEN upper ELSE (lower + upper) / 2 END, best, wide FROM s WHERE upper - lower > wide) SELECT step - 1 AS step, status, round(lower, 6) AS lower, round(upper, 6) AS upper FROM s WHERE step > 0")
def bisect_cells(spark, d):
    """The course of a threshold search."""
    return stable.bisect(spark, _cell_spec(), _table_cells(spark, d), "ret").select("step", "status", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


_CELLS4 = "SELECT 10 * (ceil(l_quantity / 10) - 1) AS qlo, 10 * ceil(l_quantity / 10) AS qhi, 2 * (ceil(l_linenumber / 2.0) - 1) AS nlo, 2 * ceil(l_linenumber / 2.0) AS nhi, 4 * (ceil(round(l_discount * 100) / 4.0) - 1) AS dlo, 4 * ceil(round(l_discount * 100) / 4.0) AS dhi, 3 * (ceil(round(l_tax * 100) / 3.0) - 1) AS tlo, 3 * ceil(round(l_tax * 100) / 3.0) AS thi, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS ret, round(avg(l_extendedprice), 4) AS price FROM lineitem GROUP BY ALL"
#: Stability boxes pass edges at whole numbers only, from below up to and with them: whole numbers stand for all configurations.
_VALUES4 = "SELECT q, n, dc, t, min(ret) AS least, max(price) AS dearest FROM (SELECT i AS q FROM range(1, 51) AS a(i)), (SELECT i AS n FROM range(1, 8) AS b(i)), (SELECT i AS dc FROM range(0, 11) AS e(i)), (SELECT i AS t FROM range(0, 9) AS f(i)), c WHERE q + 4 > qlo AND q - 4 <= qhi AND n + 1 > nlo AND n - 1 <= nhi AND dc + 1 > dlo AND dc - 1 <= dhi AND t + 1 > tlo AND t - 1 <= thi GROUP BY ALL"
_DEAR = [26_000, 38_000, 52_000, 70_000]


def _four_knobs(spark, d):
    """Shares of returned lines and mean prices by cell of quantity, line number, discount and tax (per cent), and their specification."""
    cell = lambda c, w: F.ceil(c / w).cast("double") * w
    cent = lambda c: F.round(F.col(c) * 100)
    ends = {"qty": (F.col("l_quantity"), 10), "line": (F.col("l_linenumber"), 2), "disc": (cent("l_discount"), 4), "tax": (cent("l_tax"), 3)}
    out = table(spark, d, "lineitem").groupBy(*[cell(*e).alias(f"hi_{k}") for k, e in ends.items()]).agg(F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 6).alias("ret"), F.round(F.avg("l_extendedprice"), 4).alias("price"))
    out = out.withColumns({f"lo_{k}": F.col(f"hi_{k}") - w for k, (_, w) in ends.items()})
    knob = lambda label, kind, lo, hi, rad: {"label": label, "interface": "knob", "type": kind, "range": [lo, hi], "rad-abs": rad}
    variables = [knob("qty", "real", 1, 50, 4), knob("line", "int", 1, 7, 1), knob("disc", "real", 0, 10, 1), knob("tax", "real", 0, 8, 1), *({"label": x, "interface": "output", "type": "real"} for x in ("ret", "price"))]
    return out, sp.from_dict({"version": "1.2", "variables": variables})


@query(f"WITH c AS ({_CELLS4}), v AS ({_VALUES4}) SELECT l AS price, max(least) AS least, CASE WHEN count(least) > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM unnest({_DEAR}) AS u(l) LEFT JOIN v ON dearest <= l GROUP BY l")
def search_knobs(spark, d):
    """The greatest stable share over four knobs, and whether there is any, where no price in reach is over a limit: by branch and bound."""
    cells, spec = _four_knobs(spark, d)
    cells = stored(cells, "cells")
    rows = []
    for top in _DEAR:
        best = stable.optimize(spark, spec, cells, "ret", f"price <= {top}").first()
        status = stable.query(spark, spec, cells, {"cheap": f"price <= {top}"}).first()["status"]
        rows.append((top, best["least"] if best else None, status))
    return spark.createDataFrame(rows, "price int, least double, status string")


_PARETO = f"WITH c AS ({_CELLS}), g AS ({_FINE}), s AS (SELECT min(least) AS a, max(least) AS z, min(-most_tax) AS b, max(-most_tax) AS y FROM g), u AS (SELECT least, -most_tax AS thrift, (least - a) / (z - a) AS u, (-most_tax - b) / (y - b) AS w FROM g, s)"


@query(f"{_PARETO} SELECT least AS ret, thrift, round(least(u, w), 9) AS level FROM u ORDER BY least(u, w) DESC, greatest(u, w) DESC LIMIT 1")
def pareto_cells(spark, d):
    """Max-min thresholds of two objectives over all real configurations of a cell model: the share of returned lines and low taxes."""
    cells = stored(_table_cells(spark, d).withColumn("thrift", -F.col("tax")), "cells")
    got = explore.thresholds(stable.critical_points(spark, _cell_spec(), cells), _cell_spec(), cells, ["ret", "thrift"])
    row = (got[-1]["objectives"]["ret"], got[-1]["objectives"]["thrift"], round(got[0]["level"], 9))
    return spark.createDataFrame([row], "ret double, thrift double, level double")


@query(f"WITH c AS ({_CELLS}), g AS ({_FINE}) SELECT CAST(qty AS BIGINT) AS qty, line FROM g WHERE least >= 0.325 AND qty = floor(qty)")
def region_cells(spark, d):
    """The set of all stable configurations as boxes, and the whole numbers in them."""
    boxes_ = stable.region(spark, _cell_spec(), _table_cells(spark, d), "ret >= 0.325")
    whole = lambda k: F.explode(F.sequence((F.floor(f"lo_{k}") + 1).cast("bigint"), F.floor(f"hi_{k}").cast("bigint"))).alias(k)
    some = boxes_.where("floor(lo_qty) < floor(hi_qty) AND floor(lo_line) < floor(hi_line)")
    return some.select("*", whole("qty")).select("qty", whole("line"))
