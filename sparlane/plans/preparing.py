"""Queries of sources, preparation, sampling, joins by position or pivot, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import prep, tables, windows
from ..sources import files
from ..sources import spec as sp
from .registry import query, table

_MD5 = "(('0x' || substr(md5(CAST({0} AS VARCHAR) || '/17'), 1, 7))::BIGINT / 268435456.0)"


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_returnflag <> 'N'")
def project_features(spark, d):
    """B1 B2: features and responses, rows without a response dropped."""
    df = table(spark, d, "lineitem").withColumn("l_extendedprice", F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")))
    return prep.drop_null_responses(prep.project(df, ["l_extendedprice"], ["l_orderkey", "l_linenumber", "l_quantity"]), ["l_extendedprice"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def drop_constant_columns(spark, d):
    """The region is constant here and goes."""
    return prep.drop_constant(table(spark, d, "nation").where("n_regionkey = 1"), keep=["n_name"])


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, (SELECT o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice / 50000) AS DOUBLE) END, (SELECT CAST(floor(o_totalprice / 50000) AS DOUBLE) FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS level FROM orders")
def impute_mode(spark, d):
    """Nulls become the most frequent value, the least of equals."""
    o = table(spark, d, "orders")
    df = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_totalprice") / 50000).cast("double")).alias("level"))
    return prep.impute_mode(df, ["priority", "level"])


@query("SELECT 'status' AS \"column\", o_orderkey AS \"row\" FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'price', o_orderkey FROM orders WHERE o_totalprice < 2000")
def missing_values(spark, d):
    """Places of nulls by column."""
    df = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_totalprice") >= 2000, F.col("o_totalprice")).alias("price"))
    return prep.missing(df, "o_orderkey")


@query("SELECT event_id, CASE WHEN value > 50 THEN 'True' ELSE 'False' END AS high, round(value * 2 + 1, 6) AS value, CAST(value > 20 AND value < 80 AS INTEGER) AS mid, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 END AS clicked FROM events")
def responses(spark, d):
    """Booleans as text, a mapped response, a condition as 0/1, labels as 1/0."""
    e = table(spark, d, "events").withColumn("high", F.col("value") > 50)
    e = prep.response_to_bool(prep.bools_to_strings(e), "20 < value < 80", ["mid"])
    e = prep.map_response(prep.relabel(e.withColumn("clicked", F.col("event_type")), "clicked", "click", "view"), ["value"], "x * 2 + 1")
    return e.select("event_id", "high", F.round("value", 6).alias("value"), "mid", "clicked")


@query("WITH f AS (SELECT c_mktsegment AS s, min(c_custkey) AS k FROM customer GROUP BY 1), m AS (SELECT s, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS code FROM f) SELECT c_custkey, code AS c_mktsegment FROM customer JOIN m ON s = c_mktsegment")
def encode_levels(spark, d):
    """Levels numbered in the order in which they first stand."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return prep.encode(c, "c_mktsegment", prep.levels(c, "c_mktsegment", "c_custkey"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - lo) / (hi - lo), 6) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)")
def scale_columns(spark, d):
    """One column scaled to [0, 1], the other scaled and back."""
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    b = prep.bounds(df, ["l_quantity", "l_extendedprice"])
    price = {"l_extendedprice": b["l_extendedprice"]}
    out = prep.unscale(prep.scale(prep.scale(df, {"l_quantity": b["l_quantity"]}), price), price)
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query("SELECT p_partkey, CAST(p_size >= 10 AND p_size < 20 AS INTEGER) AS p_size_10_20, CAST(p_brand = 'Brand#12' AS INTEGER) AS brand_12 FROM part")
def indicators(spark, d):
    """Range and level indicators with range names."""
    return table(spark, d, "part").select("p_partkey", prep.indicator("p_size", 10, 20).alias(prep.range_name("p_size", 10, 20)), prep.indicator("p_brand", level="Brand#12").alias("brand_12"))


@query("SELECT p_partkey, round(1 + 2 * pow((p_retailprice - lo) / (hi - lo), 3), 6) AS weight FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def sample_weights(spark, d):
    """Weights by the scaled response."""
    return prep.weights(table(spark, d, "part"), ["p_retailprice"], 1, 2, 3).select("p_partkey", F.round("weight", 6).alias("weight"))


SYSTEM = {"y1": "p_size * p_size - 3 * p_size + 2", "y2": "p_retailprice / 100 if p_size > 25 else -p_retailprice", "y3": "1 if 5 < p_size <= 15 or not p_retailprice < 1500 else 0", "y4": "abs(p_size - 25) ** 2"}


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * p_size - 3 * p_size + 2 AS y1, round(CASE WHEN p_size > 25 THEN p_retailprice / 100 ELSE -p_retailprice END, 6) AS y2, CASE WHEN (5 < p_size AND p_size <= 15) OR NOT p_retailprice < 1500 THEN 1 ELSE 0 END AS y3, CAST(abs(p_size - 25) * abs(p_size - 25) AS BIGINT) AS y4 FROM part")
def system_expressions(spark, d):
    """Expressions with powers, branches, chained comparisons and abs."""
    p = table(spark, d, "part")
    out = p.select("p_partkey", *[ex.column(e).alias(n) for n, e in SYSTEM.items()])
    return out.select("p_partkey", F.col("y1").cast("bigint").alias("y1"), F.round("y2", 6).alias("y2"), "y3", F.col("y4").cast("bigint").alias("y4"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 5 END AS matched, CAST(p_size > 10 OR NOT p_retailprice > 1200 AS BOOLEAN) AS implied, least(p_size, 20) AS least_of FROM part")
def logic_expressions(spark, d):
    """Match, implication and least."""
    p = table(spark, d, "part").withColumn("m", F.col("p_size") % 4)
    return p.select("p_partkey", ex.column(ex.parse("Match(m, 0, 10, 1, 20, 5)", infix=True)).alias("matched"), ex.column("implies(p_retailprice > 1200, p_size > 10)").alias("implied"), ex.column("min(p_size, 20)").alias("least_of"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 30 AND l_discount < 0.05) AND NOT l_tax >= 0.06 AND l_extendedprice >= 20000")
def filter_expression(spark, d):
    """A condition and lower limits."""
    df = table(spark, d, "lineitem").where(ex.column("(l_quantity > 30 and l_discount < 0.05) and not l_tax >= 0.06"))
    return tables.at_least(df, {"l_extendedprice": 20000}).select("l_orderkey", "l_linenumber")


@query(f"SELECT c_custkey, {_MD5.format('c_custkey')} < 0.7 AS train FROM customer")
def train_test_split(spark, d):
    """A split that depends on ids and a seed only."""
    a, b = prep.split(table(spark, d, "customer"), "c_custkey", 0.7)
    return a.select("c_custkey", F.lit(True).alias("train")).union(b.select("c_custkey", F.lit(False)))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def first_rows(spark, d):
    """The first rows by id."""
    return prep.first_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@query(f"SELECT c_custkey, c_acctbal FROM customer ORDER BY {_MD5.format('c_custkey')}, c_custkey LIMIT 20")
def random_rows(spark, d):
    """A sample without replacement by the hash of ids."""
    return prep.sample(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 20)


@query()
def resample_with_replacement(spark, d):
    """More rows than there are."""
    return prep.sample(table(spark, d, "nation"), "n_nationkey", 60)


@query()
def uniform_response_sample(spark, d):
    """C4: rows whose response is spread evenly."""
    return prep.sample_uniform(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), "p_partkey", ["p_retailprice", "p_size"], 200)


@query("WITH a AS (SELECT c_custkey, c_acctbal FROM customer), s AS (SELECT s_acctbal AS y, min(s_suppkey) AS k FROM supplier GROUP BY 1), j AS (SELECT c_custkey, k, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - y), y) AS r FROM a, s) SELECT c_custkey, k AS s_suppkey FROM j WHERE r = 1")
def nearest_join(spark, d):
    """Each customer's supplier with the nearest balance, without comparing all pairs."""
    c, s = table(spark, d, "customer").select("c_custkey", "c_acctbal"), table(spark, d, "supplier")
    lo, hi = prep.bounds(s, ["s_acctbal"])["s_acctbal"]
    return prep.nearest(c, "c_acctbal", s, "s_acctbal", "s_suppkey", lo, hi).select("c_custkey", "s_suppkey")


@query("SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN p END) AS p_F, max(CASE WHEN o_orderstatus = 'O' THEN p END) AS p_O, max(CASE WHEN o_orderstatus = 'P' THEN p END) AS p_P FROM (SELECT o_custkey, o_orderstatus, round(max(o_totalprice), 6) AS p FROM orders GROUP BY 1, 2) GROUP BY 1")
def pivot_responses(spark, d):
    """Responses by category, one row for each input."""
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.round(F.max("o_totalprice"), 6).alias("p"))
    return windows.pivot_responses(o, ["o_custkey"], "o_orderstatus", ["p"], ["F", "O", "P"])


@query("SELECT a.l_orderkey, a.l_quantity AS l_quantity_rx, b.l_quantity AS l_quantity_tx FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 AND b.l_linenumber = 2")
def pair_sides(spark, d):
    """Two sides joined on a key that must have one type."""
    li = table(spark, d, "lineitem")
    return windows.pair(li.where("l_linenumber = 1").select("l_orderkey", "l_quantity"), li.where("l_linenumber = 2").select("l_orderkey", "l_quantity"), "l_orderkey")


@query("SELECT a.t, a.n AS n_0, b.n AS n_1, c.n AS n_2 FROM (SELECT CAST(l_quantity AS BIGINT) AS t, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a JOIN (SELECT CAST(l_quantity AS BIGINT) AS t, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) b ON a.t = b.t JOIN (SELECT CAST(l_quantity AS BIGINT) AS t, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) c ON a.t = c.t")
def join_searches(spark, d):
    """Several results joined on their threshold."""
    li = table(spark, d, "lineitem").withColumn("t", F.col("l_quantity").cast("bigint"))
    return windows.join_searches([li.where(F.col("l_returnflag") == f).groupBy("t").agg(F.count("*").alias("n")) for f in "ANR"], "t")


@query("SELECT a.g AS x, b.g AS y FROM (SELECT unnest([1.0::DOUBLE, 2.0, 5.0]) AS g) a, (SELECT unnest([0.5::DOUBLE, 1.5, 2.5, 3.5]) AS g) b WHERE a.g + b.g < 6")
def knob_grid(spark, d):
    """All grid combinations that satisfy the candidates' constraint."""
    s = sp.from_dict({"version": "1.2", "variables": [{"label": "x", "interface": "knob", "type": "real", "grid": [1, 2, 5], "rad-abs": 0}, {"label": "y", "interface": "knob", "type": "real", "grid": [0.5, 1.5, 2.5, 3.5], "rad-rel": 0.1}], "eta": "x + y < 6"})
    return sp.grid_points(spark, s)


@query("SELECT CAST(pos % 3 AS INTEGER) AS part, CAST(pos AS INTEGER) AS pos, CAST(pos * 10 AS INTEGER) AS value FROM (SELECT unnest(range(10)) AS pos)")
def split_grid(spark, d):
    """A5: a grid dealt to parts by striding."""
    return sp.split_grid(spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x * 10).alias("g")), "g", 3)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3")
def restrict_values(spark, d):
    """Rows of one value, without its column."""
    return prep.restrict(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), {"s_nationkey": 3}, drop=True)


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-0.2 * (l_quantity - 25))), 6) AS weight, round(l_extendedprice - l_quantity, 6) AS gap FROM lineitem")
def logistic_and_difference(spark, d):
    """Logistic weight and the difference of two responses."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(prep.logistic(F.col("l_quantity"), 25, 0.1), 6).alias("weight"), F.round(prep.difference("l_extendedprice", "l_quantity"), 6).alias("gap"))


@query("SELECT CAST(l_quantity AS VARCHAR) || '/4' AS text, l_quantity / 4 AS value FROM (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem)")
def rational_strings(spark, d):
    """p/q as a number."""
    t = table(spark, d, "lineitem").select(F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit("/4")).alias("text")).distinct()
    return t.select("text", files.rational(F.col("text")).alias("value"))


_EYE = "max(t) OVER w - min(t) OVER w + 1 AS width, round(min(value) OVER w, 6) AS height"


@query(f"SELECT event_id, {_EYE} FROM (SELECT event_id, user_id, value, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 50000 PRECEDING AND 49999 FOLLOWING)")
def window_eye(spark, d):
    """Width and least height in the half-open window."""
    e = table(spark, d, "events").withColumn("t", F.unix_timestamp("ts"))
    return windows.eye(e, ["user_id"], "t", "value", 50000).select("event_id", "width", F.round("height", 6).alias("height"))


@query("SELECT event_id, round((1 / (1 + exp(-0.0002 * (width - 20000)))) * (1 / (1 + exp(-0.2 * (height - 30)))), 6) AS area FROM (SELECT event_id, max(t) OVER w - min(t) OVER w + 1 AS width, min(value) OVER w AS height FROM (SELECT event_id, user_id, value, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 30000 PRECEDING AND 30000 FOLLOWING))")
def window_area(spark, d):
    """logistic area in the closed window."""
    e = table(spark, d, "events").withColumn("t", F.unix_timestamp("ts"))
    return windows.area(e, ["user_id"], "t", "value", 30000, 20000, 0.0001, 30, 0.1).select("event_id", F.round("area", 6).alias("area"))


@query(" UNION ".join(f"SELECT event_id, {r}.0::DOUBLE AS radius, {_EYE} FROM (SELECT event_id, user_id, value, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {r} PRECEDING AND {r - 1} FOLLOWING)" for r in (10000, 20000, 40000)))
def window_radii(spark, d):
    """Several radii, united without repeats."""
    e = table(spark, d, "events").withColumn("t", F.unix_timestamp("ts")).select("event_id", "user_id", "t", "value")
    return windows.radii(e, ["user_id"], "t", "value", [10000, 20000, 40000]).select("event_id", "radius", "width", F.round("height", 6).alias("height"))


@query("SELECT o_custkey, o_orderstatus, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def keep_last(spark, d):
    """The last row for each set of features."""
    return windows.keep_last(table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, d):
    """Rows without repeats."""
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT 'customer' AS side, c_nationkey AS nation, round(c_acctbal, 6) AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, round(s_acctbal, 6) FROM supplier")
def keyed_union(spark, d):
    """H1 H3 H4: tables under each other with a key."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.round("c_acctbal", 6).alias("balance"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.round("s_acctbal", 6).alias("balance"))
    return windows.keyed_union({"customer": c, "supplier": s}, "side").select("side", "nation", "balance")
