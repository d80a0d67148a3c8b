"""Queries of aggregates, ranks, association, bins, selection, subgroups, and quality measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality as ql
from ..operators import association as assoc
from ..operators import discretize as disc
from ..operators import models, ranks, selection, subgroups, tables
from .registry import query, table


def _round(df, *keep):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c, t in df.dtypes if c not in keep and t == "double"], *[F.col(c) for c, t in df.dtypes if c not in keep and t != "double"])


@query("SELECT 'l_quantity' AS \"column\", round(min(l_quantity), 6) AS min, round(max(l_quantity), 6) AS max, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem UNION ALL SELECT 'l_tax', round(min(l_tax), 6), round(max(l_tax), 6), round(avg(l_tax), 6), round(stddev_pop(l_tax), 6) FROM lineitem")
def column_stats(spark, d):
    """Bounds, mean and population deviation by column."""
    return _round(subgroups.feature_stats(table(spark, d, "lineitem"), ["l_quantity", "l_tax"]), "column")


@query("SELECT count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def describe(spark, d):
    """Count, linear quartiles, distinct values."""
    li = table(spark, d, "lineitem")
    return tables.describe(li, ["l_extendedprice"]).select("n", *[F.round(f"q{k}", 4).alias(f"q{k}") for k in (25, 50, 75)]).crossJoin(li.agg(F.countDistinct("l_suppkey").alias("suppliers")))


@query("SELECT round(min(l_extendedprice * (1 - l_discount)), 4) AS lower, round(max(l_extendedprice * (1 - l_discount)), 4) AS upper FROM lineitem")
def objective_bounds(spark, d):
    """Bounds of an expression."""
    from ..functions import expressions as ex

    o = ex.column("l_extendedprice * (1 - l_discount)")
    return table(spark, d, "lineitem").agg(F.round(F.min(o), 4).alias("lower"), F.round(F.max(o), 4).alias("upper"))


@query("SELECT o_orderpriority AS level, count(*) AS n, round(avg(o_totalprice), 4) AS mean, CAST(dense_rank() OVER (ORDER BY avg(o_totalprice)) AS INTEGER) AS rank FROM orders GROUP BY 1")
def mean_encoding(spark, d):
    """Mean of the response by level, and the levels' order."""
    m = assoc.mean_encoding(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return m.select("level", "n", F.round("mean", 4).alias("mean"), "rank")


@query("SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY 1, 2")
def cross_table(spark, d):
    """Cross table in long form."""
    return assoc.contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


_CELLS = "count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE NOT p AND y) AS fn, count(*) FILTER (WHERE NOT p AND NOT y) AS tn"


@query(f"WITH c AS (SELECT {_CELLS} FROM (SELECT l_quantity > 25 AS p, l_returnflag = 'R' AS y FROM lineitem)), m AS (SELECT *, (tp + fp + fn + tn)::DOUBLE AS n FROM c), r AS (SELECT round((tp + tn) / n, 4) AS accuracy, round((tp / (tp + fn)::DOUBLE - fp / (fp + tn)::DOUBLE + 1) / 2, 4) AS roc_accuracy, round(((tp + fp) / n * (tp / (tp + fp)::DOUBLE - (tp + fn) / n) + 1) / 2, 4) AS wracc, round(((tp + tn) / n - ((fn + tn) * tn + (tp + fp) * tp) / (n * n)) / (1 - ((fn + tn) * tn + (tp + fp) * tp) / (n * n)), 4) AS kappa, round(tp / (tp + fp)::DOUBLE, 4) AS pre, round(tp / (tp + fn)::DOUBLE, 4) AS rec, round((tp / (tp + fn)::DOUBLE) / (tp / (tp + fn)::DOUBLE + fp / (fp + tn)::DOUBLE), 4) AS normalized_plr, round((tp / (tp + fp)::DOUBLE) / ((tp + fn) / n), 4) AS lift, tp, fp, fn, tn FROM m), s AS (SELECT *, round(2 * pre * rec / (pre + rec), 4) AS f1, round(0.5 * rec + 0.5 * pre, 4) AS balanced_precision FROM r) SELECT tp, fp, fn, tn, accuracy, roc_accuracy, wracc, kappa, f1, normalized_plr, balanced_precision, lift, round((accuracy + roc_accuracy + wracc + kappa + f1 + normalized_plr + balanced_precision) / 7, 4) AS ensemble FROM s")
def quality_measures(spark, d):
    """Counts of the four cells and all measures."""
    df = table(spark, d, "lineitem").select((F.col("l_quantity") > 25).alias("p"), (F.col("l_returnflag") == "R").alias("y"))
    c = df.agg(F.count_if(F.col("p") & F.col("y")).alias("tp"), F.count_if(F.col("p") & ~F.col("y")).alias("fp"), F.count_if(~F.col("p") & F.col("y")).alias("fn"), F.count_if(~F.col("p") & ~F.col("y")).alias("tn"))
    return c.withColumns(ql.all_measures(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]))


@query("WITH r AS (SELECT value AS v, event_type = 'purchase' AS y FROM events), k AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM r) SELECT round((sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)), 6) AS auroc FROM k")
def auroc(spark, d):
    """Area under the curve by average ranks."""
    e = table(spark, d, "events").select("value", (F.col("event_type") == "purchase").alias("y"))
    return tables.auroc(e, "value", "y").select(F.round("auroc", 6).alias("auroc"))


@query("WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), x AS (SELECT (p_retailprice - lo) / (hi - lo) AS r, p_size >= 10 AND p_size < 30 AS i FROM part, b) SELECT round(sum(CASE WHEN i THEN r ELSE 0 END), 4) AS tp, round(sum(CASE WHEN NOT i THEN r ELSE 0 END), 4) AS fn, round(sum(CASE WHEN i THEN 1 - r ELSE 0 END), 4) AS fp, round(sum(CASE WHEN NOT i THEN 1 - r ELSE 0 END), 4) AS tn FROM x")
def soft_frequencies(spark, d):
    """Soft cell counts of a numeric response."""
    f = subgroups.frequencies(table(spark, d, "part"), [subgroups.Selector("p_size", 10, 30)], "p_retailprice")
    return f.select(*[F.round(c, 4).alias(c) for c in ("tp", "fn", "fp", "tn")])


@query("SELECT p_partkey, CAST(rank() OVER (ORDER BY p_retailprice) + count(*) OVER (PARTITION BY p_retailprice) - 1 AS BIGINT) AS max_rank, dense_rank() OVER (ORDER BY p_size) - 1 AS ordinal, round(rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0, 6)::DOUBLE AS average_rank FROM part")
def column_ranks(spark, d):
    """Ranks without a window over all rows."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    out = ranks.with_rank(ranks.with_rank(ranks.with_rank(p, "p_retailprice", "max_rank", "max"), "p_size", "ordinal", "ordinal"), "p_size", "average_rank", "average")
    return out.select("p_partkey", F.col("max_rank").cast("bigint").alias("max_rank"), F.col("ordinal").cast("bigint").alias("ordinal"), F.col("average_rank").cast("double").alias("average_rank"))


_FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{f}' AS feature, round(corr({f}, l_extendedprice), 6) AS pearson, round(2 * covar_pop({f}, l_extendedprice) / (var_pop({f}) + var_pop(l_extendedprice) + pow(avg({f}) - avg(l_extendedprice), 2)), 6) AS concordance, round(-0.5 * ln(1 - corr({f}, l_extendedprice) * corr({f}, l_extendedprice)), 6) + 0.0::DOUBLE AS mi_from_corr FROM lineitem" for f in _FEATURES))
def correlations(spark, d):
    """Correlation, concordance and information from correlation, all features in one aggregate."""
    out = _round(assoc.correlations(table(spark, d, "lineitem"), _FEATURES, "l_extendedprice"), "feature")
    return out.withColumn("mi_from_corr", F.col("mi_from_corr") + 0.0)  # no negative zero


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman(spark, d):
    """Rank correlation."""
    return _round(assoc.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("WITH t AS (SELECT l_quantity AS x, l_discount AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN a.n * b.n ELSE 0 END) / 2 AS c, sum(CASE WHEN (a.x - b.x) * (a.y - b.y) < 0 THEN a.n * b.n ELSE 0 END) / 2 AS k, sum(CASE WHEN a.x = b.x AND a.y <> b.y THEN a.n * b.n ELSE 0 END) / 2 AS tx, sum(CASE WHEN a.y = b.y AND a.x <> b.x THEN a.n * b.n ELSE 0 END) / 2 AS ty FROM t a, t b), n AS (SELECT sum(n) AS n FROM t) SELECT round((c - k) / (n * (n - 1) / 2), 6) AS tau_a, round((c - k) / sqrt((c + k + tx) * (c + k + ty)), 6) AS tau_b, round((c - k) / (c + k + ty), 6) AS somers_d FROM p, n")
def kendall(spark, d):
    """Pair measures from distinct value pairs."""
    return _round(assoc.kendall(table(spark, d, "lineitem"), "l_quantity", "l_discount"))


@query("WITH t AS (SELECT o_orderpriority AS x, o_orderstatus AS y, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), m AS (SELECT a.x, b.y, a.nx, b.ny, s.n AS total, coalesce(t.n, 0) AS n FROM (SELECT x, sum(n) AS nx FROM t GROUP BY 1) a CROSS JOIN (SELECT y, sum(n) AS ny FROM t GROUP BY 1) b CROSS JOIN (SELECT sum(n) AS n FROM t) s LEFT JOIN t ON t.x = a.x AND t.y = b.y), c AS (SELECT sum((n - nx * ny / total) * (n - nx * ny / total) / (nx * ny / total)) AS chi2, max(total) AS total, least(count(DISTINCT x), count(DISTINCT y)) AS k FROM m) SELECT round(chi2, 4) AS chi2, round(chi2 / (total * (k - 1)), 6) AS cramers_v2, round(sqrt(chi2 / (total * (k - 1))), 6) AS cramers_v FROM c")
def cramers(spark, d):
    """Chi square and Cramer's V."""
    c = assoc.cramers(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")
    return c.select(F.round("chi2", 4).alias("chi2"), F.round("cramers_v2", 6).alias("cramers_v2"), F.round("cramers_v", 6).alias("cramers_v"))


@query("WITH t AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT t.*, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS s FROM t), h AS (SELECT sum(n / s * ln(n * s / (nx * ny))) AS mi, -sum(n / s * ln(nx / s)) AS hx, -sum(n / s * ln(ny / s)) AS hy FROM m) SELECT round(mi, 6) AS mi, round(hx, 6) AS hx, round(hy, 6) AS hy, round(mi / ((hx + hy) / 2), 6) AS normalized_mi FROM h")
def mutual_information(spark, d):
    """Mutual information and its normalised form."""
    return _round(assoc.mutual_information(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


def _adjusted(x: str, y: str) -> str:
    """SQL: information of a table less that of random tables with its margins, by distinct pairs of margins and log-gamma."""
    margin = lambda c: f"SELECT s, count(*) AS m FROM (SELECT count(*)::DOUBLE AS s FROM lineitem GROUP BY {c}) GROUP BY s"
    entropy = lambda c: f"(SELECT -sum(c / n * ln(c / n)) FROM (SELECT count(*)::DOUBLE AS c FROM lineitem GROUP BY {c}), t)"
    chance = "exp(lgamma(a.s + 1) + lgamma(b.s + 1) + lgamma(n - a.s + 1) + lgamma(n - b.s + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a.s - k + 1) - lgamma(b.s - k + 1) - lgamma(n - a.s - b.s + k + 1)) * k / n * ln(n * k / (a.s * b.s))"
    e = f"(SELECT sum(a.m * b.m * {chance}) FROM a, b, t, unnest(range(CAST(greatest(1, a.s + b.s - n) AS BIGINT), CAST(least(a.s, b.s) AS BIGINT) + 1)) AS r(k))"
    return f"WITH t AS (SELECT count(*)::DOUBLE AS n FROM lineitem), a AS ({margin(x)}), b AS ({margin(y)}), h AS (SELECT {entropy(x)} AS hx, {entropy(y)} AS hy, {entropy(x + ', ' + y)} AS hxy, {e} AS e) SELECT round((hx + hy - hxy - e) / ((hx + hy) / 2 - e), 6) AS adjusted_mi FROM h"


@query(_adjusted("l_returnflag", "l_linestatus"))
def adjusted_mutual_information(spark, d):
    """Corrected for chance."""
    li = table(spark, d, "lineitem")
    return spark.createDataFrame([(round(assoc.adjusted_mi(li, "l_returnflag", "l_linestatus"), 6),)], "adjusted_mi double")


@query(_adjusted("l_partkey", "l_suppkey"))
def adjusted_information_of_keys(spark, d):
    """Of two columns with a level for each part and supplier."""
    li = table(spark, d, "lineitem")
    return spark.createDataFrame([(round(assoc.adjusted_mi(li, "l_partkey", "l_suppkey"), 6),)], "adjusted_mi double")


@query("WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), s AS (SELECT count(*) AS n, greatest(1, CAST(floor(sqrt(count(*) / 5)) AS INTEGER)) AS k, min(x) AS ax, max(x) AS zx, min(y) AS ay, max(y) AS zy FROM p), b AS (SELECT least(CAST(floor((x - ax) / (zx - ax) * k) AS INTEGER), k - 1) AS bx, least(CAST(floor((y - ay) / (zy - ay) * k) AS INTEGER), k - 1) AS cy, n FROM p, s), h AS (SELECT (SELECT -sum(c / n::DOUBLE * log2(c / n::DOUBLE)) FROM (SELECT bx, any_value(n) AS n, count(*) AS c FROM b GROUP BY 1)) AS hx, (SELECT -sum(c / n::DOUBLE * log2(c / n::DOUBLE)) FROM (SELECT cy, any_value(n) AS n, count(*) AS c FROM b GROUP BY 1)) AS hy, (SELECT -sum(c / n::DOUBLE * log2(c / n::DOUBLE)) FROM (SELECT bx, cy, any_value(n) AS n, count(*) AS c FROM b GROUP BY 1, 2)) AS hxy) SELECT round(hx, 6) AS hx, round(hy, 6) AS hy, round(hxy, 6) AS hxy, round(hx + hy - hxy, 6) AS mi FROM h")
def histogram_information(spark, d):
    """Entropies of a square histogram."""
    return _round(assoc.histogram_entropies(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("SELECT round(sqrt(var_pop(m) / var_pop(y)), 6) AS correlation FROM (SELECT quality::DOUBLE AS y, avg(quality) OVER (PARTITION BY source) AS m FROM labels JOIN documents USING (doc_id))")
def mean_encoded_correlation(spark, d):
    """A factor with a binary response."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return _round(assoc.mean_encoded_correlation(j, "source", "quality"))


_UNI = "least(CAST(floor((l_extendedprice - lo) / (hi - lo) * 8) AS INTEGER), 7)"


@query(f"SELECT {_UNI} AS bin, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1")
def discretize_uniform(spark, d):
    """K1: bins of one width."""
    return disc.report(disc.discretize(table(spark, d, "lineitem").select("l_extendedprice"), ["l_extendedprice"], "uniform", 8, result="integer"), "l_extendedprice")


@query("WITH e AS (SELECT DISTINCT unnest(quantile_cont(l_quantity, [0.2, 0.4, 0.6, 0.8])) AS e FROM lineitem) SELECT 'Bin' || b AS bin, count(*) AS n FROM (SELECT (SELECT count(*) FROM e WHERE l_quantity >= e) AS b FROM lineitem) GROUP BY 1")
def discretize_quantile(spark, d):
    """K2: bins between linear percentiles, with labels."""
    return disc.report(disc.discretize(table(spark, d, "lineitem").select("l_quantity"), ["l_quantity"], "quantile", 5), "l_quantity")


@query()
def discretize_kmeans(spark, d):
    """K3: bins between the centers of k-means."""
    return disc.report(disc.discretize(table(spark, d, "part").select("p_retailprice"), ["p_retailprice"], "kmeans", 6, result="integer"), "p_retailprice")


@query()
def discretize_jenks(spark, d):
    """K4: natural breaks."""
    return disc.report(disc.discretize(table(spark, d, "part").select("p_size"), ["p_size"], "jenks", 5, result="integer"), "p_size")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_size) - 1 AS p_size FROM part")
def discretize_ordinals(spark, d):
    """K5: ordinals."""
    return disc.discretize(table(spark, d, "part").select("p_partkey", "p_size"), ["p_size"], "ordinals", result="integer")


@query(" UNION ALL ".join(f"SELECT '{f}' AS feature, round(r * r / (1 - r * r) * (n - 2), 4) AS score FROM (SELECT corr({f}, l_extendedprice) AS r, count(*) AS n FROM lineitem)" for f in _FEATURES))
def regression_scores(spark, d):
    """L1: F statistic of each feature."""
    s = selection.regression_f(table(spark, d, "lineitem"), _FEATURES, "l_extendedprice")
    return s.select("feature", F.round("score", 4).alias("score"))


@query(" UNION ALL ".join(f"SELECT '{f}' AS feature, round((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1) / (sum(ss - s * s / n) / (sum(n) - count(*))), 4) AS score FROM (SELECT count(*)::DOUBLE AS n, sum({f}) AS s, sum({f} * {f}) AS ss FROM lineitem GROUP BY l_returnflag)" for f in _FEATURES))
def classification_scores(spark, d):
    """ANOVA's F by class."""
    s = selection.anova_f(table(spark, d, "lineitem"), _FEATURES, "l_returnflag")
    return s.select("feature", F.round("score", 4).alias("score"))


@query("SELECT o_orderkey, round(coalesce((s - o_totalprice) / nullif(n - 1, 0), m), 4) AS encoded FROM (SELECT o_orderkey, o_totalprice, sum(o_totalprice) OVER (PARTITION BY o_orderpriority) AS s, count(*) OVER (PARTITION BY o_orderpriority) AS n, avg(o_totalprice) OVER () AS m FROM orders)")
def leave_one_out(spark, d):
    """L1: a factor as the mean of the other rows of its level."""
    out = selection.leave_one_out(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "encoded")
    return out.select("o_orderkey", F.round("encoded", 4).alias("encoded"))


@query()
def mrmr(spark, d):
    """Features chosen in turn."""
    got = selection.mrmr(table(spark, d, "lineitem"), [*_FEATURES, "l_linenumber"], "l_extendedprice", 3)
    return spark.createDataFrame([(i, f, round(s, 6)) for i, (f, s) in enumerate(got)], "turn int, feature string, score double")


@query("WITH s(feature, a, b) AS (VALUES ('p', 0.5::DOUBLE, 3::DOUBLE), ('q', -1.0, NULL), ('r', 0.25, 'inf'::DOUBLE), ('s', NULL, 6.0)), f AS (SELECT feature, coalesce(abs(a), 0) AS a, CASE WHEN b IS NULL THEN 0 WHEN isinf(b) THEN 10 * (SELECT max(abs(b)) FROM s WHERE NOT isinf(b)) ELSE abs(b) END AS b FROM s), n AS (SELECT feature, a / (SELECT max(a) FROM f) AS a, b / (SELECT max(b) FROM f) AS b FROM f) SELECT feature, round(a, 6) AS a, round(b, 6) AS b, round((a + b) / 2, 6) AS ranking FROM n")
def ensemble_ranking(spark, d):
    """Scaled scores and their mean."""
    s = spark.createDataFrame([("p", 0.5, 3.0), ("q", -1.0, None), ("r", 0.25, float("inf")), ("s", None, 6.0)], "feature string, a double, b double")
    return _round(selection.ensemble(s, ["a", "b"]), "feature")


@query()
def correlate(spark, d):
    """The ranking over several responses and estimators."""
    out = selection.correlate(table(spark, d, "part"), ["p_size", "p_brand"], ["p_retailprice"], ["pearson", "mean_encoding"])
    return _round(out, "feature")


_SG = "p_size >= 10 AND p_size < 30"


@query(f"SELECT round(count(*) FILTER (WHERE {_SG}) / count(*)::DOUBLE * (avg(p_retailprice) FILTER (WHERE {_SG}) - avg(p_retailprice)), 6) AS quality FROM part")
def subgroup_quality(spark, d):
    """M3: quality of a given group for a numeric response."""
    got = subgroups._evaluate(table(spark, d, "part"), [(subgroups.Selector("p_size", 10, 30),)], "p_retailprice", "mean_1")
    return spark.createDataFrame([(round(v, 6),) for v, _ in got], "quality double")


@query()
def subgroup_discovery(spark, d):
    """Beam search over documents for low quality."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id").withColumn("low", 1 - F.col("quality"))
    return subgroups.discover(j, ["lang", "source", "n_chars"], ["low"], depth=2, top=8)


@query("SELECT CASE WHEN l_quantity > 45 AND l_returnflag = 'R' THEN 'TP' WHEN l_quantity > 45 THEN 'FP' WHEN l_returnflag = 'R' THEN 'FN' ELSE 'TN' END AS cell, count(*) AS n FROM lineitem GROUP BY 1")
def sample_cells(spark, d):
    """Rows by cell."""
    li = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    cells = subgroups.sample_lists(li.where("l_quantity is not null"), [subgroups.Selector("l_quantity", 45.5, None)], F.col("l_returnflag") == "R", "id")
    return cells.groupBy("cell").agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 10 AS w FROM orders) SELECT least(CAST(floor((o_totalprice - lo) / w) AS INTEGER), 9) AS bin, round(any_value(lo) + least(floor((o_totalprice - lo) / w), 9) * any_value(w), 4) AS lo, count(*) AS n FROM orders, b GROUP BY 1, least(floor((o_totalprice - lo) / w), 9)")
def response_histogram(spark, d):
    """What a plot of the response shows."""
    h = models.histogram(table(spark, d, "orders"), "o_totalprice", 10)
    return h.select("bin", F.round("lo", 4).alias("lo"), "n")


@query("WITH t AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2.0) AS ab, sum(n)::DOUBLE AS n FROM t), a AS (SELECT sum(m * (m - 1) / 2.0) AS a FROM (SELECT sum(n) AS m FROM t GROUP BY x)), b AS (SELECT sum(m * (m - 1) / 2.0) AS b FROM (SELECT sum(n) AS m FROM t GROUP BY y)), f AS (SELECT *, n * (n - 1) / 2 AS total FROM s, a, b) SELECT round((total + 2 * ab - a - b) / total, 6) AS rand, round((ab - a * b / total) / ((a + b) / 2 - a * b / total), 6) AS adjusted FROM f")
def rand_agreement(spark, d):
    """Rand index of two labelings, plain and adjusted."""
    return _round(tables.rand_index(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@query("SELECT o_orderpriority AS level, count(*) AS n, round(max(o_totalprice) - min(o_totalprice), 4) AS spread FROM orders GROUP BY 1")
def grouped_callback(spark, d):
    """A function of each group's rows."""

    def spread(key, rows):
        return rows.groupby("o_orderpriority", as_index=False).agg(n=("o_totalprice", "size"), lo=("o_totalprice", "min"), hi=("o_totalprice", "max")).assign(level=key[0], spread=lambda t: t.hi - t.lo)[["level", "n", "spread"]]

    out = tables.grouped(table(spark, d, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], spread, "level string, n long, spread double")
    return out.withColumn("spread", F.round("spread", 4))


@query("SELECT 'l_quantity' AS \"column\", round((min(l_quantity) - avg(l_quantity)) / stddev_pop(l_quantity), 6) AS z_min, round((max(l_quantity) - avg(l_quantity)) / stddev_pop(l_quantity), 6) AS z_max FROM lineitem")
def end_scores(spark, d):
    """Z-scores of the least and greatest values."""
    return _round(tables.z_scores(table(spark, d, "lineitem"), ["l_quantity"]), "column")


@query("SELECT c_custkey, CAST(c_acctbal AS BIGINT) AS whole, TRY_CAST(c_name AS DOUBLE) AS number, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 END AS place FROM (SELECT c_custkey, trunc(c_acctbal) AS c_acctbal, c_name, c_mktsegment FROM customer)")
def casts(spark, d):
    """Casts to numbers and ordered levels."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("whole"), F.col("c_name").alias("number"), F.col("c_mktsegment").alias("place"))
    return tables.cast_to(c, {"whole": "int", "number": "float", "place": ["BUILDING", "MACHINERY"]})
