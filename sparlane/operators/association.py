"""Correlation and association of columns.

Every measure is a sum over value pairs that are counted first, so only distinct pairs travel. `*_agg` functions are plain
aggregate Columns; the others return one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ..stored import stored
from .prep import q
from .ranks import rank_column, value_ranks

def pearson_agg(x: str, y: str) -> Column:
    return F.corr(q(x).cast("double"), q(y).cast("double"))


def concordance_agg(x: str, y: str) -> Column:
    """Lin's concordance: twice the covariance over the variances and the squared distance of the means (population)."""
    a, b = q(x).cast("double"), q(y).cast("double")
    both = lambda c: F.when(a.isNotNull() & b.isNotNull(), c)
    return F.try_divide(2 * F.covar_pop(a, b), F.var_pop(both(a)) + F.var_pop(both(b)) + F.pow(F.avg(both(a)) - F.avg(both(b)), F.lit(2)))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks, over rows with both values."""
    pairs = df.where(q(x).isNotNull() & q(y).isNotNull()).groupBy(q(x).alias("x"), q(y).alias("y")).agg(F.count("*").alias("w"))
    ranked = pairs
    for c in ("x", "y"):
        base = df.where(q(x).isNotNull() & q(y).isNotNull())
        r = value_ranks(base, x if c == "x" else y).select(F.col("v").alias(c), rank_column("average").alias(f"r{c}"))
        ranked = ranked.join(r, c)
    s = lambda c: F.sum(F.col("w") * c)
    n, a, b = F.sum("w"), F.col("rx"), F.col("ry")
    cov = s(a * b) / n - s(a) / n * s(b) / n
    return ranked.agg(F.try_divide(cov, F.sqrt((s(a * a) / n - F.pow(s(a) / n, F.lit(2))) * (s(b * b) / n - F.pow(s(b) / n, F.lit(2))))).alias("spearman"))


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n): the cross table in long form."""
    return df.where(q(x).isNotNull() & q(y).isNotNull()).groupBy(q(x).alias("x"), q(y).alias("y")).agg(F.count("*").alias("n"))


#: Distinct value pairs that one task of `concordance_counts` takes, about.
CELL_PAIRS = 500_000


def concordant_weight(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Sum of n_i * n_j over pairs with x_i < x_j and y_i < y_j.

    y's dense ranks are gone through bit by bit: two ranks compare as their first differing bit, so at each bit the rows of one
    prefix with a 0 there count, by running sums in the order of x, for those with a 1.
    """
    if x.size < 2:
        return 0.0
    rx, ry = (np.unique(v, return_inverse=True)[1].ravel().astype(np.int64) for v in (x, y))
    n, total = n.astype(float), 0.0
    base = np.argsort(rx, kind="stable")
    rx, ry, n = rx[base], ry[base], n[base]
    for bit in range(int(ry.max()).bit_length()):
        order = np.argsort(ry >> bit + 1, kind="stable")  # by prefix, then by x
        prefix, gx, one, w = ry[order] >> bit + 1, rx[order], (ry[order] >> bit) & 1, n[order]
        run = np.cumsum(np.where(one == 0, w, 0.0))
        before = run - np.where(one == 0, w, 0.0)
        start = np.concatenate([[True], prefix[1:] != prefix[:-1]])
        tie = start | np.concatenate([[True], gx[1:] != gx[:-1]])
        base_of = before[np.maximum.accumulate(np.where(start, np.arange(w.size), 0))]
        less = before[np.maximum.accumulate(np.where(tie, np.arange(w.size), 0))] - base_of
        total += float((w * less)[one == 1].sum())
    return total


def concordance_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: concordant, discordant, ties_x (and not y), ties_y (and not x), ties_xy pairs and n.

    Pairs are counted without meeting: value pairs are dealt to cells of x and of y. Two rows in different cells of both
    compare as their cells, by sums over the table of cells; two in one cell of x are compared in that cell's task; two in one
    cell of y but not of x in that cell's. A task holds about `CELL_PAIRS` distinct pairs; a cell of one value needs none.
    """
    t = contingency(df, x, y).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "n").persist()
    cells = max(1, -(-t.count() // CELL_PAIRS))
    spots = [i / cells for i in range(1, cells)]
    cuts = t.agg(F.percentile_approx("x", F.lit(spots), 10 * cells), F.percentile_approx("y", F.lit(spots), 10 * cells)).first() if spots else ([], [])
    place = lambda c, cut: sum(((F.col(c) > F.lit(float(e))).cast("int") for e in sorted(set(cut or []))), F.lit(0))
    t = t.withColumn("cx", place("x", cuts[0])).withColumn("cy", place("y", cuts[1]))
    grid = t.groupBy("cx", "cy").agg(F.sum("n").alias("n")).toPandas()
    far = concordant_weight(grid.cx.to_numpy(), grid.cy.to_numpy(), grid.n.to_numpy())
    sums = lambda *c: t.groupBy(*c).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0] or 0.0
    total = float(grid.n.sum())
    tx, ty, txy = sums("x"), sums("y"), sums("x", "y")

    def inside(first: str, second: str):
        def run(key, rows):
            got = concordant_weight(rows[first].to_numpy(), rows[second].to_numpy(), rows["n"].to_numpy())
            return pd.DataFrame({"c": [got]})

        return run

    ship(df.sparkSession)
    same_x = t.select("cx", "x", "y", "n").groupBy("cx").applyInPandas(inside("x", "y"), "c double")
    by_y = t.groupBy("cy", "cx", "y").agg(F.sum("n").alias("n"))
    same_y = by_y.groupBy("cy").applyInPandas(inside("cx", "y"), "c double")
    near = same_x.unionByName(same_y).agg(F.coalesce(F.sum("c"), F.lit(0.0))).first()[0]
    t.unpersist()
    concordant = far + near
    free = total * (total - 1) / 2 - tx - ty + txy
    row = (concordant, free - concordant, tx - txy, ty - txy, txy, int(total))
    return df.sparkSession.createDataFrame([row], "concordant double, discordant double, ties_x double, ties_y double, ties_xy double, n long")


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """tau_a, tau_b and Somers' D (y given x, without pairs tied on x)."""
    c = concordance_counts(df, x, y)
    d, free = F.col("concordant") - F.col("discordant"), F.col("concordant") + F.col("discordant")
    return c.select(
        F.try_divide(d, F.col("n") * (F.col("n") - 1) / 2).alias("tau_a"),
        F.try_divide(d, F.sqrt((free + F.col("ties_x")) * (free + F.col("ties_y")))).alias("tau_b"),
        F.try_divide(d, free + F.col("ties_y")).alias("somers_d"),
    )


def _with_margins(df: DataFrame, x: str, y: str) -> DataFrame:
    t = contingency(df, x, y)
    return t.join(t.groupBy("x").agg(F.sum("n").alias("nx")), "x").join(t.groupBy("y").agg(F.sum("n").alias("ny")), "y").crossJoin(t.agg(F.sum("n").alias("total")))


def cramers(df: DataFrame, x: str, y: str) -> DataFrame:
    """chi2, its share V squared, and V. Empty cells add their expected counts; two by two tables get Yates' correction."""
    m = _with_margins(df, x, y)
    e = F.col("nx") * F.col("ny") / F.col("total")
    full = m.agg(F.sum((F.col("n") - e) ** 2 / e).alias("cells"), F.sum(e).alias("met"), F.sum(F.pow(F.greatest(F.abs(F.col("n") - e) - 0.5, F.lit(0.0)), F.lit(2)) / e).alias("yates"), F.count("*").alias("k"), F.max("total").alias("total"), F.countDistinct("x").alias("r"), F.countDistinct("y").alias("c"))
    small = (F.col("r") == 2) & (F.col("c") == 2) & (F.col("k") == 4)
    chi = F.when(small, F.col("yates")).otherwise(F.col("cells") + F.col("total") - F.col("met"))
    v2 = F.try_divide(chi, F.col("total") * (F.least("r", "c") - 1))
    return full.select(chi.alias("chi2"), v2.alias("cramers_v2"), F.sqrt(v2).alias("cramers_v"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """mi (nats), the two entropies, and mi over their mean (1 if both are 0)."""
    m = _with_margins(df, x, y)
    n, t = F.col("n").cast("double"), F.col("total").cast("double")
    mi = F.sum(n / t * F.log(n * t / (F.col("nx") * F.col("ny"))))
    ent = lambda c: -F.sum(n / t * F.log(c / t))
    out = m.agg(mi.alias("mi"), ent(F.col("nx")).alias("hx"), ent(F.col("ny")).alias("hy"))
    return out.select("mi", "hx", "hy", F.when(F.col("hx") + F.col("hy") == 0, 1.0).otherwise(F.col("mi") / ((F.col("hx") + F.col("hy")) / 2)).alias("normalized_mi"))


def _chance(x: int, sizes: np.ndarray, n: int) -> np.ndarray:
    """Mean part of the mutual information of a cell in random tables of `n` rows, with row sum `x` and each of the column sums `sizes` (hypergeometric).

    Weights begin with 1 at the mode and follow by the ratio of neighbours, up and down, until they no longer count; their sum scales them.
    """
    b = sizes.astype(float)
    low, high = np.maximum(0.0, x + b - n), np.minimum(float(x), b)
    mode = np.clip(np.floor((x + 1.0) * (b + 1) / (n + 2.0)), low, high)
    part = lambda k, b: np.where(k > 0, k / n * np.log(np.maximum(k, 1) * (n / x) / b), 0.0)
    total, out = np.ones(b.size), part(mode, b)
    for up in (True, False):
        live, k, w = np.arange(b.size), mode.copy(), np.ones(b.size)
        while live.size:
            c = b[live]
            w = w * (((x - k) * (c - k)) / ((k + 1) * (n - x - c + k + 1)) if up else k * (n - x - c + k) / ((x - k + 1) * (c - k + 1)))
            k = k + 1 if up else k - 1
            some = (w > 1e-22) & (k <= high[live]) & (k >= low[live])
            live, k, w = live[some], k[some], w[some]
            total[live] += w
            out[live] += w * part(k, b[live])
    return out / total


def expected_mi(x: DataFrame, y: DataFrame, n: int) -> float:
    """Mean mutual information (nats) of random tables of `n` rows with the margins (size, count) of distinct sizes.

    Distinct sizes of `n` rows are at most the root of 2n: those of `y` go to all tasks, those of `x` are dealt out.
    """
    other = y.toArrow()
    sizes, many = other["size"].to_numpy(), other["count"].to_numpy().astype(float)
    ship(x.sparkSession)

    def run(batches):
        for b in batches:
            got = [float((_chance(s, sizes, n) * many).sum() * c) for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.float64())], names=["e"])

    dealt = x.select("size", "count").repartition(x.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, "e double").agg(F.coalesce(F.sum("e"), F.lit(0.0))).first()[0]


def adjusted_mi(df: DataFrame, x: str, y: str) -> float:
    """Chance-corrected mutual information; may be negative. 1 where both sides have one level or none.

    Levels of one size count together, whatever their number; expected values are summed in the tasks.
    """
    t = stored(contingency(df, x, y), "counts")
    sums = [t.groupBy(c).agg(F.sum("n").alias("size")).groupBy("size").agg(F.count("*").alias("count")) for c in ("x", "y")]
    levels = [s.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] for s in sums]
    if max(levels) <= 1:
        return 1.0
    r = mutual_information(df, x, y).first()
    e = expected_mi(*sums, t.agg(F.sum("n")).first()[0])
    top = (r["hx"] + r["hy"]) / 2 - e
    return (r["mi"] - e) / (top if abs(top) > 1e-15 else 1e-15)


def mi_of_correlation(r: Column) -> Column:
    """-ln(1 - r^2) / 2, infinite where r is within 1.5e-8 of 1."""
    return F.when(F.abs(1 - F.abs(r)) < 1.4901161193847656e-08, F.lit(float("inf"))).otherwise(-0.5 * F.log(1 - r * r))


def histogram_entropies(df: DataFrame, x: str, y: str) -> DataFrame:
    """hx, hy, hxy (bits) and mi of a square histogram with floor(sqrt(n / 5)) bins a side."""
    use = df.where(q(x).isNotNull() & q(y).isNotNull())
    s = use.agg(F.count("*").alias("n"), F.min(q(x)), F.max(q(x)), F.min(q(y)), F.max(q(y))).first()
    k = max(1, int(math.sqrt(s[0] / 5)))
    cell = lambda c, lo, hi: F.lit(0) if lo == hi else F.least(F.floor((q(c) - F.lit(float(lo))) / F.lit(float(hi) - float(lo)) * k), F.lit(k - 1)).cast("int")
    t = use.groupBy(cell(x, s[1], s[2]).alias("bx"), cell(y, s[3], s[4]).alias("by")).agg(F.count("*").alias("n")).groupBy("bx", "by").agg(F.sum("n").alias("n"))
    h = lambda d: d.agg((-F.sum(F.col("n") / F.lit(float(s[0])) * F.log2(F.col("n") / F.lit(float(s[0]))))).alias("h"))
    one = h(t.groupBy("bx").agg(F.sum("n").alias("n"))).withColumnRenamed("h", "hx")
    two = h(t.groupBy("by").agg(F.sum("n").alias("n"))).withColumnRenamed("h", "hy")
    return one.crossJoin(two).crossJoin(h(t).withColumnRenamed("h", "hxy")).withColumn("mi", F.col("hx") + F.col("hy") - F.col("hxy"))


def mean_encoding(df: DataFrame, feature: str, response: str) -> DataFrame:
    """(level, n, mean, rank): the response's mean by level of the feature, and the levels' order by it."""
    m = df.groupBy(q(feature).alias("level")).agg(F.count(q(response)).alias("n"), F.avg(q(response).cast("double")).alias("mean"))
    return m.withColumn("rank", F.dense_rank().over(Window.orderBy("mean")))


def mean_encoded_correlation(df: DataFrame, feature: str, response: str) -> DataFrame:
    """Correlation of a binary response with its mean by level, from sums by level only."""
    y = q(response).cast("double")
    g = df.where(q(feature).isNotNull() & y.isNotNull()).groupBy(q(feature)).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"))
    n, m = F.sum("n"), F.sum("s") / F.sum("n")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) / n - m * m
    return g.agg(F.try_divide(F.sqrt(F.greatest(between, F.lit(0.0))), F.sqrt(F.sum("ss") / n - m * m)).alias("correlation"))


def super_type(df: DataFrame, columns: Sequence[str], ordered: Sequence[str] = ()) -> str:
    """numeric, ordered, factor or mixed."""
    kinds = {"numeric" if isinstance(df.schema[c].dataType, T.NumericType) else "ordered" if c in ordered else "factor" for c in columns}
    return kinds.pop() if len(kinds) == 1 else "mixed"


def correlations(df: DataFrame, features: Sequence[str], response: str) -> DataFrame:
    """(feature, pearson, concordance, mi_from_corr) of numeric features and one response: one aggregate over all of them."""
    aggs = [e for i, f in enumerate(features) for e in (pearson_agg(f, response).alias(f"p{i}"), concordance_agg(f, response).alias(f"c{i}"))]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"p{i}").alias("pearson"), F.col(f"c{i}").alias("concordance")) for i, f in enumerate(features)])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("mi_from_corr", mi_of_correlation(F.col("pearson")))


ESTIMATORS = {
    "pearson": lambda df, x, y: df.agg(pearson_agg(x, y).alias("value")),
    "concordance": lambda df, x, y: df.agg(concordance_agg(x, y).alias("value")),
    "spearman": lambda df, x, y: spearman(df, x, y).toDF("value"),
    "kendall": lambda df, x, y: kendall(df, x, y).select(F.col("tau_b").alias("value")),
    "tau_a": lambda df, x, y: kendall(df, x, y).select(F.col("tau_a").alias("value")),
    "somers": lambda df, x, y: kendall(df, x, y).select(F.col("somers_d").alias("value")),
    "cramers": lambda df, x, y: cramers(df, x, y).select(F.col("cramers_v2").alias("value")),
    "shannon": lambda df, x, y: mutual_information(df, x, y).select(F.col("mi").alias("value")),
    "normalized": lambda df, x, y: mutual_information(df, x, y).select(F.col("normalized_mi").alias("value")),
    "mean_encoding": lambda df, x, y: mean_encoded_correlation(df, x, y).toDF("value"),
}


def estimator_for(df: DataFrame, feature: str, response: str, numeric: str = "pearson") -> str:
    """By types: numbers by `numeric`, a factor with a number by its means, two factors by Cramer."""
    number = [isinstance(df.schema[c].dataType, T.NumericType) for c in (feature, response)]
    return numeric if all(number) else "mean_encoding" if number == [False, True] else "cramers"


def score_table(df: DataFrame, features: Sequence[str], response: str, estimators: Sequence[str]) -> DataFrame:
    """(feature, one column for each estimator); an estimator that does not fit the types gives null."""
    out = None
    for e in estimators:
        part = None
        for f in features:
            fits = e in ("shannon", "normalized", "cramers") or isinstance(df.schema[f].dataType, T.NumericType) or e == "mean_encoding"
            one = ESTIMATORS[e](df, f, response).select(F.lit(f).alias("feature"), F.col("value").cast("double").alias(e)) if fits else None
            part = one if part is None else part if one is None else part.unionByName(one)
        if part is not None:
            out = part if out is None else out.join(part, "feature", "full_outer")
    return out
