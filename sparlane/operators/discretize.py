"""Bins of numeric columns: uniform, quantile, kmeans, jenks, ordinals, ranks.

Edges are computed once over value counts and are few; binning is then one expression. `bins` is cut to the number of
distinct values. Null stays null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prep import q
from .ranks import with_rank

#: Distinct values that the natural-breaks search takes (its time grows with their square); more is an error.
MOST_VALUES = 4000


def _summary(df: DataFrame, column: str, bins: int):
    r = df.agg(F.min(q(column)), F.max(q(column)), F.approx_count_distinct(q(column), 0.02)).first()
    n = r[2]
    if n < 2 * bins:  # near the limit the count must be exact; then there are few values
        n = df.where(q(column).isNotNull()).select(q(column)).distinct().limit(2 * bins + 1).count()
    return (None if r[0] is None else float(r[0])), (None if r[1] is None else float(r[1])), max(1, min(bins, n))


def uniform(df: DataFrame, column: str, bins: int = 10) -> Column:
    """Bins of one width; a value's bin is floor((v - min) / (max - min) * bins), the greatest value in the last."""
    lo, hi, k = _summary(df, column, bins)
    if lo is None or lo == hi:
        return F.when(q(column).isNotNull(), 0)
    return F.when(q(column).isNotNull(), F.least(F.floor((q(column) - F.lit(lo)) / F.lit(hi - lo) * F.lit(k)), F.lit(k - 1))).cast("int")


def _by_edges(column: str, inner: list[float], right: bool = False) -> Column:
    """The number of inner edges at or under the value (with `right`, under it)."""
    parts = [(q(column) > F.lit(e) if right else q(column) >= F.lit(e)).cast("int") for e in inner]
    return F.when(q(column).isNotNull(), sum(parts[1:], parts[0]) if parts else F.lit(0)).cast("int")


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    from .tables import quantiles

    _, _, k = _summary(df, column, bins)
    return sorted(set(quantiles(df, column, [i / k for i in range(k + 1)]) or []))


def quantile(df: DataFrame, column: str, bins: int = 10) -> Column:
    """Edges at the linear percentiles, each once; the greatest value lies in the last bin."""
    return _by_edges(column, quantile_edges(df, column, bins)[1:-1])


def kmeans_edges(df: DataFrame, column: str, bins: int, steps: int = 100) -> list[float]:
    """Midpoints between centers of one-dimensional k-means begun at the middles of uniform bins.

    Each step is one aggregate of the value counts by nearest center; only k sums reach the driver.
    """
    lo, hi, k = _summary(df, column, bins)
    if lo is None or lo == hi:
        return []
    counts = df.where(q(column).isNotNull()).groupBy(q(column).cast("double").alias("v")).agg(F.count("*").alias("n")).cache()
    centers = [lo + (hi - lo) * (i + 0.5) / k for i in range(k)]
    for _ in range(steps):
        mid = [(a + b) / 2 for a, b in zip(centers, centers[1:], strict=False)]
        sums = {r["c"]: r["s"] / r["n"] for r in counts.groupBy(_by_edges("v", mid).alias("c")).agg(F.sum(F.col("v") * F.col("n")).alias("s"), F.sum("n").alias("n")).collect()}
        new = [sums.get(i, c) for i, c in enumerate(centers)]
        if max(abs(a - b) for a, b in zip(new, centers, strict=True)) < 1e-9 * (hi - lo):
            break
        centers = sorted(new)
    counts.unpersist()
    return [(a + b) / 2 for a, b in zip(centers, centers[1:], strict=False)]


def kmeans(df: DataFrame, column: str, bins: int = 10) -> Column:
    return _by_edges(column, kmeans_edges(df, column, bins))


def natural_breaks(values: np.ndarray, counts: np.ndarray, k: int) -> list[float]:
    """Last value of each class but the last, for classes of sorted values with the least sum of squares inside."""
    n = values.size
    w, s, ss = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts * values, counts * values * values))
    best, back = np.full(n + 1, np.inf), np.zeros((k + 1, n + 1), int)
    best[0] = 0
    for c in range(1, k + 1):
        new = np.full(n + 1, np.inf)
        for j in range(c, n + 1):
            i = np.arange(c - 1, j)
            cost = best[i] + (ss[j] - ss[i]) - (s[j] - s[i]) ** 2 / (w[j] - w[i])
            a = int(cost.argmin())
            new[j], back[c, j] = cost[a], i[a]
        best = new
    out, j = [], n
    for c in range(k, 1, -1):
        j = back[c, j]
        out.append(float(values[j - 1]))
    return out[::-1]


def jenks(df: DataFrame, column: str, bins: int = 10) -> Column:
    """Fisher-Jenks natural breaks; bins are closed on the right, the outer ones open. Collects the distinct values (bounded)."""
    rows = df.where(q(column).isNotNull()).groupBy(q(column).cast("double").alias("v")).agg(F.count("*").alias("n")).limit(MOST_VALUES + 1).toPandas().sort_values("v")
    if len(rows) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} distinct values")
    if rows.empty:
        return F.lit(None).cast("int")
    return _by_edges(column, natural_breaks(rows.v.to_numpy(), rows.n.to_numpy(float), min(bins, len(rows))), right=True)


def discretize(df: DataFrame, columns: list[str], algorithm: str = "uniform", bins: int = 10, labels: bool = True, result: str = "object") -> DataFrame:
    """Columns replaced by bins: integers, or labels `Bin<k>` (result `integer` turns labels off)."""
    out = df
    for c in columns:
        if algorithm in ("ordinals", "ranks"):
            name = f"_{c}_rank"
            out = with_rank(out, c, name, "ordinal" if algorithm == "ordinals" else "max").withColumn(c, q(name).cast("bigint")).drop(name)
        else:
            out = out.withColumn(c, {"uniform": uniform, "quantile": quantile, "kmeans": kmeans, "jenks": jenks}[algorithm](df, c, bins))
        if result != "integer":
            out = out.withColumn(c, F.concat(F.lit("Bin"), q(c).cast("string")) if labels else q(c).cast("string"))
    return out.select(*map(q, df.columns))


def report(df: DataFrame, column: str) -> DataFrame:
    """(bin, n) of a discretized column."""
    return df.groupBy(q(column).alias("bin")).agg(F.count("*").alias("n"))
