"""Sliding-window preparation of measurements by an integer timing axis."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prep import logistic, q


def _frame(groups: Sequence[str], timing: str, radius: float, closed: bool):
    hi = math.floor(radius) if closed else math.ceil(radius) - 1
    return Window.partitionBy(*map(q, groups)).orderBy(q(timing)).rangeBetween(-math.floor(radius), hi)


def eye(df: DataFrame, groups: Sequence[str], timing: str, delta: str, radius: float, closed: bool = False) -> DataFrame:
    """Adds `width` (last less first timing, plus 1) and `height` (least delta) of the rows within `radius` before and after.

    The window is [-radius, radius), or with `closed` [-radius, radius]; timings are integers, so a fractional radius is cut to
    the integers in it.
    """
    w = _frame(groups, timing, radius, closed)
    return df.withColumns({"width": F.max(q(timing)).over(w) - F.min(q(timing)).over(w) + 1, "height": F.min(q(delta)).over(w)})


def area(df: DataFrame, groups: Sequence[str], timing: str, delta: str, radius: float, width0: float, width_slope: float, height0: float, height_slope: float) -> DataFrame:
    """`eye` with the closed window, and `area`: the product of the logistic weights of width and height."""
    e = eye(df, groups, timing, delta, radius, closed=True)
    return e.withColumn("area", logistic(q("width"), width0, width_slope) * logistic(q("height"), height0, height_slope))


def radii(df: DataFrame, groups: Sequence[str], timing: str, delta: str, each: Sequence[float], closed: bool = False) -> DataFrame:
    """`eye` for several radii, one under the other without repeated rows; `radius` tells which.

    Equal rows have equal windows, so repeats go before; then all radii are frames over one sort, and no row with its results is compared again.
    """
    cells = []
    for r in sorted({float(r) for r in each}):
        w = _frame(groups, timing, r, closed)
        cells.append(F.struct((F.max(q(timing)).over(w) - F.min(q(timing)).over(w) + 1).alias("width"), F.min(q(delta)).over(w).alias("height"), F.lit(r).alias("radius")))
    rows = df.distinct().withColumn("_eyes", F.array(*cells))
    return rows.select(*map(q, df.columns), F.explode("_eyes").alias("_eye")).select(*map(q, df.columns), "_eye.*")


def pivot_responses(df: DataFrame, inputs: Sequence[str], category: str, responses: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """A row for each combination of inputs, with each response by category level: <response>_<level>."""
    aggs = [F.first(q(r), True).alias(r) for r in responses]
    out = df.groupBy(*map(q, inputs)).pivot(category, list(levels)).agg(*aggs)
    return out.withColumnsRenamed({f"{v}_{r}" if len(responses) > 1 else v: f"{r}_{v}" for v in levels for r in responses})


def pair(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str] = ("_rx", "_tx")) -> DataFrame:
    """Rows of two tables with one key joined; all other columns get the side's suffix. Their kinds must agree."""
    if dict(left.dtypes)[key] != dict(right.dtypes)[key]:
        raise ValueError(f"{key}: {dict(left.dtypes)[key]} and {dict(right.dtypes)[key]}")
    a = left.select(q(key), *[q(c).alias(c + suffixes[0]) for c in left.columns if c != key])
    b = right.select(q(key), *[q(c).alias(c + suffixes[1]) for c in right.columns if c != key])
    return a.join(b, key)


def join_searches(tables: Sequence[DataFrame], on: str) -> DataFrame:
    """Search results joined on their threshold; columns of table i get the suffix _i."""
    named = [t.select(q(on), *[q(c).alias(f"{c}_{i}") for c in t.columns if c != on]) for i, t in enumerate(tables)]
    return reduce(lambda a, b: a.join(b, on), named)


def keyed_union(tables: dict[str, DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(key, F.lit(k)) for k, t in tables.items()])


def keep_last(df: DataFrame, features: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal features the one with the greatest `order`, found by a partial aggregate."""
    rest = [c for c in df.columns if c not in features and c != order]
    g = df.groupBy(*map(q, features)).agg(F.max_by(F.struct(q(order), *map(q, rest)), q(order)).alias("_r"))
    return g.select(*map(q, features), *[F.col("_r").getField(c).alias(c) for c in [order, *rest]]).select(*map(q, df.columns))
