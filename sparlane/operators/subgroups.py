"""Subgroup discovery: selectors, beam search, soft frequencies, quality and ranking tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quality as ql
from .discretize import quantile_edges
from .prep import bounds, q, range_name, scaled


@dataclass(frozen=True)
class Selector:
    """A level of a factor, or a range [lo, hi) of a number; an open side is None."""

    feature: str
    lo: float | None = None
    hi: float | None = None
    level: object = None

    def column(self) -> Column:
        if self.level is not None:
            return F.coalesce(q(self.feature) == F.lit(self.level), F.lit(False))
        out = q(self.feature).isNotNull()
        if self.lo is not None:
            out &= q(self.feature) >= F.lit(self.lo)
        if self.hi is not None:
            out &= q(self.feature) < F.lit(self.hi)
        return F.coalesce(out, F.lit(False))

    def name(self) -> str:
        if self.level is not None:
            return f"{self.feature}=={self.level!r}"
        if self.lo is None or self.hi is None:
            return f"{self.feature}<{self.hi:g}" if self.lo is None else f"{self.feature}>={self.lo:g}"
        return range_name(self.feature, self.lo, self.hi)


def selectors(df: DataFrame, features: Sequence[str], bins: int = 5, most: int = 10_000) -> list[Selector]:
    """Each level of a factor, and each range between equal-frequency cut points of a number.

    A factor with more than `most` levels is an error: its levels are no groups to search among.
    """
    out: list[Selector] = []
    for f in features:
        if isinstance(df.schema[f].dataType, T.NumericType):
            inner = quantile_edges(df, f, bins)[1:-1]
            ends = [None, *inner, None]
            out += [Selector(f, a, b) for a, b in zip(ends, ends[1:], strict=False)]
        else:
            rows = df.where(q(f).isNotNull()).groupBy(q(f).alias("v")).count().orderBy(F.desc("count"), "v").limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"{f} has more than {most} levels")
            out += [Selector(f, level=r["v"]) for r in rows]
    return [s for s in out if s.level is not None or s.lo is not None or s.hi is not None]


def soft_counts(inside: Column, part: Column) -> dict[str, Column]:
    """TP, FN, FP, TN as sums of a response in [0, 1] and its rest, inside and outside the group."""
    one = F.lit(1.0)
    return {"tp": F.sum(F.when(inside, part).otherwise(0.0)), "fn": F.sum(F.when(~inside, part).otherwise(0.0)), "fp": F.sum(F.when(inside, one - part).otherwise(0.0)), "tn": F.sum(F.when(~inside, one - part).otherwise(0.0))}


def frequencies(df: DataFrame, group: Sequence[Selector], response: str) -> DataFrame:
    """One row of soft frequencies of a group for the response, scaled by its range."""
    part = scaled(q(response).cast("double"), *bounds(df, [response])[response])
    inside = F.lit(True)
    for s in group:
        inside = inside & s.column()
    return df.where(q(response).isNotNull()).agg(*[c.alias(n) for n, c in soft_counts(inside, part).items()])


def indicators(freq: DataFrame) -> DataFrame:
    """Adds all quality measures to rows with tp, fp, fn, tn."""
    return freq.withColumns(ql.all_measures(q("tp"), q("fp"), q("fn"), q("tn")))


QUALITIES = ("lift", "wracc", "mean_0", "mean_1")


def _evaluate(df: DataFrame, groups: list[tuple[Selector, ...]], response: str, measure: str, chunk: int = 150) -> list[tuple[float, tuple[Selector, ...]]]:
    """Groups with their quality; those with no row or all rows are left out.

    Groups that differ only in the level of one factor are one aggregate by that factor, however many levels it has; the
    others are conditional sums, `chunk` groups in one aggregate.
    """
    y = q(response).cast("double")
    use = df.where(y.isNotNull())
    whole = use.agg(F.count("*").alias("n"), F.sum(y).alias("s")).first()
    counts: dict[tuple[Selector, ...], tuple] = {}
    families: dict[tuple, dict] = {}
    plain = []
    for g in groups:
        last = g[-1]
        if last.level is not None:
            families.setdefault((g[:-1], last.feature), {})[last.level] = g
        else:
            plain.append(g)
    inside = lambda g: reduce(lambda a, b: a & b, [s.column() for s in g], F.lit(True))
    for (rest, feature), members in list(families.items()):
        if len(members) < 30:  # a few levels are cheaper with the others
            plain += members.values()
            continue
        for r in use.where(inside(rest) & q(feature).isNotNull()).groupBy(q(feature).alias("v")).agg(F.count("*").alias("n"), F.sum(y).alias("s")).collect():
            if r["v"] in members:
                counts[members[r["v"]]] = (r["n"], r["s"])
    for lo in range(0, len(plain), chunk):
        part = plain[lo : lo + chunk]
        row = use.agg(*[e for i, g in enumerate(part) for e in (F.count_if(inside(g)).alias(f"n{i}"), F.sum(F.when(inside(g), y)).alias(f"s{i}"))]).first()
        counts |= {g: (row[f"n{i}"], row[f"s{i}"]) for i, g in enumerate(part)}
    out = []
    for g, (n, s) in counts.items():
        if 0 < n < whole["n"]:
            share, mean, base = n / whole["n"], s / n, whole["s"] / whole["n"]
            value = {"lift": mean / base if base else None, "wracc": share * (mean - base), "mean_0": mean - base, "mean_1": share * (mean - base)}[measure]
            if value is not None:
                out.append((value, g))
    return out


def beam_search(df: DataFrame, features: Sequence[str], response: str, measure: str = "wracc", depth: int = 3, top: int = 15, bins: int = 5, chunk: int = 150) -> list[tuple[float, tuple[Selector, ...]]]:
    """The best groups of up to `depth` selectors on different features, best first; each depth refines the best so far.

    The data is read once for each chunk of candidates; only counts and sums come back.
    """
    every = selectors(df, features, bins)
    best: list[tuple[float, tuple[Selector, ...]]] = []
    seen: set[frozenset[Selector]] = set()
    beam: list[tuple[Selector, ...]] = [()]
    for _ in range(depth):
        new = []
        for g in beam:
            for s in every:
                key = frozenset((*g, s))
                if s.feature not in {x.feature for x in g} and key not in seen:
                    seen.add(key)
                    new.append((*g, s))
        best += _evaluate(df, new, response, measure, chunk)
        best = sorted(best, key=lambda x: (-x[0], len(x[1]), [s.name() for s in x[1]]))[:top]
        beam = [g for _, g in best]
    return best


def ranking_table(df: DataFrame, found: list[tuple[float, tuple[Selector, ...]]], response: str) -> DataFrame:
    """A row for each group: response, quality, up to three features with ranges, the group's frequencies and measures. One aggregate for all groups."""
    part = scaled(q(response).cast("double"), *bounds(df, [response])[response])
    cells = []
    for value, g in found:
        inside = reduce(lambda a, b: a & b, [s.column() for s in g], F.lit(True))
        names = [e for i in range(3) for e in (F.lit(g[i].feature if i < len(g) else None).cast("string").alias(f"feature_{i + 1}"), F.lit(g[i].name() if i < len(g) else None).cast("string").alias(f"range_{i + 1}"))]
        cells.append(F.struct(F.lit(response).alias("response"), F.lit(float(value)).alias("quality"), *names, *[c.alias(n) for n, c in soft_counts(inside, part).items()]))
    one = df.where(q(response).isNotNull()).agg(F.array(*cells).alias("a"))
    return indicators(one.select(F.explode("a").alias("c")).select("c.*"))


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min, max, mean, std): the population's deviation."""
    cells = [F.struct(F.lit(c).alias("column"), F.min(q(c)).cast("double").alias("min"), F.max(q(c)).cast("double").alias("max"), F.avg(q(c)).alias("mean"), F.stddev_pop(q(c)).alias("std")) for c in columns]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("c")).select("c.*")


def sample_lists(df: DataFrame, group: Sequence[Selector], positive: Column, row_id: str) -> DataFrame:
    """(cell, row): the rows of each cell TP, FP, FN, TN. `joined_lists` joins them, for small tables."""
    inside = F.lit(True)
    for s in group:
        inside = inside & s.column()
    cell = F.when(inside & positive, "TP").when(inside, "FP").when(positive, "FN").otherwise("TN")
    return df.select(cell.alias("cell"), q(row_id).alias("row"))


def joined_lists(lists: DataFrame) -> DataFrame:
    return lists.groupBy("cell").agg(F.array_join(F.sort_array(F.collect_list("row")).cast("array<string>"), "~~").alias("rows"))


def discover(df: DataFrame, features: Sequence[str], responses: Sequence[str], **options) -> DataFrame:
    """Ranking tables of all responses, one under the other."""
    out = None
    for r in responses:
        found = beam_search(df, features, r, **options)
        if found:
            one = ranking_table(df, found, r)
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
