"""Feature selection: F statistics, minimum redundancy with maximum relevance, and the ensemble ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prep import q


def regression_f(df: DataFrame, features: Sequence[str], response: str) -> DataFrame:
    """(feature, score): r^2 / (1 - r^2) * (n - 2) of each feature with the response, in one aggregate."""
    one = df.agg(F.count(q(response)).alias("n"), *[F.corr(q(f).cast("double"), q(response).cast("double")).alias(f"r{i}") for i, f in enumerate(features)])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"r{i}").alias("r")) for i, f in enumerate(features)])
    r2 = F.col("r") * F.col("r")
    return one.select("n", F.explode(rows).alias("x")).select("n", "x.*").select("feature", (F.try_divide(r2, 1 - r2) * (F.col("n") - 2)).alias("score"))


def anova_f(df: DataFrame, features: Sequence[str], response: str) -> DataFrame:
    """(feature, score): ANOVA's F of each feature by the classes of the response, from counts, sums and squares by class."""
    long = df.where(q(response).isNotNull()).select(q(response).alias("k"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), q(f).cast("double").alias("v")) for f in features])).alias("x")).select("k", "x.*").where("v IS NOT NULL")
    g = long.groupBy("feature", "k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    n, s, within = F.sum("n"), F.sum("s"), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n
    return g.groupBy("feature").agg(F.try_divide(between / (F.count("*") - 1), within / (n - F.count("*"))).alias("score"))


def leave_one_out(df: DataFrame, feature: str, response: str, name: str) -> DataFrame:
    """A factor as the mean of the response over the other rows of its level; alone in its level, the overall mean."""
    y = q(response).cast("double")
    g = df.groupBy(q(feature).alias("_level")).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    all_ = g.agg((F.sum("_s") / F.sum("_n")).alias("_mean"))
    joined = df.join(g, q(feature).eqNullSafe(F.col("_level")), "left").crossJoin(F.broadcast(all_))
    other = F.when(y.isNull(), F.try_divide(F.col("_s"), F.col("_n"))).otherwise(F.try_divide(F.col("_s") - y, F.col("_n") - 1))
    return joined.withColumn(name, F.coalesce(other, F.col("_mean"))).drop("_level", "_s", "_n", "_mean")


def mrmr(df: DataFrame, features: Sequence[str], response: str, k: int = 0, classification: bool = False) -> list[tuple[str, float]]:
    """The k best features in turn (0: all) with their scores: relevance over the mean absolute correlation with those chosen.

    Two aggregates, one for relevance and one for the correlations; the greedy search runs over the features' numbers.
    """
    rel = {r["feature"]: r["score"] or 0.0 for r in (anova_f if classification else regression_f)(df, features, response).collect()}
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = df.agg(*[F.corr(q(a).cast("double"), q(b).cast("double")) for a, b in pairs]).first() if pairs else []
    red = {frozenset(p): abs(v) if v is not None and v == v else 0.0 for p, v in zip(pairs, row, strict=True)}
    chosen: list[tuple[str, float]] = []
    left = sorted(f for f in features if rel.get(f))
    while left and (not k or len(chosen) < k):
        def score(f):
            mean = sum(max(red[frozenset((f, c))], 1e-3) for c, _ in chosen) / len(chosen) if chosen else 1.0
            return rel[f] / mean

        best = max(left, key=lambda f: (score(f), [-ord(x) for x in f]))
        chosen.append((best, score(best)))
        left.remove(best)
    return chosen


def combine(a: Sequence[str], b: Sequence[str], limit: int = 0) -> list[str]:
    """Both lists without repeats; with a limit, taken from each in turn."""
    both = list(dict.fromkeys([*a, *b])) if not limit else list(dict.fromkeys(x for pair in zip([*a, *[None] * len(b)], [*b, *[None] * len(a)], strict=True) for x in pair if x is not None))
    return both[: limit or None]


def ensemble(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Score columns scaled by their greatest size, and `ranking`, their mean: nulls are 0, an infinite score ten times the greatest finite one."""
    finite = lambda c: F.when(F.abs(q(c)) < F.lit(float("inf")), F.abs(q(c)))
    top = scores.agg(*[F.max(finite(c)).alias(c) for c in columns])
    big = scores.crossJoin(F.broadcast(top.select(*[q(c).alias(f"_{c}") for c in columns])))
    for c in columns:
        v = F.when(q(c).isNull() | F.isnan(q(c)), 0.0).when(F.abs(q(c)) == F.lit(float("inf")), 10 * q(f"_{c}")).otherwise(F.abs(q(c)))
        big = big.withColumn(c, v)
    top = big.agg(*[F.max(q(c)).alias(f"m_{c}") for c in columns])
    out = big.drop(*[f"_{c}" for c in columns]).crossJoin(F.broadcast(top))
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.try_divide(q(c), q(f"m_{c}")), F.lit(0.0)))
    return out.drop(*[f"m_{c}" for c in columns]).withColumn("ranking", sum((q(c) for c in columns[1:]), q(columns[0])) / len(columns)).orderBy(F.desc("ranking"), "feature")


def correlate(df: DataFrame, features: Sequence[str], responses: Sequence[str], estimators: Sequence[str]) -> DataFrame:
    """(feature, ranking): the ensemble rankings of all responses, averaged."""
    from .association import score_table

    out = None
    for r in responses:
        one = ensemble(score_table(df, features, r, estimators), list(estimators)).select(F.lit(r).alias("response"), "feature", "ranking")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("feature").agg(F.avg("ranking").alias("ranking")).orderBy(F.desc("ranking"), "feature")


def model_features(selected: Sequence[str], keep: Sequence[str], order: Sequence[str]) -> list[str]:
    want = {*selected, *keep}
    return [c for c in order if c in want]
