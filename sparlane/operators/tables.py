"""Small table operators: limits, casts, category splits, grouped callbacks, summaries, agreement of labels, stored tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ..sources import files
from ..sources import spec as sp
from .association import contingency
from .prep import q
from .ranks import value_ranks, with_rank


def at_least(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Rows that reach every column's lower limit; a null does not."""
    for c, t in limits.items():
        df = df.where(q(c) >= F.lit(t))
    return df


#: Names of kinds that columns are cast to.
KINDS = {"int": "bigint", "float": "double", "numeric": "double", "str": "string", "bool": "boolean"}


def cast_to(df: DataFrame, kinds: Mapping[str, str | Sequence]) -> DataFrame:
    """Columns cast to a kind of `KINDS`, or with a list of levels to their places in it (ordered); what does not read as one becomes null."""
    out = {}
    for c, kind in kinds.items():
        if isinstance(kind, str):
            out[c] = q(c).try_cast(KINDS[kind])
        else:
            places = F.create_map(*[F.lit(x) for i, v in enumerate(kind) for x in (str(v), i)])
            out[c] = F.element_at(places, q(c).cast("string"))
    return df.withColumns(out)


def rounded(df: DataFrame, digits: Mapping[str, int], half_even: bool = False) -> DataFrame:
    """Columns rounded half up, or half to even."""
    return df.withColumns({c: (F.bround if half_even else F.round)(q(c), n) for c, n in digits.items()})


def by_category(df: DataFrame, columns: Sequence[str], most: int = 1000) -> Iterator[tuple[dict, DataFrame]]:
    """(values, rows) for every combination of the columns' values (nulls left out), also those without rows; more than `most` are an error."""
    values = []
    for c in columns:
        rows = df.select(q(c)).where(q(c).isNotNull()).distinct().limit(most + 1).collect()
        values.append(sorted(r[0] for r in rows))
    if any(len(v) > most for v in values) or len(list(itertools.islice(itertools.product(*values), most + 1))) > most:
        raise ValueError(f"more than {most} combinations")
    for combo in itertools.product(*values):
        part = df
        for c, v in zip(columns, combo, strict=True):
            part = part.where(q(c) == F.lit(v))
        yield dict(zip(columns, combo, strict=True)), part


def grouped(df: DataFrame, keys: Sequence[str], f: Callable, schema: T.StructType | str) -> DataFrame:
    """f(key, rows) -> rows for each group of equal keys, as pandas tables. A group is held by one task; nulls are a group."""
    ship(df.sparkSession)
    return df.groupBy(*map(q, keys)).applyInPandas(f, schema)


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float] | None:
    """Linear quantiles from value counts: only the two values around each place reach the driver. No value: None."""
    ranks = value_ranks(df, column)
    n = df.agg(F.count(q(column))).first()[0]
    if not n:
        return None
    spots = sorted({i for s in shares for i in (int((n - 1) * s), min(n - 1, int((n - 1) * s) + 1))})
    around = F.array(*[F.lit(i).cast("long") for i in spots])
    hit = F.filter(around, lambda i: (i >= F.col("below")) & (i < F.col("below") + F.col("n")))
    at = {i: float(r["v"]) for r in ranks.withColumn("hit", hit).where(F.size("hit") > 0).select("v", "hit").collect() for i in r["hit"]}
    out = []
    for s in shares:
        h = (n - 1) * s
        lo = int(h)
        a, b = at[lo], at[min(n - 1, lo + 1)]
        out.append(a + (b - a) * (h - lo))
    return out


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, missing, mean, std, min, q25, q50, q75, max) of numeric columns; the sample's deviation."""
    one = df.agg(*[e for i, c in enumerate(columns) for e in (F.count(q(c)).alias(f"n{i}"), F.count_if(q(c).isNull()).alias(f"m{i}"), F.avg(q(c)).alias(f"a{i}"), F.stddev(q(c)).alias(f"s{i}"), F.min(q(c)).cast("double").alias(f"l{i}"), F.max(q(c)).cast("double").alias(f"h{i}"))]).first()
    rows = []
    for i, c in enumerate(columns):
        mid = quantiles(df, c, [0.25, 0.5, 0.75]) or [None] * 3
        rows.append((c, one[f"n{i}"], one[f"m{i}"], *(None if one[f"{k}{i}"] is None else float(one[f"{k}{i}"]) for k in "asl"), *mid, one[f"h{i}"]))
    return df.sparkSession.createDataFrame(rows, "column string, n long, missing long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")


def z_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, z_min, z_max): how many population deviations the ends lie from the mean; null for a constant column."""
    cells = [F.struct(F.lit(c).alias("column"), F.try_divide(F.min(q(c)) - F.avg(q(c)), F.stddev_pop(q(c))).alias("z_min"), F.try_divide(F.max(q(c)) - F.avg(q(c)), F.stddev_pop(q(c))).alias("z_max")) for c in columns]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("c")).select("c.*")


def auroc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: the area under the curve of a score for a boolean column, by average ranks; null without both classes."""
    y = q(positive)
    r = with_rank(df.where(q(score).isNotNull() & y.isNotNull()), score, "_rank", "average")
    pos, neg = F.count_if(y), F.count_if(~y)
    return r.agg(F.try_divide(F.sum(F.when(y, F.col("_rank"))) - pos * (pos + 1) / 2, pos * neg).alias("auroc"))


def overlap(ranges: DataFrame) -> DataFrame:
    """(lo, hi): what all ranges (lo, hi) have in common; null ends are open, and lo > hi means nothing."""
    return ranges.agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))


def rand_index(df: DataFrame, x: str, y: str) -> DataFrame:
    """rand, adjusted: the share of row pairs on which two labelings agree, and that corrected for chance."""
    t = contingency(df, x, y)
    pairs = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    both = t.agg(F.coalesce(pairs("n"), F.lit(0.0)).alias("ab"), F.sum("n").alias("n"))
    a = t.groupBy("x").agg(F.sum("n").alias("n")).agg(F.coalesce(pairs("n"), F.lit(0.0)).alias("a"))
    b = t.groupBy("y").agg(F.sum("n").alias("n")).agg(F.coalesce(pairs("n"), F.lit(0.0)).alias("b"))
    s = both.crossJoin(a).crossJoin(b).withColumn("all", F.col("n").cast("double") * (F.col("n") - 1) / 2)
    chance = F.try_divide(F.col("a") * F.col("b"), F.col("all"))
    top = (F.col("a") + F.col("b")) / 2 - chance
    return s.select(F.try_divide(F.col("all") + 2 * F.col("ab") - F.col("a") - F.col("b"), F.col("all")).alias("rand"), F.when(top == 0, 1.0).otherwise(F.try_divide(F.col("ab") - chance, top)).alias("adjusted"))


def store(df: DataFrame, spec: sp.Spec, path: str) -> None:
    """A table as Parquet with its specification's variables beside it as JSON."""
    df.write.mode("overwrite").parquet(f"{path}/data.parquet")
    num = lambda x: None if x is None else str(x)
    rows = [{"label": v.label, "interface": v.interface, "type": v.type, "range": [num(x) for x in v.range] if v.range else None, "grid": [num(g) for g in v.grid] if v.grid else None, "rad-abs": num(v.rad_abs), "rad-rel": num(v.rad_rel)} for v in spec.variables]
    files.save_json(f"{path}/spec.json", {"version": "1.2", "variables": [{k: x for k, x in r.items() if x is not None} for r in rows]})


def load_stored(spark: SparkSession, path: str) -> tuple[DataFrame, sp.Spec]:
    """What `store` wrote, the variables' columns in the specification's order and with their roles as metadata; a missing one is an error."""
    spec, df = sp.load(f"{path}/spec.json"), spark.read.parquet(f"{path}/data.parquet")
    if gone := [v.label for v in spec.variables if v.label not in df.columns]:
        raise sp.SpecError(f"the table lacks {gone}")
    rest = [c for c in df.columns if c not in {v.label for v in spec.variables}]
    return df.select(*[q(v.label).alias(v.label, metadata={"interface": v.interface}) for v in spec.variables], *map(q, rest)), spec
