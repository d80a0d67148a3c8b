"""Preparation of labelled tables: projection, cleaning, encoding, scaling, splits and samples.

All operators are lazy DataFrame-to-DataFrame unless they say that they collect one small row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as ex


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def project(df: DataFrame, responses: Sequence[str], features: Sequence[str] | None = None) -> DataFrame:
    """Features (by default all other columns), then responses."""
    check_responses(df, responses)
    features = features or [c for c in df.columns if c not in responses]
    return df.select(*map(q, features), *map(q, responses))


def check_responses(df: DataFrame, responses: Sequence[str], new: bool = False) -> bool:
    """Whether the responses are there: training data has all, new data all or none."""
    there = [r for r in responses if r in df.columns]
    if len(there) < len(responses) and (there or not new):
        raise ValueError(f"responses not in the data: {sorted(set(responses) - set(there))}")
    return bool(there)


def common_features(training: DataFrame, new: DataFrame) -> list[str]:
    return [c for c in training.columns if c in set(new.columns)]


def drop_null_responses(df: DataFrame, responses: Sequence[str]) -> DataFrame:
    return df.dropna("any", subset=list(responses))


def constant_columns(df: DataFrame, keep: Sequence[str] = ()) -> list[str]:
    """Columns with at most one value besides null. One aggregate row; least and greatest agree, so nothing is shuffled by value."""
    names = [c for c in df.columns if c not in set(keep)]
    row = df.agg(*[F.coalesce(F.min(q(c)) == F.max(q(c)), F.lit(True)).alias(c) for c in names]).first() if names else {}
    return [c for c in names if row[c]]


def drop_constant(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    gone = set(constant_columns(df, keep))
    return df.select(*[q(c) for c in df.columns if c not in gone])


def identical_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Pairs of columns of one type with the same value in every row, nulls too."""
    kinds = dict(df.dtypes)
    pairs = [(a, b) for i, a in enumerate(df.columns) for b in df.columns[i + 1 :] if kinds[a] == kinds[b]]
    row = df.agg(*[F.bool_and(q(a).eqNullSafe(q(b))).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first() if pairs else []
    return [p for p, same in zip(pairs, row, strict=True) if same]


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, d, s): numbers in d, all else as text in s."""
    number = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    cells = [F.struct(F.lit(c).alias("column"), (q(c).cast("double") if c in number else F.lit(None).cast("double")).alias("d"), (F.lit(None).cast("string") if c in number else q(c).cast("string")).alias("s")) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, d, s): each column's most frequent value; of equally frequent ones the least. Values are counted before they meet."""
    n = _long(df, columns).where("d IS NOT NULL OR s IS NOT NULL").groupBy("column", "d", "s").count()
    return n.groupBy("column").agg(F.min(F.struct(-F.col("count"), F.col("d"), F.col("s"))).alias("m")).select("column", "m.d", "m.s")


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls replaced by the column's most frequent value; a column of nulls stays. Collects one value for each column."""
    found = {r["column"]: r for r in modes(df, columns).collect()}
    fill = {c: F.lit(found[c]["d"] if found[c]["d"] is not None else found[c]["s"]).cast(df.schema[c].dataType) for c in columns if c in found}
    return df.withColumns({c: F.coalesce(q(c), v) for c, v in fill.items()})


def missing(df: DataFrame, row_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, row): places of nulls, one row for each."""
    columns = columns or [c for c in df.columns if c != row_id]
    gaps = F.filter(F.array(*[F.when(q(c).isNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return df.select(q(row_id).alias("row"), F.explode(gaps).alias("column")).select("column", "row")


def bools_to_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.when(q(f.name), "True").when(~q(f.name), "False") for f in df.schema if isinstance(f.dataType, T.BooleanType)})


def map_response(df: DataFrame, responses: Sequence[str], text: str) -> DataFrame:
    """Every response x replaced by an expression of x."""
    node = ex.parse(text)
    return df.withColumns({r: ex.column(node, {"x": q(r)}) for r in responses})


def response_to_bool(df: DataFrame, conditions: str, names: Sequence[str]) -> DataFrame:
    """Conditions parted by `;` as 0/1 columns."""
    return df.withColumns({n: ex.column(c).cast("int") for n, c in zip(names, conditions.split(";"), strict=True)})


def relabel(df: DataFrame, column: str, positive, negative) -> DataFrame:
    """Positive to 1, negative to 0, anything else to null; both at once, so 0 and 1 may change places."""
    return df.withColumn(column, F.when(q(column) == F.lit(positive), 1).when(q(column) == F.lit(negative), 0))


def levels(df: DataFrame, column: str, row_id: str, most: int = 10_000) -> DataFrame:
    """(level, code): the column's levels numbered from 0 in the order in which they first stand. At most `most` levels."""
    seen = df.where(q(column).isNotNull()).groupBy(q(column).alias("level")).agg(F.min(q(row_id)).alias("first")).limit(most + 1)
    if seen.count() > most:
        raise ValueError(f"{column} has more than {most} levels")
    return seen.select("level", (F.row_number().over(Window.orderBy("first", "level")) - 1).alias("code"))


def encode(df: DataFrame, column: str, mapping: DataFrame, strict: bool = True) -> DataFrame:
    """Levels replaced by their codes; nulls stay. With `strict`, a level that the mapping lacks is an error when its row is read."""
    m = mapping.select(F.col("level").alias("_level"), F.col("code").alias("_code"))
    out = df.join(F.broadcast(m), q(column) == F.col("_level"), "left")
    code = F.when(q(column).isNotNull() & F.col("_code").isNull(), F.raise_error(F.concat(F.lit(f"{column}: unknown level "), q(column).cast("string")))).otherwise(F.col("_code")) if strict else F.col("_code")
    return out.withColumn(column, code.cast("int")).select(*map(q, df.columns))


def bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Least and greatest value by column; one aggregate row."""
    row = df.agg(*[f(q(c)).alias(f"{i}{k}") for i, c in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (row[f"{i}lo"], row[f"{i}hi"]) for i, c in enumerate(columns)}


def scaled(column: Column, lo, hi) -> Column:
    """To [0, 1]; a constant column becomes 0."""
    return F.lit(0.0) if lo == hi else (column - F.lit(lo)) / F.lit(float(hi) - float(lo))


def scale(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: scaled(q(c), *b) for c, b in limits.items() if None not in b})


def unscale(df: DataFrame, limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: q(c) * F.lit(float(hi) - float(lo)) + F.lit(float(lo)) for c, (lo, hi) in limits.items()})


def indicator(column: str, lo=None, hi=None, level=None) -> Column:
    """1 if the value is in [lo, hi), or is the level; else 0. An open side is unbounded; null gives 0."""
    if level is not None:
        return F.coalesce((q(column) == F.lit(level)).cast("int"), F.lit(0))
    parts = [q(column) >= F.lit(lo)] * (lo is not None) + [q(column) < F.lit(hi)] * (hi is not None)
    return F.coalesce(reduce(lambda a, b: a & b, parts, q(column).isNotNull()).cast("int"), F.lit(0))


def range_name(column: str, lo, hi) -> str:
    part = lambda x: ("minus" if x < 0 else "") + f"{abs(x):g}".replace(".", "_")
    return f"{column}_{part(lo)}_{part(hi)}"


def weights(df: DataFrame, responses: Sequence[str], a: float, b: float, power: float, name: str = "weight") -> DataFrame:
    """Sample weight a + b * (scaled response)^power, averaged over the responses; all weights must be positive."""
    limits = bounds(df, responses)
    each = [F.lit(a) + F.lit(b) * F.power(scaled(q(r), *limits[r]), F.lit(power)) for r in responses]
    w = sum(each[1:], each[0]) / len(each)
    return df.withColumn(name, F.when(w > 0, w).otherwise(F.raise_error(F.lit("a sample weight is not positive"))))


def share(row_id: str, seed: int = 17) -> Column:
    """A number in [0, 1) that depends on the row's id and the seed only."""
    return F.conv(F.substring(F.md5(F.concat(q(row_id).cast("string"), F.lit(f"/{seed}"))), 1, 7), 16, 10).cast("bigint") / F.lit(float(1 << 28))


def split(df: DataFrame, row_id: str, train: float, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, the same in every run; a share of 1 gives all rows to both."""
    if train == 1:
        return df, df
    return df.where(share(row_id, seed) < train), df.where(share(row_id, seed) >= train)


def first_rows(df: DataFrame, row_id: str, n: int) -> DataFrame:
    return df.orderBy(q(row_id)).limit(n)


def sample(df: DataFrame, row_id: str, n: int, seed: int = 17) -> DataFrame:
    """n rows chosen by the hash of their ids; with more than there are, rows are drawn with replacement by evenly spread hashes."""
    rows = df.count()
    if n <= rows:
        return df.orderBy(share(row_id, seed), q(row_id)).limit(n)
    ranked = df.select("*", (F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(q(row_id)), F.lit(64))).orderBy(q(row_id)))).alias("_k"), F.pmod(F.xxhash64(q(row_id)), F.lit(64)).alias("_b"))
    sizes = df.groupBy(F.pmod(F.xxhash64(q(row_id)), F.lit(64)).alias("_b")).count().selectExpr("_b", "sum(count) OVER (ORDER BY _b) - count AS _at")
    numbered = ranked.join(F.broadcast(sizes), "_b").withColumn("_n", F.col("_k") + F.col("_at") - 1)
    draws = df.sparkSession.range(n).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(rows)).alias("_n"))
    return draws.join(numbered, "_n").select(*map(q, df.columns))


def sample_uniform(df: DataFrame, row_id: str, responses: Sequence[str], n: int, seed: int = 17) -> DataFrame:
    """Rows whose responses are spread evenly: for n/k draws from each response's range, the row with the nearest value.

    Draws and rows are sorted together in cells of the range, and each cell also sees the last value before it and the first
    after it, so no draw is compared with all rows.
    """
    out = None
    each = round(n / len(responses))
    for r in responses:
        lo, hi = bounds(df, [r])[r]
        draws = df.sparkSession.range(each).select((F.lit(float(lo)) + (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(r)), F.lit(1 << 30)) / F.lit(float(1 << 30))) * F.lit(float(hi) - float(lo))).alias("v"), F.col("id").alias("draw"))
        near = nearest(draws, "v", df.select(q(r).cast("double").alias("y"), q(row_id).alias("_row")), "y", "_row", float(lo), float(hi))
        part = near.select(F.col("_row").alias("_pick")).join(df, F.col("_pick") == q(row_id)).select(*map(q, df.columns))
        out = part if out is None else out.unionByName(part)
    return out


def nearest(left: DataFrame, key: str, right: DataFrame, value: str, row_id: str, lo: float, hi: float, cells: int = 256) -> DataFrame:
    """Each left row with the id of the right row whose value is nearest; of two at one distance the lower value, then the least id.

    Both sides are cut into `cells` of [lo, hi]; the cells' least and greatest values (a bounded table) are handed to the cells
    beside them. So the rows of one cell are sorted together and none is compared with all.
    """
    width = (hi - lo) / cells or 1.0
    cell = lambda c: F.least(F.greatest(F.floor((q(c) - F.lit(lo)) / F.lit(width)), F.lit(0)), F.lit(cells - 1)).cast("int")
    r = right.where(q(value).isNotNull()).groupBy(q(value).alias("_v")).agg(F.min(q(row_id)).alias("_id")).withColumn("_cell", F.least(F.greatest(F.floor((F.col("_v") - F.lit(lo)) / F.lit(width)), F.lit(0)), F.lit(cells - 1)).cast("int"))
    ends = r.groupBy("_cell").agg(F.min(F.struct("_v", "_id")).alias("a"), F.max(F.struct("_v", "_id")).alias("z"))
    every = right.sparkSession.range(cells).select(F.col("id").cast("int").alias("_cell")).join(F.broadcast(ends), "_cell", "left")
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_cell").rowsBetween(1, Window.unboundedFollowing)
    beside = every.select("_cell", F.last("z", True).over(before).alias("b"), F.first("a", True).over(after).alias("n"))
    columns = left.columns
    one = left.withColumn("_cell", cell(key)).select("_cell", q(key).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.struct(*map(q, columns)).alias("_row"), F.lit(None).cast(r.schema["_id"].dataType).alias("_id"))
    two = r.select("_cell", F.col("_v").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), "_id")
    w = Window.partitionBy("_cell").orderBy("_at", "_kind")
    hit = F.when(F.col("_kind") == 0, F.struct(F.col("_at").alias("_v"), "_id"))
    both = one.unionByName(two)
    both = both.select("*", F.last(hit, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_p"), F.first(hit, True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_q")).where("_kind = 1").join(F.broadcast(beside), "_cell")
    p, n = F.coalesce("_p", "b"), F.coalesce("_q", "n")
    pick = F.when(n.isNull() | (F.col("_at") - p["_v"] <= n["_v"] - F.col("_at")), p["_id"]).otherwise(n["_id"])
    return both.select(*[F.col("_row").getField(c).alias(c) for c in columns], F.coalesce(pick, p["_id"], n["_id"]).alias(row_id))


def restrict(df: DataFrame, equal: Mapping[str, object], drop: bool = False) -> DataFrame:
    """Rows with the given values; on demand without these columns."""
    out = reduce(lambda d, kv: d.where(q(kv[0]) == F.lit(kv[1])), equal.items(), df)
    return out.drop(*equal) if drop else out


def clean_labels(df: DataFrame) -> DataFrame:
    """Column labels without blanks at the ends and with one `_` for each run of other signs."""
    import re

    return df.toDF(*[re.sub(r"\W+", "_", c.strip()).strip("_") or f"c{i}" for i, c in enumerate(df.columns)])


def difference(a: str, b: str) -> Column:
    return q(a) - q(b)


def logistic(x: Column, center: float, slope: float) -> Column:
    """1 / (1 + exp(-2 slope (x - center)))"""
    return 1 / (1 + F.exp(F.lit(-2.0 * slope) * (x - F.lit(center))))
