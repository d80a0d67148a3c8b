"""Ranks of large columns without a window over all rows.

Values are counted first. Running totals are summed inside cells between approximate quantiles; the cells' own totals, a
bounded table, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prep import q

#: Distinct values of a cell, about, and most cells.
CELL_VALUES, CELLS = 500_000, 1000


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """(v, n, below, dense) of each distinct non-null value: rows with it, rows under it, and its dense rank from 1.

    The number of cells follows the number of distinct values, which is counted first.
    """
    counts = df.where(q(column).isNotNull()).groupBy(q(column).alias("v")).agg(F.count("*").alias("n"))
    cells = max(1, min(CELLS, -(-counts.count() // CELL_VALUES)))
    cuts = [] if cells == 1 else counts.agg(F.percentile_approx(F.col("v").cast("double"), [i / cells for i in range(1, cells)], 4 * cells)).first()[0] or []
    edges = sorted(set(cuts))
    cell = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col("v").cast("double"))) if edges else F.lit(0)
    placed = counts.withColumn("cell", cell)
    w = Window.partitionBy("cell").orderBy("v")
    inner = placed.select("cell", "v", "n", (F.sum("n").over(w) - F.col("n")).alias("below"), F.row_number().over(w).alias("dense"))
    sums = placed.groupBy("cell").agg(F.sum("n").alias("s"), F.count("*").alias("d"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("cell", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s"), F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d"))
    return inner.join(F.broadcast(offset), "cell").select("v", "n", (F.col("below") + F.col("s")).alias("below"), (F.col("dense") + F.col("d")).alias("dense"))


def rank_column(method: str) -> Column:
    """Of a `value_ranks` row: average, max, min, dense or ordinal (dense from 0)."""
    n, below, dense = F.col("n"), F.col("below"), F.col("dense")
    return {"average": below + (n + 1) / 2, "max": below + n, "min": below + 1, "dense": dense, "ordinal": dense - 1}[method]


def with_rank(df: DataFrame, column: str, name: str, method: str) -> DataFrame:
    """Adds the rank of each row's value; null for null."""
    r = value_ranks(df, column).select(F.col("v").alias("_v"), rank_column(method).alias(name))
    return df.join(r, q(column) == F.col("_v"), "left").drop("_v")  # a hot value's rows are split by the adaptive join
