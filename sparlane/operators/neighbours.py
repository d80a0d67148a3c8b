"""Nearest-neighbour regression over a table of any number of training points, by a k-d partition with distance bounds.

Points are dealt to the cells of a k-d tree. A query first visits its own cell: its k nearest points there bound how far the k nearest of
all can be. Then it visits every cell whose bounding box is no farther than that, and the nearest of all cells visited count. Exact, ties included.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..stored import stored
from .prep import q

#: Points of a cell about, deepest level of the tree (then cells grow), sampled points for each cell, queries answered at once, queries of a task about.
CELL, DEPTH, SAMPLE, CHUNK, SHARE = 2_000, 14, 40, 4_000, 50_000


def tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and cut of each inner node of a k-d tree, node i having the children 2i + 1 and 2i + 2; cuts are medians of the sampled points on their widest axis."""
    axis, cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    held = {0: points}
    for i in range(axis.size):
        p = held.pop(i)
        if len(p):
            axis[i] = int((p.max(0) - p.min(0)).argmax())
            cut[i] = float(np.median(p[:, axis[i]]))
        far = p[:, axis[i]] > cut[i]
        held[2 * i + 1], held[2 * i + 2] = p[~far], p[far]
    return axis, cut


def cell_of(axis: np.ndarray, cut: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    while at.size and at[0] < axis.size:
        at = 2 * at + 1 + (x[np.arange(len(x)), axis[at]] > cut[at])
    return at - axis.size


class TableNeighbours:
    """Mean response of the k nearest training points (Euclid); of points at one distance those of the least hashes. A query with a null or NaN feature has none."""

    def __init__(self, spark: SparkSession, features: Sequence[str], out: str, path: str, k: int):
        self.spark, self.features, self.out, self.path, self.k = spark, list(features), out, path, k

    def state(self) -> dict:
        return {"features": self.features, "out": self.out, "path": self.path, "k": self.k}

    def store(self, path: str) -> dict:
        """A copy of the points beside a saved model."""
        self.spark.read.parquet(self.path).write.mode("overwrite").parquet(path)
        return self.state() | {"path": path}

    @classmethod
    def from_state(cls, s: dict) -> TableNeighbours:
        return cls(SparkSession.getActiveSession(), s["features"], s["out"], s["path"], s["k"])

    def __call__(self, df: DataFrame) -> DataFrame:
        ship(self.spark)
        names = [f"f{i}" for i in range(len(self.features))]
        double = ", ".join(f"{n} double" for n in names)
        points = self.spark.read.parquet(self.path)
        n, k = points.count(), self.k
        depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(1, n / CELL))))))
        t = points.sample(min(1.0, SAMPLE * (1 << depth) / n), 5).select(*names).toArrow()
        axis, cut = tree(np.stack([t[c].to_numpy() for c in names], 1), depth)

        def placed(batches):
            for b in batches:
                x = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in names], 1)
                yield pa.RecordBatch.from_arrays([pa.array(cell_of(axis, cut, x)), *b.columns], names=["cell", *b.schema.names])

        there = stored(points.select(*names, "turn", "value").mapInArrow(placed, f"cell long, {double}, turn long, value double"), "points")
        boxes = there.groupBy("cell").agg(*[e for c in names for e in (F.min(c), F.max(c))]).toArrow()  # a row for each cell, 2^DEPTH at most
        cells = boxes["cell"].to_numpy()
        low, high = (np.stack([boxes.column(1 + 2 * i + s).to_numpy() for i in range(len(names))], 1) for s in (0, 1))
        rows = stored(df.withColumn("_query", F.monotonically_increasing_id()), "queries")
        whole = ~F.greatest(*[F.col(c).isNull() | F.isnan(c) for c in names]) if len(names) > 1 else ~(F.col("f0").isNull() | F.isnan("f0"))
        asked = rows.select("_query", *[q(f).cast("double").alias(c) for f, c in zip(self.features, names, strict=True)]).where(whole)

        def visits(batches):
            """The cells of each query: those no farther than its bound; without one the nearest."""
            for b in batches:
                x = np.stack([b.column(i).to_numpy() for i in range(1, 1 + len(names))], 1)
                bound = b.column(1 + len(names)).to_numpy(zero_copy_only=False)
                for lo in range(0, len(x), max(1, 2_000_000 // max(1, cells.size))):
                    part = slice(lo, lo + max(1, 2_000_000 // max(1, cells.size)))
                    d = np.zeros((len(x[part]), cells.size))
                    for i in range(len(names)):
                        gap = np.maximum(np.maximum(low[None, :, i] - x[part, i, None], x[part, i, None] - high[None, :, i]), 0)
                        d += gap * gap
                    own = np.isnan(bound[part])
                    see = np.where(own[:, None], False, d <= bound[part, None] * (1 + 1e-12))
                    see[np.flatnonzero(own), d[own].argmin(1)] = True
                    query, cell = np.nonzero(see)
                    yield pa.RecordBatch.from_arrays([pa.array(cells[cell]), *(b.column(i).slice(lo, len(d)).take(pa.array(query)) for i in range(1 + len(names)))], names=["cell", "_query", *names])

        def answers(batches):
            group, mine, held, size = None, [], [], 0

            def flush():
                p = np.concatenate(mine, 1) if mine else np.zeros((len(names) + 2, 0))
                order = np.lexsort((p[-1], p[-2].view(np.int64)))
                p = p[:, order]
                ask = pa.Table.from_batches(held)
                x = np.stack([ask[c].to_numpy() for c in names], 1)
                who = ask["_query"].to_numpy()
                for lo in range(0, len(x), max(1, 2_000_000 // max(1, p.shape[1]))):
                    part = slice(lo, lo + max(1, 2_000_000 // max(1, p.shape[1])))
                    d = ((x[part, None, :] - p[:-2].T[None]) ** 2).sum(2)
                    near = np.argsort(d, axis=1, kind="stable")[:, :k]
                    at = np.repeat(np.arange(len(d)), near.shape[1])
                    f = near.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(who[part][at]), pa.array(d[at, f]), pa.array(p[-2, f].view(np.int64)), pa.array(p[-1, f])], names=["_query", "d", "turn", "value"])

            for b in batches:
                key = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)], 1)
                edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), b.num_rows]
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if lo == hi:
                        continue
                    now = tuple(key[lo].tolist())
                    if now != group:
                        if held:
                            yield from flush()
                        group, mine, held, size = now, [], [], 0
                    part = b.slice(lo, hi - lo)
                    many = int(np.searchsorted(part.column(2).to_numpy(), 1))
                    if many:
                        own = part.slice(0, many)
                        mine.append(np.stack([*(own.column(c).to_numpy() for c in names), own.column("turn").to_numpy().view(np.float64), own.column("value").to_numpy()]))
                    if many < part.num_rows:
                        held.append(part.slice(many))
                        size += held[-1].num_rows
                    if size >= CHUNK:
                        yield from flush()
                        held, size = [], 0
            if held:
                yield from flush()

        def nearest(bounded: DataFrame) -> DataFrame:
            seen = stored(bounded.mapInArrow(visits, f"cell long, _query long, {double}"), "visits")
            busy = seen.groupBy("cell").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("salts"))  # a row for each cell
            spot = F.pmod(F.xxhash64("_query"), F.col("salts")).cast("int")
            asks = seen.join(F.broadcast(busy), "cell").select("cell", spot.alias("salt"), F.lit(1).alias("kind"), "_query", *names, F.lit(0).cast("long").alias("turn"), F.lit(0.0).alias("value"))
            have = there.join(F.broadcast(busy), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("_query"), *names, "turn", "value")
            both = have.union(asks).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
            return both.mapInArrow(answers, "_query long, d double, turn long, value double")

        none = F.lit(None).cast("double").alias("bound")
        first = nearest(asked.select("_query", *names, none)).groupBy("_query").agg(F.max("d").alias("bound"), F.count("*").alias("got"))
        # fewer than k points in the first cell bound nothing: then all cells are visited
        bound = F.when(F.col("got") >= min(k, n), F.col("bound")).otherwise(float("inf")).alias("bound")
        second = nearest(asked.join(first, "_query").select("_query", *names, bound))
        w = Window.partitionBy("_query").orderBy("d", "turn", "value")
        mean = second.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).groupBy("_query").agg(F.avg("value").alias(self.out))
        return rows.join(mean, "_query", "left").drop("_query")


def table_neighbours(df: DataFrame, features: Sequence[str], response: str, out: str, k: int) -> TableNeighbours:
    """The training points as a table. Of points with equal features only the k that come first can ever count, so a frequent one stays small."""
    turn = F.xxhash64(*map(q, features), q(response)).alias("turn")
    names = [f"f{i}" for i in range(len(features))]
    rows = df.select(*[q(f).cast("double").alias(c) for f, c in zip(features, names, strict=True)], turn, q(response).cast("double").alias("value"))
    for salt in (F.pmod(F.xxhash64("turn", F.monotonically_increasing_id()), F.lit(32)), F.lit(0)):
        w = Window.partitionBy(*names, "_salt").orderBy("turn", "value")
        rows = rows.withColumn("_salt", salt).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n", "_salt")
    table = stored(rows, "neighbours")
    return TableNeighbours(df.sparkSession, features, out, table.inputFiles()[0].rpartition("/")[0], min(k, table.count()))
