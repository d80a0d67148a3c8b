"""Least values in boxes of one or two axes without a pair of box and point.

Points are cut into slabs of like size along each axis (ordered by both coordinates, so that no value is too frequent for a slab). What a box
holds is split into four strips, the slabs in which its edges lie, and the grid cells of slabs between them. In a strip's task a
merge-sort tree with sparse tables answers each box in a few searches; the cells between are summed up in advance over all ranges of slabs whose
length is a power of two and that start at a multiple of it, so that a box needs a few of those. Whatever the number of points in a box, its cost
is a power of a logarithm.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..stored import stored
from .prep import q

#: Points of a slab, slabs at most (then they grow), sampled points for each slab's edge, boxes that a task answers at a time.
SLAB, SLABS, SAMPLE, CHUNK = 50_000, 10_000, 64, 100_000


def range_minima(x: np.ndarray, y: np.ndarray, values: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each box (x from, to, y from, to; ends included) the least of each row of `values` over the points in it (NaN: none), and whether it holds any.

    Bottom-up over blocks of 1, 2, 4, ... points by x: at each level at most two blocks of a box count, in which the points stand by y and a table
    of least values over runs of 1, 2, 4, ... points answers any run by two of its entries.
    """
    m, k = x.size, boxes.shape[0]
    out, hit = np.full((values.shape[0], k), np.nan), np.zeros(k, bool)
    if not m or not k:
        return out, hit
    order = np.lexsort((y, x))
    x, y, values = x[order], y[order], values[:, order]
    by = np.argsort(y, kind="stable")
    rank = np.empty(m, np.int64)
    rank[by] = np.arange(m)
    low, high = np.searchsorted(y[by], boxes[:, 2], "left"), np.searchsorted(y[by], boxes[:, 3], "right")
    left, right = np.searchsorted(x, boxes[:, 0], "left"), np.searchsorted(x, boxes[:, 1], "right")
    left = np.where(low < high, left, right)
    level = 0
    while (left < right).any():
        key = (np.arange(m) >> level) * m + rank
        place = np.argsort(key)
        key = key[place]
        tables = [values[:, place]]
        for s in range(level):
            prev, step = tables[-1], 1 << s
            if prev.shape[1] <= step:
                break
            tables.append(np.fmin(prev[:, :-step], prev[:, step:]))
        for use, block in (((left < right) & (left & 1 == 1), left), ((left < right) & (right & 1 == 1), right - 1)):
            at = np.flatnonzero(use)
            if not at.size:
                continue
            a, b = np.searchsorted(key, block[at] * m + low[at]), np.searchsorted(key, block[at] * m + high[at])
            some = a < b
            at, a, b = at[some], a[some], b[some]
            hit[at] = True
            size = np.frexp((b - a).astype(float))[1] - 1
            for s in np.unique(size).tolist():
                of = size == s
                least = np.fmin(tables[s][:, a[of]], tables[s][:, b[of] - (1 << s)])
                out[:, at[of]] = np.fmin(out[:, at[of]], least)
        odd = left < right
        left, right = (left + (odd & (left & 1 == 1))) >> 1, (right - (odd & (right & 1 == 1))) >> 1
        level += 1
    return out, hit


def _slab(edges: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many edges (pairs in their order) are at or before each (a, b)."""
    lo, hi = np.searchsorted(edges[:, 0], a, "left"), np.searchsorted(edges[:, 0], a, "right")
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        before = open_ & (edges[np.minimum(mid, len(edges) - 1), 1] <= b)
        lo, hi = np.where(before, mid + 1, lo), np.where(open_ & ~before, mid, hi)
    return lo


def _edges(points: DataFrame, n: int, slabs: int) -> list[np.ndarray]:
    """Pairs (coordinate, other coordinate) at which the slabs of each axis begin, from a bounded sample: they only balance the work."""
    if slabs <= 1:
        return [np.zeros((0, 2))] * 2
    t = points.select("x", "y").sample(min(1.0, SAMPLE * slabs / n), 7).toArrow()
    both = np.stack([t["x"].to_numpy(), t["y"].to_numpy()], 1)
    out = []
    for s in (both, both[:, ::-1]):
        s = s[np.lexsort((s[:, 1], s[:, 0]))]
        out.append(np.unique(s[(np.arange(1, slabs) * len(s)) // slabs], axis=0) if len(s) else np.zeros((0, 2)))
    return out


def _ranges(lo: np.ndarray, hi: np.ndarray):
    """(which, level, block) of the aligned ranges that make up lo..hi-1 of each row."""
    which, level = np.flatnonzero(lo < hi), 0
    lo, hi = lo[which], hi[which]
    while which.size:
        for odd, block in ((lo & 1 == 1, lo), (hi & 1 == 1, hi - 1)):
            use = odd & (lo < hi)
            yield which[use], level, block[use]
            if block is lo:
                lo = lo + use
            else:
                hi = hi - use
        stay = lo < hi
        which, lo, hi, level = which[stay], lo[stay] >> 1, hi[stay] >> 1, level + 1


def _strips(count: int):
    """Answers boxes (kind 1) from the points (kind 0) of their slab: rows come sorted by (axis, slab, salt, kind)."""
    names = [f"o{i}" for i in range(count)]

    def answer(points: list[np.ndarray], rows: pa.Table, axis: int) -> pa.RecordBatch:
        p = np.concatenate(points, 1) if points else np.zeros((2 + count, 0))
        box = np.stack([rows[c].to_numpy() for c in ("x", "x2", "y", "y2")], 1)
        box = box if axis == 0 else box[:, [2, 3, 0, 1]]
        least, hit = range_minima(*(p[:2] if axis == 0 else p[1::-1]), p[2:], box)
        at = np.flatnonzero(hit)
        return pa.RecordBatch.from_arrays([rows["box"].combine_chunks().take(pa.array(at)), *(pa.array(v[at], from_pandas=True) for v in least)], names=["box", *names])

    def run(batches):
        group, points, held, size = None, [], [], 0
        for b in batches:
            key = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if hi == lo:
                    continue
                now = tuple(key[lo].tolist())
                if now != group:
                    if held:
                        yield answer(points, pa.Table.from_batches(held), group[0])
                    group, points, held, size = now, [], [], 0
                part = b.slice(lo, hi - lo)
                many = int(np.searchsorted(part.column(3).to_numpy(), 1))
                if many:
                    points.append(np.stack([part.slice(0, many).column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", *names)]).astype(float))
                if many < part.num_rows:
                    held.append(part.slice(many))
                    size += held[-1].num_rows
                if size >= CHUNK:
                    yield answer(points, pa.Table.from_batches(held), group[0])
                    held, size = [], 0
        if held:
            yield answer(points, pa.Table.from_batches(held), group[0])

    return run


def box_minima(points: DataFrame, boxes: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """(box, <objective>...): the least objectives of the points (x, y, <objective>..., doubles) in each of the boxes (box, x, x2, y, y2) that holds any.

    Ends belong to the box. Points have no null or NaN coordinate, boxes have infinite ends where they are open. A null objective does not
    count. Both are read several times, so they should be written tables. Strips with many boxes are dealt to several tasks, with a copy
    of their slab each.
    """
    spark = points.sparkSession
    ship(spark)
    names = [f"o{i}" for i in range(len(objectives))]
    points = points.select("x", "y", *[q(o).cast("double").alias(n) for o, n in zip(objectives, names, strict=True)])
    n = points.count()
    each = max(SLAB, -(-n // SLABS))
    ex, ey = _edges(points, n, -(-n // each))
    double = ", ".join(f"{c} double" for c in names)

    def placed(batches):
        for b in batches:
            x, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_slab(ex, x, y)), pa.array(_slab(ey, y, x)), *b.columns], names=["i", "j", *b.schema.names])

    def ended(batches):
        for b in batches:
            x, x2, y, y2 = (b.column(i).to_numpy() for i in range(1, 5))
            ends = [np.searchsorted(e[:, 0], v, side) for e, v, side in ((ex, x, "left"), (ex, x2, "right"), (ey, y, "left"), (ey, y2, "right"))]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, ends)], names=[*b.schema.names, "i", "i2", "j", "j2"])

    where = points.mapInArrow(placed, f"i long, j long, x double, y double, {double}")
    asked = boxes.select("box", "x", "x2", "y", "y2").where("x <= x2 AND y <= y2").mapInArrow(ended, "box long, x double, x2 double, y double, y2 double, i long, i2 long, j long, j2 long")
    if len(ex) or len(ey):
        where, asked = stored(where, "points"), stored(asked, "boxes")
    axes = [(0, "i", "i2")] + [(1, "j", "j2")] * bool(len(ex) or len(ey))
    nulls = [F.lit(None).cast("double").alias(c) for c in names]
    queries = [asked.select(F.lit(a).alias("axis"), F.explode(F.array_distinct(F.array(lo, hi))).alias("slab"), "x", "y", "x2", "y2", "box") for a, lo, hi in axes]
    queries = queries[0] if len(axes) == 1 else queries[0].union(queries[1])
    busy = queries.groupBy("axis", "slab").agg(F.ceil(F.count("*") / (4 * each)).cast("int").alias("salts"))  # a row for each slab and axis
    turn = F.pmod(F.xxhash64("box"), F.coalesce("salts", F.lit(1))).cast("int")
    asks = queries.join(F.broadcast(busy), ["axis", "slab"], "left").select("axis", "slab", turn.alias("salt"), F.lit(1).alias("kind"), "x", "y", "x2", "y2", "box", *nulls)
    slabs = [where.select(F.lit(a).alias("axis"), F.col(lo).alias("slab"), "x", "y", *names) for a, lo, _ in axes]
    slabs = slabs[0] if len(axes) == 1 else slabs[0].union(slabs[1])
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("x2", "double"), ("y2", "double"), ("box", "bigint"))]
    have = slabs.join(F.broadcast(busy), ["axis", "slab"]).select("axis", "slab", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "x", "y", *nothing, *names)
    keys = ["axis", "slab", "salt"]
    found = have.union(asks).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(_strips(len(names)), f"box long, {double}")
    if len(axes) == 2:
        least = [F.min(c).alias(c) for c in names]
        cells = stored(where.groupBy("i", "j").agg(*least), "cells")
        up = max(len(ex), len(ey), 1).bit_length()
        level = lambda c: F.explode(F.sequence(F.lit(0), F.lit(up))).alias(c)
        wide = cells.select("*", level("a")).select(F.expr("shiftright(i, a)").alias("bi"), "a", "j", *names).groupBy("a", "bi", "j").agg(*least)
        wide = wide.select("*", level("b")).select("a", "bi", "b", F.expr("shiftright(j, b)").alias("bj"), *names).groupBy("a", "bi", "b", "bj").agg(*least)

        def parts(batches):
            for b in batches:
                i, i2, j, j2 = (b.column(k).to_numpy() for k in range(1, 5))
                box = b.column(0).to_numpy()
                for w, a, bi in _ranges(i + 1, i2):
                    for v, c, bj in _ranges(j[w] + 1, j2[w]):
                        if v.size:
                            yield pa.RecordBatch.from_arrays([pa.array(box[w[v]]), pa.array(np.full(v.size, a, np.int32)), pa.array(bi[v]), pa.array(np.full(v.size, c, np.int32)), pa.array(bj)], names=["box", "a", "bi", "b", "bj"])

        inner = asked.select("box", "i", "i2", "j", "j2").mapInArrow(parts, "box long, a int, bi long, b int, bj long")
        found = found.union(inner.join(wide, ["a", "bi", "b", "bj"]).select("box", *names))
    return found.groupBy("box").agg(*[F.min(c).alias(o) for c, o in zip(names, objectives, strict=True)])
