"""Joins of points with boxes, skylines, and the stability-aware Pareto frontier."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..shipping import ship
from ..stored import stored
from . import minima
from .prep import q

#: Cells that one box may cover on the axis of the join, about; wider boxes mean wider cells.
CELLS_A_BOX = 8


@dataclass(frozen=True)
class Axis:
    """Half width of the box on a column, absolute or relative to the center, and limits that hold for all boxes. No radius: unbounded."""

    column: str
    rad_abs: float | None = None
    rad_rel: float | None = None
    lo: float | None = None
    hi: float | None = None

    def bounds(self) -> tuple[Column | None, Column | None]:
        c = q(self.column).cast("double")
        r = F.lit(float(self.rad_abs)) if self.rad_abs is not None else F.lit(float(self.rad_rel)) * F.abs(c) if self.rad_rel is not None else None
        lo, hi = (None, None) if r is None else (c - r, c + r)
        if self.lo is not None:
            lo = F.lit(float(self.lo)) if lo is None else F.greatest(lo, F.lit(float(self.lo)))
        if self.hi is not None:
            hi = F.lit(float(self.hi)) if hi is None else F.least(hi, F.lit(float(self.hi)))
        return lo, hi


def with_boxes(df: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """Adds lo_<column> and hi_<column> (null: unbounded)."""
    out = {}
    for a in axes:
        lo, hi = a.bounds()
        out[f"lo_{a.column}"] = F.lit(None).cast("double") if lo is None else lo
        out[f"hi_{a.column}"] = F.lit(None).cast("double") if hi is None else hi
    return df.withColumns(out)


def inside(axes: Sequence[str], point: str = "p", box: str = "b", half_open: Sequence[str] = ()) -> Column:
    """Point within box on all axes; on `half_open` axes the upper edge does not belong to it."""
    parts = []
    for c in axes:
        p, lo, hi = F.col(f"{point}.`{c}`"), F.col(f"{box}.`lo_{c}`"), F.col(f"{box}.`hi_{c}`")
        parts.append((lo.isNull() | (p >= lo)) & (hi.isNull() | ((p < hi) if c in half_open else (p <= hi))))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


#: Points of a cell that one task of the join takes, about.
CELL_ROWS = 200_000
#: So many points or fewer go to all tasks, so that boxes need not move; more boxes than `COPIED` are never copied to all tasks.
FEW_POINTS, COPIED = 10_000, 100_000


def _plan(points: DataFrame, boxes: DataFrame, axes: Sequence[str]) -> tuple[str | None, float, float, float, int, int]:
    """The axis on which boxes are narrowest for the points' spread, a cell width, the points' range on it, and the numbers of both: one row."""
    b = boxes.agg(F.count("*").alias("boxes"), *[F.expr(f"avg(`hi_{c}` - `lo_{c}`)").alias(c) for c in axes], *[F.bool_or(F.col(f"`lo_{c}`").isNull() | F.col(f"`hi_{c}`").isNull()).alias(f"open_{c}") for c in axes])
    p = points.agg(F.count("*").alias("n"), *[e for c in axes for e in (F.min(q(c)).cast("double").alias(f"a_{c}"), F.max(q(c)).cast("double").alias(f"z_{c}"))])
    r = b.crossJoin(p).first()
    best, share = None, 1.0
    for c in axes:
        lo, hi = r[f"a_{c}"], r[f"z_{c}"]
        if r[f"open_{c}"] is not False or lo is None or lo == hi:
            continue
        s = max(r[c] or 0.0, 0.0) / (hi - lo)
        if s < share:
            best, share = c, s
    if best is None:
        return None, 0.0, 0.0, 0.0, r["n"], r["boxes"]
    lo, hi = r[f"a_{best}"], r[f"z_{best}"]
    return best, max(share * (hi - lo) / CELLS_A_BOX * 2, (hi - lo) / 100_000), lo, hi, r["n"], r["boxes"]


def box_join(points: DataFrame, boxes: DataFrame, axes: Sequence[str], how: str = "inner", half_open: Sequence[str] = (), salt: int | None = None) -> DataFrame:
    """Points p joined with boxes b that hold them (`how`: inner, left_semi or left_anti, of the points).

    The axis with the narrowest boxes is cut into cells. A box goes to the cells that it covers, clipped to the points' range,
    a point to its own cell; so the join is an equi-join by cell with the full test on top. With boxes that are open on every
    axis the join has no key and is a nested loop. The points of a cell are dealt to `salt` tasks, to which its boxes are
    copied; by default to as many as give each about `CELL_ROWS` points, by a count of each cell where there are more in all.
    An inner join with few points copies these instead, and deals out no box. Many boxes are not copied to all tasks, however small their table looks.
    Both sides are read twice, once for the ends, so costly ones should be written first.
    """
    axis, width, low, high, n, m = _plan(points, boxes, axes)
    p, b = points.alias("p"), boxes.alias("b")
    test = inside(axes, half_open=half_open)
    if axis is None:
        return p.join(b, test, how)
    cell = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    spots = points.withColumn("_cell", cell(q(axis).cast("double")))
    lo = cell(F.greatest(F.col(f"`lo_{axis}`"), F.lit(low)))
    hi = cell(F.least(F.col(f"`hi_{axis}`"), F.lit(high)))
    keyed = boxes.where(hi >= lo).withColumn("_cell", F.explode(F.sequence(lo, hi)))
    if how == "inner" and salt is None and n <= FEW_POINTS:
        return F.broadcast(spots).alias("p").join(keyed.alias("b"), (F.col("p._cell") == F.col("b._cell")) & test)
    turn = F.xxhash64(F.monotonically_increasing_id())
    if salt is None and n > CELL_ROWS:
        # at most n / CELL_ROWS cells are dense, whatever the data: a small table
        dense = spots.groupBy("_cell").agg(F.count("*").alias("_n")).where(F.col("_n") > CELL_ROWS).select("_cell", F.ceil(F.col("_n") / CELL_ROWS).cast("int").alias("_parts"))
        spots = spots.join(F.broadcast(dense), "_cell", "left").withColumn("_salt", F.coalesce(F.pmod(turn, F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
        keyed = keyed.join(F.broadcast(dense), "_cell", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    else:
        keyed = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit((salt or 1) - 1))))
        spots = spots.withColumn("_salt", F.pmod(turn, F.lit(salt or 1)).cast("int"))
    if m > COPIED:
        keyed = keyed.hint("merge")
    return spots.alias("p").join(keyed.alias("b"), (F.col("p._cell") == F.col("b._cell")) & (F.col("p._salt") == F.col("b._salt")) & test, how)


def ball_check(data: DataFrame, configs: DataFrame, axes: Sequence[Axis], config_id: str, objective: Column, threshold: float, ints: Sequence[str] = ()) -> DataFrame:
    """(config, inside, passed, failed): rows within each configuration's ball and how many reach the threshold.

    On integer axes the ball is half-open, on others closed. A configuration without rows is left out. Rows at one point are
    counted before the join.
    """
    names = [a.column for a in axes]
    boxes = with_boxes(configs, axes).select(q(config_id).alias("_config"), *[q(f"{s}_{c}") for c in names for s in ("lo", "hi")])
    points = data.select(*map(q, names), objective.cast("double").alias("_value"))
    # a configuration's boxes and pairs stay in its task, which has about CELL_ROWS / 4 of them
    boxes = boxes.repartition(max(1, -(-4 * boxes.count() // CELL_ROWS)), "_config")
    points = points.groupBy(*map(q, names)).agg(F.count("*").alias("_inside"), F.count_if(F.col("_value") >= threshold).alias("_passed"), F.count_if(F.col("_value") < threshold).alias("_failed"))
    j = box_join(points, boxes, names, half_open=ints)
    return j.groupBy(F.col("b._config").alias("config")).agg(*[F.sum(f"p._{c}").alias(c) for c in ("inside", "passed", "failed")])


#: Points of a front that are compared at once.
FRONT = 4096


def _undominated(v: np.ndarray) -> np.ndarray:
    """Which rows no other row dominates. Rows go by falling sum, so that a row is dominated by earlier ones only, and in blocks.

    With two objectives a row stays if its second one is greater than all of greater first ones: one pass over the sorted rows.
    """
    keep = np.zeros(len(v), bool)
    if v.shape[1] <= 2:
        first, second = v[:, 0], v[:, -1]
        order = np.lexsort((-second, -first))
        a, b = first[order], second[order]
        top = np.maximum.accumulate(b)
        before = np.concatenate([[-np.inf], top[:-1]])
        start = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
        group = np.cumsum(start) - 1
        keep[order] = (b == b[start][group]) & (b > before[start][group]) if v.shape[1] == 2 else a == a[:1]
        return keep
    order = np.lexsort((*v.T, -v.sum(1)))
    front = np.empty((0, v.shape[1]))
    for lo in range(0, len(order), FRONT):
        at = order[lo : lo + FRONT]
        x = v[at]
        ok = np.ones(len(x), bool)
        for k in range(0, len(front), FRONT):
            f = front[k : k + FRONT]
            for i in range(0, len(x), 256):
                part = x[i : i + 256, None]
                ok[i : i + 256] &= ~((f >= part).all(2) & (f > part).any(2)).any(1)
        x, at = x[ok], at[ok]
        own = np.ones(len(x), bool)
        for i in range(0, len(x), 256):
            part = x[i : i + 256, None]
            own[i : i + 256] = ~((x >= part).all(2) & (x > part).any(2)).any(1)
        keep[at[own]] = True
        front = np.concatenate([front, np.unique(x[own], axis=0)])
    return keep


def _local_skyline(columns: Sequence[str]):
    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= 4 * FRONT:
                held, rows = [_front(pa.concat_tables(held), columns)], 0
        if held:
            yield from _front(pa.concat_tables(held), columns).to_batches()

    return run


def _front(t: pa.Table, columns: Sequence[str]) -> pa.Table:
    return t.filter(pa.array(_undominated(np.stack([t[c].cast(pa.float64()).to_numpy() for c in columns], 1)))) if t.num_rows else t


def skyline(df: DataFrame, objectives: Sequence[str], fan: int = 8) -> DataFrame:
    """Rows that no other row dominates (all objectives at least as great and one greater). Rows with equal objectives stay together.

    Each partition keeps its own skyline; then the distinct objectives that are left meet in a tree, `fan` partitions in one,
    and the rows with the objectives of the last front stay. What one task holds is a front and a few blocks of rows.
    Null objectives must have been dropped.
    """
    ship(df.sparkSession)
    out = df.mapInArrow(_local_skyline(objectives), df.schema)
    values = out.select(*[q(c).cast("double").alias(c) for c in objectives]).distinct()
    schema, parts = values.schema, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        parts = -(-parts // fan)
        values = values.repartition(parts).mapInArrow(_local_skyline(objectives), schema)
    a, b = out.alias("a"), values.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.`{c}`").cast("double") == F.col(f"b.`{c}`") for c in objectives])
    return a.join(b, same, "left_semi")


#: Types whose values doubles hold exactly.
_EXACT = {"double", "float", "int", "smallint", "tinyint"}


def stable_minima(df: DataFrame, row_id: str, axes: Sequence[Axis], objectives: Sequence[str]) -> DataFrame:
    """(row_id, <objective>...): each row's least objective over the rows in its stability box (itself included, if it is in it).

    With one or two axes no pair of row and box is formed (`minima.box_minima`): equal points and equal boxes are made one before. With more axes, or
    objectives that doubles do not hold exactly, and for points with a null or NaN coordinate, which only open boxes hold, it is a box join.
    """
    names = [a.column for a in axes]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    if len(axes) > 2 or not axes or not {kinds[c] for c in (*names, *objectives)} <= _EXACT:
        return _joined_minima(stored(df, "rows"), row_id, axes, objectives)
    own = stored(with_boxes(df.select(q(row_id).alias("_id"), *[q(c).cast("double").alias(c) for c in names], *[q(o).alias(f"_o_{o}") for o in objectives]), axes), "rows")
    ends = [F.coalesce(q(f"{s}_{c}"), F.lit(v)).alias(t) for c, t in zip(names, "xy", strict=False) for s, v, t in (("lo", -math.inf, t), ("hi", math.inf, f"{t}2"))]
    ends += [F.lit(v).alias(t) for t, v in (("y", -math.inf), ("y2", math.inf))] if len(axes) == 1 else []
    keyed = own.select("_id", *ends).withColumn("box", F.xxhash64("x", "x2", "y", "y2"))
    boxes = stored(keyed.select("box", "x", "x2", "y", "y2").dropDuplicates(["box"]), "boxes")
    odd = reduce(lambda a, b: a | b, [q(c).isNull() | F.isnan(q(c)) for c in names])
    at = [q(c).alias(t) for c, t in zip(names, "xy", strict=False)] + ([F.lit(0.0).alias("y")] if len(axes) == 1 else [])
    points = own.where(~odd).select(*at, *[F.col(f"_o_{o}").alias(o) for o in objectives]).groupBy("x", "y").agg(*[F.min(q(o)).cast("double").alias(o) for o in objectives])
    low = minima.box_minima(stored(points, "points"), boxes, objectives)
    out = keyed.select("_id", "box").join(low, "box").select("_id", *[q(o).cast(kinds[o]).alias(o) for o in objectives])
    strange = own.where(odd)
    if not strange.isEmpty():
        j = box_join(strange.select(*map(q, names), *[F.col(f"_o_{o}") for o in objectives]), own.select("_id", *[q(f"{s}_{c}") for c in names for s in ("lo", "hi")]), names)
        out = out.union(j.select(F.col("b._id"), *[F.col(f"p.`_o_{o}`") for o in objectives]))
    return out.groupBy(F.col("_id").alias(row_id)).agg(*[F.min(q(o)).alias(o) for o in objectives])


def _joined_minima(df: DataFrame, row_id: str, axes: Sequence[Axis], objectives: Sequence[str]) -> DataFrame:
    names = [a.column for a in axes]
    boxes = with_boxes(df, axes).select(q(row_id).alias("_id"), *[q(f"{s}_{c}") for c in names for s in ("lo", "hi")])
    points = df.select(*map(q, names), *[q(o).alias(f"_o_{o}") for o in objectives])
    j = box_join(points, boxes, names)
    return j.groupBy(F.col("b._id").alias(row_id)).agg(*[F.min(F.col(f"p.`_o_{o}`")).alias(o) for o in objectives])


def drop_near_violators(df: DataFrame, knobs: Sequence[Axis], beta: Column) -> DataFrame:
    """Rows that lie in no knob box of a row that violates beta."""
    names = [a.column for a in knobs]
    bad = with_boxes(df.where(~beta).select(*map(q, names)).distinct(), knobs).select(*[q(f"{s}_{c}") for c in names for s in ("lo", "hi")])
    return box_join(df, bad, names, "left_anti").select(*[F.col(f"p.`{c}`") for c in df.columns])


def frontier(df: DataFrame, row_id: str, axes: Sequence[Axis], knobs: Sequence[str], objectives: Mapping[str, str], alpha: str | None = None, beta: str | None = None) -> DataFrame:
    """Rows of the stable Pareto frontier with their objectives' stable minima (all are maximised).

    alpha filters rows; objectives are expressions; each is replaced by its minimum over the row's box; rows within the knob box
    of a violator of beta go; the skyline of the minima stays.
    """
    use = df.where(ex.column(alpha)) if alpha else df
    full = stored(use.withColumns({n: ex.column(e) for n, e in objectives.items()}), "rows")  # read several times below
    low = stable_minima(full, row_id, axes, list(objectives)).dropna("any", subset=list(objectives))
    safe = drop_near_violators(full.select(*map(q, use.columns)) if not set(objectives) & set(use.columns) else use, [a for a in axes if a.column in knobs], ex.column(beta)) if beta else use
    both = safe.drop(*objectives).join(low, row_id)
    return skyline(both, list(objectives))


def split_range(lo: float, hi: float, n: int) -> list[tuple[float, float]]:
    step = (hi - lo) / n
    return [(lo + i * step, hi if i == n - 1 else lo + (i + 1) * step) for i in range(n)] if math.isfinite(step) else [(lo, hi)]
