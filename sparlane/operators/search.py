"""Branch and bound over boxes of configurations: stable search for many knobs, without their cross product.

Each knob has a sorted list of values of which one stands for all others (see `stable`). A configuration is a tuple of places in these lists,
and the configurations whose stability box meets a given cell are a box of places. So the value of a configuration (the least value of the
cells that its box meets) is the least value of the boxes that cover it, and the search is over boxes of places:

* it begins with the configurations whose center lies in a cell, with that cell's value as bound;
* the box of the greatest bound, and of those the one with the least corner, comes first;
* if the corner has the bound as its value, it is the answer; else a cell that covers the corner is cut out: what it covers takes
  that cell's value as bound, the rest falls into at most as many boxes as there are knobs.

The open boxes are a table. In each round all tasks open the boxes that they hold, best first and up to a budget; the best answer of
all tasks then prunes what is left, which is dealt out anew.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..shipping import ship
from ..stored import stored

#: Boxes that a task opens in the first round and in later ones, and cells that a worker may hold.
FIRST, BUDGET, CELLS = 200, 4_000, 1_000_000
_OPEN = "found boolean, value double, lo array<int>, hi array<int>"


@dataclass
class Space:
    """Values of the knobs, and of each cell the first and last place of each knob that meets it, and its value."""

    knobs: list[str]
    values: list[np.ndarray]
    first: np.ndarray
    last: np.ndarray
    value: np.ndarray
    eta: ex.Node | None = None
    whole: list[bool] = field(default_factory=list)  # knobs of whole numbers

    def point(self, place: Sequence[int]) -> dict:
        return {k: (int if w else float)(v[i]) for k, v, i, w in zip(self.knobs, self.values, place, self.whole, strict=True)}

    def allowed(self, lo, hi) -> bool | None:
        """Whether the constraint holds for all configurations of a box (True), for none (False), or may do either."""
        if self.eta is None:
            return True
        if (lo == hi).all():
            return bool(ex.value(self.eta, self.point(lo)))
        return ex.interval(self.eta, {k: (float(v[a]), float(v[b])) for k, v, a, b in zip(self.knobs, self.values, lo, hi, strict=True)})


def _better(value: float, corner: tuple, than: tuple[float, tuple] | None) -> bool:
    return than is None or value > than[0] or (value == than[0] and corner < than[1])


def explore(space: Space, boxes: list[tuple[float, np.ndarray, np.ndarray]], worst: tuple[float, tuple] | None, most: int, budget: int):
    """Opens up to `budget` boxes (bound, lo, hi), best first. Gives the `most` best answers (value, place) that beat `worst`, and the boxes left."""
    heap: list = []
    number = 0

    def push(bound, lo, hi, active):
        nonlocal number
        corner = tuple(lo.tolist())
        if bound > -math.inf and _better(bound, corner, worst):
            number += 1
            heapq.heappush(heap, (-bound, corner, number, lo, hi, active))

    for bound, lo, hi in boxes:
        push(bound, lo, hi, None)
    found: list[tuple[float, tuple]] = []
    while heap and budget > 0 and len(found) < most:
        bound, corner, _, lo, hi, active = heapq.heappop(heap)
        bound = -bound
        if not _better(bound, corner, worst):
            break
        budget -= 1
        ok = space.allowed(lo, hi)
        if ok is False:
            continue
        active = np.flatnonzero(space.value < bound) if active is None else active[space.value[active] < bound]
        a, b = space.first[active], space.last[active]
        meets = (a <= hi).all(1) & (b >= lo).all(1)
        active, a, b = active[meets], a[meets], b[meets]
        under = a <= lo
        over_all = under.all(1) & (b >= hi).all(1)
        if over_all.any():
            push(float(space.value[active[over_all]].min()), lo, hi, active)
            continue
        at = np.flatnonzero(under.all(1) & (b >= lo).all(1))
        if not at.size:
            if ok or space.allowed(lo, lo):
                found.append((bound, corner))
                if most > 1:  # go on without this configuration
                    _cut(lambda x, y: push(bound, x, y, active), lo, hi, lo)
            else:
                k = int((hi - lo).argmax())
                mid = (lo[k] + hi[k]) // 2
                left, right = hi.copy(), lo.copy()
                left[k], right[k] = mid, mid + 1
                push(bound, lo, left, active)
                push(bound, right, hi, active)
            continue
        c = at[np.lexsort((space.value[active[at]], -np.log(np.minimum(b[at], hi) - lo + 1.0).sum(1)))[0]]
        inside = _cut(lambda x, y: push(bound, x, y, active), lo, hi, b[c])
        push(float(space.value[active[c]]), lo, inside, active)
    return found, [(-x[0], x[3], x[4]) for x in heap if _better(-x[0], x[1], worst)]


def _cut(push, lo: np.ndarray, hi: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Pushes the parts of a box behind `last`, which do not overlap, and gives the end of the rest."""
    end = hi.copy()
    for k in range(lo.size):
        if last[k] < hi[k]:
            low = lo.copy()
            low[k] = last[k] + 1
            push(low, end.copy())
            end[k] = last[k]
    return end


def _batch(found, rest) -> pa.RecordBatch:
    rows = [(True, v, list(p), list(p)) for v, p in found] + [(False, v, lo.tolist(), hi.tolist()) for v, lo, hi in rest]
    kind, value, lo, hi = zip(*rows, strict=True) if rows else ((),) * 4
    ints = pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.bool_()), pa.array(value, pa.float64()), pa.array(lo, ints), pa.array(hi, ints)], names=["found", "value", "lo", "hi"])


def best(spark: SparkSession, space: Space, starts: list[tuple[float, np.ndarray, np.ndarray]], most: int = 1) -> list[tuple[float, dict]]:
    """The `most` best (value, configuration): the greatest value, then the least knobs in their order. Exact.

    `starts` are boxes with bounds that hold all configurations in question; a bound of minus infinity is none.
    """
    ship(spark)
    found, rest = explore(space, starts, None, most, FIRST)
    if rest and len(found) < most:
        shared = spark.sparkContext.broadcast(space)
        frontier = spark.createDataFrame(pa.Table.from_batches([_batch(found, rest)]))
        width = max(spark.sparkContext.defaultParallelism, 2)
        worst = None

        def run(batches, worst=None):
            boxes, done = [], []
            for b in batches:
                for kind, v, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if kind:
                        done.append((v, tuple(lo)))
                    else:
                        boxes.append((v, np.array(lo, np.int32), np.array(hi, np.int32)))
            new, left = explore(shared.value, boxes, worst, most, BUDGET)
            yield _batch(done + new, left)

        while True:
            limit = worst
            table = stored(frontier.repartition(width).mapInArrow(lambda x, limit=limit: run(x, limit), _OPEN), "frontier")
            top = table.where("found").orderBy(F.desc("value"), "lo").limit(most).collect()
            found = [(r.value, tuple(r.lo)) for r in top]
            worst = found[-1] if len(found) == most else None
            open_ = ~F.col("found")
            if worst:
                corner = F.array(*[F.lit(i) for i in worst[1]])
                open_ = open_ & ((F.col("value") > worst[0]) | ((F.col("value") == worst[0]) & (F.col("lo") < corner)))
            rest = table.where(open_)
            if rest.isEmpty():
                break
            keep = spark.createDataFrame([(True, v, list(p), list(p)) for v, p in found], _OPEN)
            frontier = rest.union(keep)
    found = sorted(found, key=lambda x: (-x[0], x[1]))[:most]
    return [(v, space.point(p)) for v, p in found]


def remains(space: Space, lo: np.ndarray, hi: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Disjoint boxes of the places in a box that no cell covers and that the constraint allows; boxes that meet side to side are made one."""
    out, stack = [], [(lo, hi, None)]
    while stack:
        lo, hi, active = stack.pop()
        ok = space.allowed(lo, hi)
        if ok is False:
            continue
        a, b = (space.first, space.last) if active is None else (space.first[active], space.last[active])
        meets = np.flatnonzero((a <= hi).all(1) & (b >= lo).all(1))
        active = meets if active is None else active[meets]
        if not active.size:
            if ok:
                out.append((lo, hi))
                continue
            k = int((hi - lo).argmax())
            left, right = hi.copy(), lo.copy()
            left[k] = (lo[k] + hi[k]) // 2
            right[k] = left[k] + 1
            stack += [(lo, left, active), (right, hi, active)]
            continue
        a, b = a[meets], b[meets]
        c = int(np.log(np.minimum(b, hi) - np.maximum(a, lo) + 1.0).sum(1).argmax())
        lo, hi = lo.copy(), hi.copy()
        for k in range(lo.size):  # the parts before and behind the cell; the rest is covered
            if a[c, k] > lo[k]:
                end = hi.copy()
                end[k] = a[c, k] - 1
                stack.append((lo.copy(), end, active))
                lo[k] = a[c, k]
            if b[c, k] < hi[k]:
                start = lo.copy()
                start[k] = b[c, k] + 1
                stack.append((start, hi.copy(), active))
                hi[k] = b[c, k]
    return _joined(out)


def _joined(boxes: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Boxes that agree on all knobs but one, and touch there, as one; until none is left."""
    size = -1
    while boxes and size != len(boxes):
        size = len(boxes)
        for k in range(boxes[0][0].size):
            key = lambda x, k=k: (tuple(np.delete(x[0], k)), tuple(np.delete(x[1], k)), int(x[0][k]))
            out: list = []
            for lo, hi in sorted(boxes, key=key):
                if out and key(out[-1])[:2] == key((lo, hi))[:2] and out[-1][1][k] + 1 == lo[k]:
                    out[-1] = (out[-1][0], hi)
                else:
                    out.append((lo, hi))
            boxes = out
    return boxes


def region(spark: SparkSession, space: Space, starts: list[tuple[float, np.ndarray, np.ndarray]]) -> DataFrame:
    """(lo, hi): disjoint boxes of places that hold all configurations of the starting boxes that no cell of the space covers. Each start is cut in a task."""
    ship(spark)
    shared = spark.sparkContext.broadcast(space)
    rows = spark.createDataFrame([(lo.tolist(), hi.tolist()) for v, lo, hi in starts if v > -math.inf], "lo array<int>, hi array<int>")

    def run(batches):
        for b in batches:
            got = [x for lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in remains(shared.value, np.array(lo, np.int32), np.array(hi, np.int32))]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[s].tolist() for x in got], ints) for s in (0, 1)], names=["lo", "hi"])

    return rows.repartition(max(spark.sparkContext.defaultParallelism, 2)).mapInArrow(run, rows.schema)
