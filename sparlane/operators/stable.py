"""Exact stable search over cell relations: tree models, or anything whose outputs are constant on boxes.

A cell relation has lo_<f> and hi_<f> of each feature, a cell being the half-open box (lo, hi], and a column for each output;
its cells cover the domain and do not overlap. A configuration (a value for each knob) is stable for a condition on the
outputs if the condition holds in all cells that its stability box meets, whatever the inputs are in their ranges.

Moving a knob changes the cells that are met only where an end of the stability box passes an edge of a cell. So between
two such places all configurations meet the same cells, and one of each interval, its upper end, stands for all: a search over
`knob_values` is exact, without a grid or a solver. Their cross product is not formed: `search` bounds and cuts boxes of them. Constraint
texts on top of ranges and grids are checked at these points only: what is found is right, but where nothing is found with such a text the
status is UNKNOWN, not FAIL.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence
from fractions import Fraction
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..sources import spec as sp
from . import search
from .explore import meets, stable_values, theta_boxes
from .models import Fitted, forest_boxes, leaf_boxes
from .prep import q


def features_of(spec: sp.Spec, cells: DataFrame) -> list[str]:
    return [v.label for v in spec.variables if v.interface != "output" and f"lo_{v.label}" in cells.columns]


def model_cells(spark: SparkSession, model: Fitted, most: int = 200_000) -> DataFrame:
    """The cell relation of fitted trees or forests: the non-empty intersections of the responses' boxes, with a column for each response."""
    out = None
    for r in model.responses:
        one = forest_boxes(leaf_boxes(spark, model.models[r], model.features), model.features, most).withColumnRenamed("value", r)
        if out is None:
            out = one
            continue
        a, b = out.alias("a"), one.alias("b")
        lo = {f: F.greatest(F.col(f"a.`lo_{f}`"), F.col(f"b.`lo_{f}`")) for f in model.features}
        hi = {f: F.least(F.col(f"a.`hi_{f}`"), F.col(f"b.`hi_{f}`")) for f in model.features}
        values = [F.col(f"a.`{c}`") for c in out.columns if c in model.responses] + [F.col(f"b.`{r}`")]
        out = a.join(b, reduce(lambda x, y: x & y, [lo[f] < hi[f] for f in model.features])).select(*[c for f in model.features for c in (lo[f].alias(f"lo_{f}"), hi[f].alias(f"hi_{f}"))], *values)
        if out.limit(most + 1).count() > most:
            raise ValueError(f"the responses have more than {most} common cells")
    return out


def _turn(x: float) -> int:
    """The place of a double in the order of all doubles."""
    n = struct.unpack("<q", struct.pack("<d", x))[0]
    return n if n >= 0 else -(n & (1 << 63) - 1)


def _double(n: int) -> float:
    return struct.unpack("<d", struct.pack("<q", n))[0] if n >= 0 else -struct.unpack("<d", struct.pack("<q", -n))[0]


def _last(ok, start: float) -> float:
    """The greatest double that passes a test that holds up to some place, sought from `start` in doubling steps and then by halving."""
    lo = hi = _turn(start)
    step = 1
    while not ok(_double(lo)):
        lo, step = lo - step, step * 2
    step = 1
    while ok(_double(hi)):
        hi, step = hi + step, step * 2
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if ok(_double(mid)) else (lo, mid)
    return _double(lo)


def thresholds(v: sp.Variable, edges: Sequence[float]) -> list[float]:
    """Values up to which the stability box of a knob stays under an edge, or still reaches down to it, in doubles as boxes are computed."""
    rad = float(v.rad_abs if v.rad_abs is not None else v.rad_rel)
    size = (lambda p: rad) if v.rad_abs is not None else (lambda p: rad * abs(p))
    at = (lambda e, s: e - s * rad) if v.rad_abs is not None else (lambda e, s: e / (1 + s * rad) if e >= 0 else e / (1 - s * rad))
    if v.rad_rel is not None and rad >= 1:
        raise ValueError(f"{v.label}: a relative radius is less than 1 here")
    return sorted({_last(lambda p, e=e, s=s: p + s * size(p) <= e, at(e, s)) for e in edges for s in (1, -1)})


def knob_values(spec: sp.Spec, cells: DataFrame) -> list[list[float]]:
    """For each knob the sorted values of which one stands for any other; a knob with a grid has its grid.

    The edges of the cells are collected: as many as the model has, whatever the data.
    """
    cut = [v.label for v in spec.knobs if not v.grid and f"lo_{v.label}" in cells.columns]
    every = F.array_distinct(F.flatten(F.collect_list(F.array(F.lit(0.0)))))
    ends = {k: F.sort_array(F.array_union(F.collect_set(q(f"lo_{k}")), F.collect_set(q(f"hi_{k}")))).alias(k) for k in cut}
    row = cells.agg(every.alias("_"), *ends.values()).first() if cut else {}
    out = []
    for v in spec.knobs:
        lo, hi = v.range or (None, None)
        inside = lambda x, lo=lo, hi=hi: (lo is None or x >= lo) and (hi is None or x <= hi)
        if v.grid:
            values = {float(g) for g in v.grid if inside(g)}
        elif v.label not in cut:
            values = {float(x) for x in (hi, lo, 0) if x is not None} if v.range else {0.0}
        else:
            cuts = thresholds(v, [e for e in row[v.label] or [] if math.isfinite(e)])
            top = float(hi) if hi is not None else (max([*cuts, *([float(lo)] if lo is not None else [])], default=0.0)) + 1.0
            values = {float(c) for c in (math.floor(c) if v.type == "int" else c for c in [*cuts, top]) if inside(c) and c <= top}
            if lo is not None:
                values.add(float(math.ceil(lo) if v.type == "int" else lo))
        out.append(sorted(values))
    return out


def critical_points(spark: SparkSession, spec: sp.Spec, cells: DataFrame) -> DataFrame:
    """All configurations of `knob_values` as a table: their cross product, for few knobs."""
    frames = []
    for v, values in zip(spec.knobs, knob_values(spec, cells), strict=True):
        kind = "bigint" if v.type == "int" else "double"
        frames.append(spark.createDataFrame([(int(x) if v.type == "int" else float(x),) for x in values], f"`{v.label}` {kind}"))
    return reduce(lambda a, b: a.crossJoin(b), frames).where(ex.column(sp.eta(spec)))


def space_of(spark: SparkSession, spec: sp.Spec, cells: DataFrame, value: Column) -> tuple[search.Space, list, list, bool]:
    """The space of a search for the least `value` of the cells that a stability box meets; its boxes to start with; the configurations with
    their center in each cell; and whether these cells leave no configuration out.

    A cell whose value is null does not count. The cells come to the driver and to all workers: they are a model's, `search.CELLS` at most.
    """
    knobs = [v.label for v in spec.knobs]
    points = knob_values(spec, cells)
    n = max(map(len, points))
    table = spark.createDataFrame([tuple(float(p[min(i, len(p) - 1)]) if p else None for p in points) for i in range(n)], ", ".join(f"`{k}` double" for k in knobs))
    table = theta_boxes(table.coalesce(1), spec).select(*[q(f"{s}_{k}") for k in knobs for s in ("lo", "hi")]).toArrow()
    got = cells
    for v in spec.inputs:
        if f"lo_{v.label}" in cells.columns:
            lo, hi = v.range or (None, None)
            got = got.where((q(f"lo_{v.label}") < F.lit(float(hi) if hi is not None else math.inf)) & (q(f"hi_{v.label}") >= F.lit(float(lo) if lo is not None else -math.inf)))
    cut = [k for k in knobs if f"lo_{k}" in cells.columns]
    read = [v.label for v in spec.inputs if f"lo_{v.label}" in cells.columns]
    rows = got.select(*[q(f"{s}_{f}").cast("double") for f in [*cut, *read] for s in ("lo", "hi")], value.cast("double").alias("_value")).limit(search.CELLS + 1).toArrow()
    if rows.num_rows > search.CELLS:
        raise ValueError(f"the model has more than {search.CELLS} cells")
    worth = rows["_value"].to_numpy()
    column = lambda name: rows[name].to_numpy()
    first, last = np.zeros((2, worth.size, len(knobs)), np.int32)
    low, high = np.zeros((2, worth.size, len(knobs)), np.int32)
    for j, k in enumerate(knobs):
        last[:, j] = high[:, j] = len(points[j]) - 1
        if k in cut:
            size = len(points[j])
            lo, hi = table[f"lo_{k}"].to_numpy()[:size], table[f"hi_{k}"].to_numpy()[:size]
            first[:, j] = np.searchsorted(hi, column(f"lo_{k}"), side="right")
            last[:, j] = np.searchsorted(lo, column(f"hi_{k}"), side="right") - 1
            low[:, j] = np.searchsorted(points[j], column(f"lo_{k}"), side="right")
            high[:, j] = np.searchsorted(points[j], column(f"hi_{k}"), side="right") - 1
    centers = np.ones(worth.size, bool)
    for v in spec.inputs:
        if v.label in read:
            at = next((float(x) for x in (v.range or (None, None))[::-1] if x is not None), 0.0)
            centers &= (column(f"lo_{v.label}") < at) & (column(f"hi_{v.label}") >= at)
    whole = (np.zeros(len(knobs), np.int32), np.array([len(p) - 1 for p in points], np.int32))
    here = centers & (low <= high).all(1)
    sizes = [len(p) for p in points]
    covered = sum(math.prod(map(int, x)) for x in high[here] - low[here] + 1) == math.prod(sizes)
    bound = np.where(np.isnan(worth), math.inf, worth)
    starts = [] if 0 in sizes else [(float(bound[i]), low[i], high[i]) for i in np.flatnonzero(here)] if covered else [(math.inf, *whole)]
    inside = [(math.inf, low[i], high[i]) for i in np.flatnonzero((low <= high).all(1))]
    counts = (first <= last).all(1) & ~np.isnan(worth)
    eta = sp.eta(spec) if spec.eta else None
    return search.Space(knobs, [np.array(p) for p in points], first[counts], last[counts], worth[counts], eta, [v.type == "int" for v in spec.knobs]), starts, inside, covered


def _outputs(spec: sp.Spec, cells: DataFrame, condition: str | ex.Node) -> Column:
    node = ex.parse(condition) if isinstance(condition, str) else condition
    known = {c for c in cells.columns if not c.startswith(("lo_", "hi_"))}
    if extra := ex.names(node) - known:
        raise ValueError(f"a condition on cells is on outputs only, not on {sorted(extra)}")
    return ex.column(node)


def stable(candidates: DataFrame, spec: sp.Spec, cells: DataFrame, condition: str | ex.Node) -> DataFrame:
    """The candidates whose stability box meets no cell that fails the condition: an anti join of boxes."""
    features = features_of(spec, cells)
    bad = cells.where(~F.coalesce(_outputs(spec, cells, condition), F.lit(False))).select(*[q(f"{s}_{f}") for f in features for s in ("lo", "hi")])
    t = theta_boxes(candidates, spec)
    return t.alias("t").join(bad.alias("l"), meets(features), "left_anti").select(*[F.col(f"t.`{c}`") for c in candidates.columns])


def _exhaustive(spec: sp.Spec) -> bool:
    return not (spec.alpha or spec.eta)


def _firm(spec: sp.Spec, cells: DataFrame, condition: str | ex.Node | None) -> Column:
    """Minus infinity for cells that fail the condition, null for the others: with these values a stable configuration has an infinite one."""
    return F.lit(None).cast("double") if condition is None else F.when(~F.coalesce(_outputs(spec, cells, condition), F.lit(False)), F.lit(-math.inf))


def query(spark: SparkSession, spec: sp.Spec, cells: DataFrame, conditions: Mapping[str, str | ex.Node]) -> DataFrame:
    """(name, status, witness): PASS with a stable configuration (the least one), FAIL if there is none."""
    rows = []
    for name, condition in conditions.items():
        found = search.best(spark, *space_of(spark, spec, cells, _firm(spec, cells, condition))[:2])
        status = "PASS" if found else "FAIL" if _exhaustive(spec) else "UNKNOWN"
        rows.append((name, status, tuple(float(x) for x in found[0][1].values()) if found else None))
    fields = ", ".join(f"`{v.label}`: double" for v in spec.knobs)
    return spark.createDataFrame(rows, f"name string, status string, witness struct<{fields}>")


def synthesize(spark: SparkSession, spec: sp.Spec, cells: DataFrame) -> DataFrame:
    """(name, status, witness): a configuration that satisfies beta and all assertions, or none."""
    return query(spark, spec, cells, {"synthesis": sp.beta(spec, assertions=True)})


def _center(spark: SparkSession, spec: sp.Spec, at: Mapping[str, float]) -> DataFrame:
    return spark.createDataFrame([tuple(float(Fraction(at[v.label])) for v in spec.knobs)], ", ".join(f"`{v.label}` double" for v in spec.knobs))


def verify(spark: SparkSession, spec: sp.Spec, cells: DataFrame, configurations: Mapping[str, Mapping], assertions: Mapping[str, str]) -> DataFrame:
    """(configuration, assertion, status, counter_example): whether an assertion holds in the whole stability box of a configuration.

    The counter-example is a point of a cell that fails it. With a text in alpha that point may be excluded by it: then UNKNOWN.
    """
    features = features_of(spec, cells)
    rows = None
    for name, at in configurations.items():
        box = theta_boxes(_center(spark, spec, at), spec).alias("t")
        for label, text in assertions.items():
            bad = cells.where(~F.coalesce(_outputs(spec, cells, text), F.lit(False)))
            point = F.struct(*[F.least(F.col(f"t.`hi_{f}`"), F.col(f"l.`hi_{f}`")).alias(f) for f in features])
            one = box.join(bad.alias("l"), meets(features)).agg(F.min(point).alias("counter_example"))
            one = one.select(F.lit(name).alias("configuration"), F.lit(label).alias("assertion"), F.when(F.col("counter_example").isNull(), "PASS").otherwise("UNKNOWN" if spec.alpha else "FAIL").alias("status"), "counter_example")
            rows = one if rows is None else rows.unionByName(one)
    return rows


def certify(spark: SparkSession, spec: sp.Spec, cells: DataFrame, witnesses: Mapping[str, Mapping], condition: str | ex.Node) -> DataFrame:
    """(name, status) of given points (knobs, and inputs if there are any): not a witness / witness, not stable / stable witness."""
    features = features_of(spec, cells)
    good = _outputs(spec, cells, condition)
    rows = None
    for name, at in witnesses.items():
        here = reduce(lambda a, b: a & b, [(q(f"lo_{f}") < F.lit(float(Fraction(at[f])))) & (q(f"hi_{f}") >= F.lit(float(Fraction(at[f])))) for f in features if f in at])
        holds = cells.agg(F.bool_and(F.when(here, F.coalesce(good, F.lit(False)))).alias("holds"))
        firm = stable(_center(spark, spec, at), spec, cells, condition).agg((F.count("*") > 0).alias("firm"))
        one = holds.crossJoin(firm).select(F.lit(name).alias("name"), F.when(~F.coalesce("holds", F.lit(False)), "not a witness").when(F.col("firm"), "stable witness").otherwise("witness, not stable").alias("status"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _stable_best(spark: SparkSession, spec: sp.Spec, cells: DataFrame, objective: str | ex.Node, condition: str | ex.Node | None) -> tuple[float, dict] | None:
    """The greatest stable minimum and the least knobs that have it. A cell without an objective fails."""
    value = F.coalesce(_firm(spec, cells, condition), _outputs(spec, cells, objective).cast("double"), F.lit(-math.inf))
    space, starts, _, covered = space_of(spark, spec, cells, value)
    if covered:
        found = search.best(spark, space, starts)
        return found[0] if found else None
    values = stable_values(critical_points(spark, spec, cells), spec, cells.withColumn("_value", value), "_value").where(F.col("least") > -math.inf)
    row = values.orderBy(F.desc("least"), *[q(v.label) for v in spec.knobs]).first()
    return (row["least"], {v.label: row[v.label] for v in spec.knobs}) if row else None


def optimize(spark: SparkSession, spec: sp.Spec, cells: DataFrame, objective: str, condition: str | ex.Node | None = None) -> DataFrame:
    """The knobs, `least` and `greatest` objective of the stable configuration with the greatest `least` (ties: the least knobs); no row if none is stable.

    A configuration that meets no cell has no value. A model's cells cover the ranges of its knobs; where cells of a table do not, the cross product is searched.
    """
    found = _stable_best(spark, spec, cells, objective, condition)
    kinds = ", ".join(f"`{v.label}` {'bigint' if v.type == 'int' else 'double'}" for v in spec.knobs)
    at = spark.createDataFrame([tuple(found[1].values())] if found else [], kinds)
    return stable_values(at, spec, cells.withColumn("_objective", _outputs(spec, cells, objective).cast("double")), "_objective")


def safe_points(spark: SparkSession, spec: sp.Spec, cells: DataFrame, condition: str | ex.Node, n: int) -> DataFrame:
    """The first n stable configurations in the order of their knobs."""
    found = search.best(spark, *space_of(spark, spec, cells, _firm(spec, cells, condition))[:2], n)
    kinds = ", ".join(f"`{v.label}` {'bigint' if v.type == 'int' else 'double'}" for v in spec.knobs)
    return spark.createDataFrame([tuple(x.values()) for _, x in found], kinds)


def region(spark: SparkSession, spec: sp.Spec, cells: DataFrame, condition: str | ex.Node) -> DataFrame:
    """(lo_<knob>, hi_<knob>): disjoint boxes, each (lo, hi], that together are the set of all stable configurations.

    A knob of whole numbers or with a grid has those of its values that lie in the box. Boxes of one cell of the model's are joined where they meet.
    """
    space, starts, _, _ = space_of(spark, spec, cells, _firm(spec, cells, condition))
    ends = [[math.nextafter(v[0], -math.inf), *v] if v.size else [] for v in space.values]
    tables = [F.array(*[F.lit(float(x)) for x in e]) for e in ends]
    out = search.region(spark, space, starts)
    return out.select(*[c for i, k in enumerate(space.knobs) for c in (F.get(tables[i], F.col("lo")[i]).alias(f"lo_{k}"), F.get(tables[i], F.col("hi")[i] + 1).alias(f"hi_{k}"))])


def bisect(spark: SparkSession, spec: sp.Spec, cells: DataFrame, objective: str, epsilon: float = 0.05, condition: str | ex.Node | None = None) -> DataFrame:
    """(step, threshold, status, lower, upper): halving of the objective's range until the greatest stable threshold is known to `epsilon` of it.

    A step asks whether some configuration keeps the objective at the threshold or above; one search for the greatest answers all of them.
    `optimize` gives the end at once; this gives the course of the search. No feasible configuration: one step with status FAIL.
    """
    value = _outputs(spec, cells, objective).cast("double")
    ends = cells.agg(F.min(value), F.max(value)).first()
    steps: list[tuple] = []
    if ends[0] is not None:
        lower, upper = float(ends[0]), float(ends[1])
        top = _stable_best(spark, spec, cells, objective, condition)
        if top is None:
            steps.append((0, lower, "FAIL", None, None))
        else:
            wide = (upper - lower) * epsilon
            while upper - lower > wide:
                t = (lower + upper) / 2
                ok = top[0] >= t
                lower, upper = (t, upper) if ok else (lower, t)
                steps.append((len(steps), t, "PASS" if ok else "FAIL", lower, upper))
    return spark.createDataFrame(steps, "step int, threshold double, status string, lower double, upper double")


def feasible(spark: SparkSession, spec: sp.Spec, cells: DataFrame) -> dict[str, bool]:
    """Whether the constraints leave any configuration (interface), and any point of the model with them and beta (model)."""
    def some(boxes) -> bool:
        return bool(search.best(spark, search.Space(space.knobs, space.values, space.first[:0], space.last[:0], space.value[:0], space.eta, space.whole), boxes))

    good = cells.where(F.coalesce(_outputs(spec, cells, sp.beta(spec)), F.lit(False)))
    space, _, inside, _ = space_of(spark, spec, good, F.lit(None))
    whole = [] if any(v.size == 0 for v in space.values) else [(math.inf, np.zeros(len(space.knobs), np.int32), np.array([v.size - 1 for v in space.values], np.int32))]
    return {"interface_consistent": some(whole), "model_consistent": some(inside)}
