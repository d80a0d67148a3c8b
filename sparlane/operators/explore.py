"""Exploration of models without a solver: exact answers over finite candidates and box relations, interval refinement else.

Statuses: a candidate p is a stable solution if every point of its stability box (knobs) with all allowed inputs satisfies
the condition. PASS and FAIL are only given when decided; UNKNOWN else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..shipping import ship
from ..sources import spec as sp
from ..stored import stored
from .prep import q


def theta_boxes(candidates: DataFrame, spec: sp.Spec) -> DataFrame:
    """Adds lo_/hi_ of the stability box (knobs) and of the inputs' ranges."""
    out = {}
    for v in spec.knobs:
        c = q(v.label).cast("double")
        r = F.lit(float(v.rad_abs)) if v.rad_abs is not None else F.lit(float(v.rad_rel)) * F.abs(c)
        out[f"lo_{v.label}"], out[f"hi_{v.label}"] = c - r, c + r
    for v in spec.inputs:
        lo, hi = v.range or (None, None)
        out[f"lo_{v.label}"] = F.lit(float(lo) if lo is not None else float("-inf"))
        out[f"hi_{v.label}"] = F.lit(float(hi) if hi is not None else float("inf"))
    return candidates.withColumns(out)


def meets(features: Sequence[str], box: str = "t", leaf: str = "l") -> Column:
    """A closed box meets a half-open leaf (lo, hi] on every feature."""
    return reduce(lambda a, b: a & b, [(F.col(f"{box}.`hi_{f}`") > F.col(f"{leaf}.`lo_{f}`")) & (F.col(f"{box}.`lo_{f}`") <= F.col(f"{leaf}.`hi_{f}`")) for f in features], F.lit(True))


def stable_values(candidates: DataFrame, spec: sp.Spec, leaves: DataFrame, objective: str = "value") -> DataFrame:
    """Candidates with `least` and `greatest`: the extreme values of a box relation over their stability boxes. Exact."""
    features = [v.label for v in spec.variables if v.interface != "output" and f"lo_{v.label}" in leaves.columns]
    names = candidates.columns
    t = theta_boxes(candidates, spec).alias("t")
    j = t.join(leaves.alias("l"), meets(features))
    return j.groupBy(*[F.col(f"t.`{c}`") for c in names]).agg(F.min(F.col(f"l.`{objective}`")).alias("least"), F.max(F.col(f"l.`{objective}`")).alias("greatest"))


def optimize(candidates: DataFrame, spec: sp.Spec, leaves: DataFrame, objective: str = "value", at_least: float | None = None) -> DataFrame:
    """The candidate with the greatest stable minimum (ties: the least knobs), of those that reach `at_least`."""
    s = stable_values(candidates, spec, leaves, objective)
    s = s if at_least is None else s.where(F.col("least") >= at_least)
    return s.orderBy(F.desc("least"), *map(q, candidates.columns)).limit(1)


def objective_range(leaves: DataFrame, objective: str = "value") -> DataFrame:
    """Bounds of the objective over a box relation."""
    return leaves.agg(F.min(q(objective)).alias("lower"), F.max(q(objective)).alias("upper"))


def thresholds(candidates: DataFrame, spec: sp.Spec, leaves: DataFrame, objectives: Sequence[str]) -> list[dict]:
    """Pareto by max-min: the candidate whose stable minima, scaled to [0, 1] and sorted, are the greatest from the least one on (ties: the least knobs).

    So the least objective is raised as far as it goes, then the second least without lowering it, and so on. Gives a step for each level, with
    the objectives that end there, then the solution and its objectives. Exact, by one pass over the candidates' minima.
    """
    features = [v.label for v in spec.variables if v.interface != "output" and f"lo_{v.label}" in leaves.columns]
    names = candidates.columns
    met = theta_boxes(candidates, spec).alias("t").join(leaves.alias("l"), meets(features))
    per = stored(met.groupBy(*[F.col(f"t.`{c}`") for c in names]).agg(*[F.min(F.col(f"l.`{o}`")).alias(o) for o in objectives]), "minima").dropna("any", subset=list(objectives))
    ends = per.agg(*[e for o in objectives for e in (F.min(q(o)).alias(f"a_{o}"), F.max(q(o)).alias(f"z_{o}"))]).first()
    if ends[0] is None:
        return []
    unit = F.array(*[(q(o) - F.lit(ends[f"a_{o}"])) / F.lit((ends[f"z_{o}"] - ends[f"a_{o}"]) or 1.0) for o in objectives])
    row = per.withColumn("_u", unit).orderBy(F.sort_array("_u").desc(), *map(q, names)).first()
    level = dict(zip(objectives, row["_u"], strict=True))
    steps = [{"level": v, "fixed": {o: u for o, u in level.items() if u <= v}} for v in sorted(set(level.values()))]
    return [*steps, {"solution": {c: row[c] for c in names}, "objectives": {o: row[o] for o in objectives}}]


def verify(points: DataFrame, center: Mapping[str, float], spec: sp.Spec, assertion: str) -> DataFrame:
    """(status, counter_example): whether all rows in the stability box of a configuration satisfy the assertion.

    Rows are points of the model or system (grid or sample); FAIL comes with a struct of one failing point.
    """
    names = points.columns
    box = ex.column(sp.theta(spec, {k: _exact(v) for k, v in center.items()}))
    allowed = ex.column(sp.alpha(spec))
    bad = points.where(box & allowed & ~ex.column(assertion)).agg(F.min(F.struct(*map(q, names))).alias("counter_example"))
    return bad.select(F.when(F.col("counter_example").isNull(), "PASS").otherwise("FAIL").alias("status"), "counter_example")


def _exact(v):
    from fractions import Fraction

    return Fraction(v) if not isinstance(v, float) else Fraction(str(v))


def query(candidates: DataFrame, points: DataFrame, spec: sp.Spec, condition: str) -> DataFrame:
    """Candidates that satisfy the condition themselves and whose stability box holds no point that fails it: an anti join of boxes."""
    from .boxes import box_join

    knobs = [v.label for v in spec.knobs]
    good = candidates.where(ex.column(condition))
    fails = points.where(ex.column(sp.alpha(spec)) & ~ex.column(condition)).select(*map(q, knobs)).distinct()
    boxes = theta_boxes(good.withColumn("_id", F.xxhash64(*map(q, good.columns))), spec).select("_id", *[q(f"{s}_{k}") for k in knobs for s in ("lo", "hi")])
    hit = box_join(fails, boxes, knobs).select(F.col("b._id").alias("_id")).distinct()
    return good.withColumn("_id", F.xxhash64(*map(q, good.columns))).join(hit, "_id", "left_anti").drop("_id")


def certify(points: DataFrame, witness: Mapping[str, float], spec: sp.Spec, condition: str) -> str:
    """not a witness / witness, not stable / stable witness."""
    at = {k: _exact(v) for k, v in witness.items()}
    here = reduce(lambda a, b: a & b, [q(k) == F.lit(float(v)) for k, v in at.items() if k in points.columns])
    if not points.where(here & ex.column(condition)).limit(1).count():
        return "not a witness"
    return "stable witness" if verify(points, witness, spec, condition).first()["status"] == "PASS" else "witness, not stable"


def witness_consistent(spec: sp.Spec, witness: Mapping[str, float]) -> bool:
    """Whether the given values satisfy the ranges, grids and global constraints that only they decide."""
    at = {k: _exact(v) for k, v in witness.items()}
    parts = [sp.alpha(spec), sp.eta(spec)]
    return all(ex.value(p, at) for p in parts if ex.names(p) <= set(at))


def decide(condition: ex.Node, box: Mapping[str, ex.Interval], rounds: int = 12, most: int = 20_000) -> tuple[str, dict | None]:
    """Whether a condition holds somewhere in a box: sat with a point, unsat, or unknown. Undecided boxes are halved at their widest side."""
    todo = [dict(box)]
    for _ in range(rounds):
        new = []
        for b in todo:
            v = ex.interval(condition, b)
            if v is False:
                continue
            mid = {k: (lo + hi) / 2 for k, (lo, hi) in b.items()}
            if v is True or ex.value(condition, {k: _exact(x) for k, x in mid.items()}):
                return "sat", mid
            side = max(b, key=lambda k: b[k][1] - b[k][0])
            lo, hi = b[side]
            new += [b | {side: (lo, (lo + hi) / 2)}, b | {side: ((lo + hi) / 2, hi)}]
        if not new:
            return "unsat", None
        if len(new) > most:
            break
        todo = new
    return "unknown", None


def refine_boxes(boxes: DataFrame, features: Sequence[str], condition: ex.Node, rounds: int = 6) -> DataFrame:
    """Boxes with `verdict` (true, false, or null for undecided): interval evaluation on the executors, undecided boxes halved each round."""
    import pandas as pd

    names = [f"{s}_{f}" for f in features for s in ("lo", "hi")]
    schema = boxes.select(*map(q, names)).schema.add("verdict", "boolean")

    def run(batches):
        for pdf in batches:
            out = []
            todo = [tuple(r) for r in pdf[names].itertuples(index=False)]
            for k in range(rounds + 1):
                new = []
                for r in todo:
                    box = {f: (r[2 * i], r[2 * i + 1]) for i, f in enumerate(features)}
                    v = ex.interval(condition, box)
                    if v is not None or k == rounds:
                        out.append((*r, v))
                        continue
                    i = max(range(len(features)), key=lambda j: r[2 * j + 1] - r[2 * j])
                    mid = (r[2 * i] + r[2 * i + 1]) / 2
                    new += [(*r[: 2 * i + 1], mid, *r[2 * i + 2 :]), (*r[: 2 * i], mid, *r[2 * i + 1 :])]
                todo = new
            yield pd.DataFrame(out, columns=[*names, "verdict"])

    ship(boxes.sparkSession)
    return boxes.select(*map(q, names)).mapInPandas(run, schema)


def maximum(objective: ex.Node, box: Mapping[str, ex.Interval], epsilon: float = 1e-3, most: int = 5000) -> tuple[float, float, dict]:
    """Lower and upper bound of the greatest value of an expression in a box, at most epsilon apart if the budget allows, and a point."""
    import heapq

    best, at = float("-inf"), {}
    heap = [(-ex.interval(objective, box)[1], 0, dict(box))]
    n = 0
    while heap and n < most:
        up, _, b = heapq.heappop(heap)
        if -up <= best + epsilon:
            return best, max(best, -up), at
        mid = {k: (lo + hi) / 2 for k, (lo, hi) in b.items()}
        v = float(ex.value(objective, mid))
        if v > best:
            best, at = v, mid
        side = max(b, key=lambda k: b[k][1] - b[k][0])
        lo, hi = b[side]
        for part in ((lo, (lo + hi) / 2), ((lo + hi) / 2, hi)):
            n += 1
            c = b | {side: part}
            heapq.heappush(heap, (-ex.interval(objective, c)[1], n, c))
    return best, max(best, -heap[0][0]) if heap else best, at
