"""Exploring networks and polynomials: boxes decided by sound bounds of the outputs, undecided ones split, with answers PASS, FAIL or UNKNOWN.

A network's outputs are bounded by linear functions of its inputs, substituted backwards through all layers with the linear envelopes of each
unit; a polynomial's by its Bernstein coefficients in the box, which are exact where the extreme is in a corner. Splits make both bounds as close
as is needed. UNKNOWN comes only from the budget: of boxes opened, or of how small a box of configurations may be.

Boxes are rows of a table. In each round all tasks open the boxes that they hold, up to a budget, and what is left is dealt out anew.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..shipping import ship
from ..sources import spec as sp
from ..stored import stored
from .models import Fitted
from .network import Network, forward
from .prep import q

#: Boxes that are bounded at once, boxes that a task opens in a round, rounds, smallest share of a knob's range that is split.
BLOCK, BUDGET, ROUNDS, SMALLEST = 1024, 20_000, 12, 1e-3


def network_bounds(layers, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the outputs of a relu network over boxes (boxes x inputs), each boxes x outputs."""
    units: list[tuple[np.ndarray, np.ndarray]] = []  # bounds before the relu of each hidden layer
    for depth, (w, b) in enumerate(layers):
        ends = []
        for sign in (1.0, -1.0):  # greatest value of sign * output, so the least is minus the second
            a = np.broadcast_to(sign * w, (lo.shape[0], *w.shape)).copy()
            c = np.broadcast_to(sign * b, (lo.shape[0], b.size)).copy()
            for k in range(depth - 1, -1, -1):
                l, u = units[k]
                split = (l < 0) & (u > 0)
                top = np.where(split, u / np.where(split, u - l, 1), l >= 0)
                low = np.where(split, u > -l, l >= 0)
                c += np.einsum("km,kmn->kn", np.where(split, -top * l, 0), np.maximum(a, 0))
                a = np.maximum(a, 0) * top[:, :, None] + np.minimum(a, 0) * low[:, :, None]
                before, shift = layers[k]
                c += np.einsum("m,kmn->kn", shift, a)
                a = np.einsum("im,kmn->kin", before, a)
            up = np.einsum("ki,kin->kn", hi, np.maximum(a, 0)) + np.einsum("ki,kin->kn", lo, np.minimum(a, 0)) + c
            size = np.einsum("ki,kin->kn", np.maximum(np.abs(lo), np.abs(hi)), np.abs(a)) + np.abs(c)
            ends.append(up + 1e-12 * size)
        units.append((-ends[1], ends[0]))
    return units[-1]


def bernstein_bounds(coef: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a polynomial (a tensor of coefficients by power of each variable) over boxes: the least and greatest Bernstein coefficient of each."""
    t = np.broadcast_to(coef, (lo.shape[0], *coef.shape))
    size = np.abs(t)
    far = np.maximum(np.abs(lo), np.abs(hi))
    for j in range(coef.ndim):
        n = coef.shape[j] - 1
        move, bound = np.zeros((2, lo.shape[0], n + 1, n + 1))  # power i of the variable to power k of its place in the box
        for i in range(n + 1):
            for k in range(i + 1):
                move[:, i, k] = math.comb(i, k) * lo[:, j] ** (i - k) * (hi[:, j] - lo[:, j]) ** k
                bound[:, i, k] = math.comb(i, k) * far[:, j] ** i * 2.0**k
        basis = np.array([[math.comb(b, k) / math.comb(n, k) if k <= b else 0.0 for b in range(n + 1)] for k in range(n + 1)])
        t = np.moveaxis(np.einsum("k...i,kib->k...b", np.moveaxis(t, j + 1, -1), move @ basis), -1, j + 1)
        size = np.moveaxis(np.einsum("k...i,kib->k...b", np.moveaxis(size, j + 1, -1), bound @ basis), -1, j + 1)
    axes = tuple(range(1, coef.ndim + 1))
    slack = 1e-13 * size.max(axes)
    return t.min(axes) - slack, t.max(axes) + slack


@dataclass
class Smooth:
    """Models of several responses over the same features: each a network (layers, low ends, spans) or a tensor of coefficients."""

    features: list[str]
    responses: dict[str, object]

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for name, m in self.responses.items():
            if isinstance(m, np.ndarray):
                out[name] = bernstein_bounds(m, lo, hi)
                continue
            layers, low, span = m
            a, b = network_bounds(layers, (lo - low[:-1]) / span[:-1], (hi - low[:-1]) / span[:-1])
            a, b = a[:, 0] * span[-1] + low[-1], b[:, 0] * span[-1] + low[-1]
            out[name] = a - 1e-12 * np.abs(a), b + 1e-12 * np.abs(b)
        return out

    def values(self, x: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for name, m in self.responses.items():
            if isinstance(m, np.ndarray):
                t = np.broadcast_to(m, (x.shape[0], *m.shape))
                for j in range(x.shape[1] - 1, -1, -1):
                    t = np.einsum("k...i,ki->k...", t, x[:, j : j + 1] ** np.arange(m.shape[j]))
                out[name] = t
            else:
                layers, low, span = m
                out[name] = forward(layers, (x - low[:-1]) / span[:-1])[-1][:, 0] * span[-1] + low[-1]
        return out


def polynomial_tensor(terms: Mapping[tuple[int, ...], float]) -> np.ndarray:
    """Coefficients by the powers of the variables as a tensor."""
    out = np.zeros([1 + max(p[j] for p in terms) for j in range(len(next(iter(terms))))])
    for p, c in terms.items():
        out[p] += c
    return out


def smooth_model(model: Fitted, degree: int = 2) -> Smooth:
    """What is explored of fitted networks, polynomials and linear models."""

    def powers(names: list[str], left: int) -> list[dict[str, int]]:
        """In the order of PolynomialExpansion."""
        return [{}] if not names else [d | {names[-1]: p} for p in range(left + 1) for d in powers(names[:-1], left - p)]

    out: dict[str, object] = {}
    for r in model.responses:
        m = model.models[r]
        if isinstance(m, Network):
            out[r] = (m.layers, m.lo, m.span)
            continue
        if model.kind not in ("poly", "linear"):
            raise ValueError(f"{model.kind}: not a network or polynomial")
        stage = m.stages[-1]
        terms = [d for d in powers(list(model.features), degree if model.kind == "poly" else 1) if any(d.values())]
        if model.kind == "linear":
            terms = [{f: int(f == g) for f in model.features} for g in model.features]
        of = {tuple(d.get(f, 0) for f in model.features): float(c) for c, d in zip(stage.coefficients, terms, strict=True)}
        out[r] = polynomial_tensor(of | {(0,) * len(model.features): float(stage.intercept)})
    return Smooth(list(model.features), out)


def in_own_units(model: Smooth, limits: Mapping[str, tuple[float, float]]) -> Smooth:
    """A model that was trained on columns scaled to [0, 1] by `limits`, as one of the columns themselves."""
    start = {f: float(limits[f][0]) if f in limits else 0.0 for f in (*model.features, *model.responses)}
    wide = {f: float(limits[f][1]) - start[f] if f in limits else 1.0 for f in start}
    if any(w == 0 for w in wide.values()):
        raise ValueError("a column with one value has no scale")
    a, w = (np.array([x[f] for f in model.features]) for x in (start, wide))
    out: dict[str, object] = {}
    for r, m in model.responses.items():
        if isinstance(m, np.ndarray):
            t = m
            for j in range(t.ndim):
                n = t.shape[j]
                move = np.array([[math.comb(i, k) * (-a[j]) ** (i - k) / w[j] ** i if k <= i else 0.0 for k in range(n)] for i in range(n)])
                t = np.moveaxis(np.moveaxis(t, j, -1) @ move, -1, j)
            t = t * wide[r]
            t[(0,) * t.ndim] += start[r]
            out[r] = t
        else:
            layers, low, span = m
            out[r] = (layers, np.append(a + low[:-1] * w, low[-1] * wide[r] + start[r]), np.append(span[:-1] * w, span[-1] * wide[r]))
    return Smooth(model.features, out)


def _verdicts(model: Smooth, condition: ex.Node, lo: np.ndarray, hi: np.ndarray) -> list[bool | None]:
    got = model.bounds(lo, hi)
    return [ex.interval(condition, {f: (float(lo[i, j]), float(hi[i, j])) for j, f in enumerate(model.features)} | {r: (float(a[i]), float(b[i])) for r, (a, b) in got.items()}) for i in range(lo.shape[0])]


def _fails(model: Smooth, condition: ex.Node, x: np.ndarray) -> np.ndarray:
    got = model.values(x)
    return np.array([not ex.value(condition, {f: float(x[i, j]) for j, f in enumerate(model.features)} | {r: float(v[i]) for r, v in got.items()}) for i in range(x.shape[0])], bool)


def refute(model: Smooth, condition: ex.Node, todo: list[tuple], budget: int) -> tuple[dict, list[tuple]]:
    """Opens boxes (id, lo, hi), all of one size before the next: ids with a point that fails the condition, and the boxes that are undecided."""
    failed: dict = {}
    while todo and budget > 0:
        now, todo = todo[:BLOCK], todo[BLOCK:]
        now = [t for t in now if t[0] not in failed]
        if not now:
            continue
        budget -= len(now)
        lo, hi = np.array([t[1] for t in now]), np.array([t[2] for t in now])
        mid = (lo + hi) / 2
        bad = _fails(model, condition, mid)
        for (key, a, b), verdict, x, wrong in zip(now, _verdicts(model, condition, lo, hi), mid, bad, strict=True):
            if wrong or verdict is False:
                failed.setdefault(key, x)
            elif verdict is None:
                j = int((b - a).argmax())
                left, right = b.copy(), a.copy()
                left[j] = right[j] = x[j]
                if a[j] < x[j] < b[j]:
                    todo += [(key, a, left), (key, right, b)]
    return failed, [t for t in todo if t[0] not in failed]


def verify_boxes(model: Smooth, boxes: DataFrame, condition: str | ex.Node, budget: int = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """(box, status, counter_example) for rows (box, lo_<feature>, hi_<feature>): whether the condition holds all over each box.

    The counter-example has the features in their order. `box` names a row and does not repeat; ends are finite. A task opens an Arrow batch of boxes
    at a time. A round opens as many boxes as `budget` gives all tasks, or as many as there were at first if these are more.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = boxes.sparkSession
    ship(spark)
    node = ex.parse(condition) if isinstance(condition, str) else condition
    kind = boxes.schema["box"].dataType.simpleString()
    # a box is scaled by nothing: the widest side is halved
    ends = [F.array(*[q(f"{s}_{f}").cast("double") for f in model.features]).alias(s) for s in ("lo", "hi")]
    schema = f"box {kind}, failed boolean, lo array<double>, hi array<double>"

    many = pa.list_(pa.float64())
    type_of = to_arrow_type(boxes.schema["box"].dataType)

    def opened(share: float):
        def run(batches):
            for b in batches:
                t = b.to_pydict()
                todo = [(key, np.array(lo), np.array(hi)) for key, lo, hi in zip(t["box"], t["lo"], t["hi"], strict=True)]
                failed, left = refute(model, node, todo, min(max(budget, len(todo)), math.ceil(len(todo) * share)))
                rows = [(k, True, x, x) for k, x in failed.items()] + [(k, False, a, b) for k, a, b in left]
                key, wrong, lo, hi = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(key, type_of), pa.array(wrong, pa.bool_()), pa.array([x.tolist() for x in lo], many), pa.array([x.tolist() for x in hi], many)], names=["box", "failed", "lo", "hi"])

        return run

    frontier = boxes.select("box", *ends)
    tasks = spark.sparkContext.defaultParallelism
    first = size = frontier.count()
    hits = []
    for _ in range(rounds):
        table = stored(frontier.mapInArrow(opened(max(budget * tasks, first) / max(size, 1)), schema), "frontier")
        hits.append(table.where("failed").select("box", "lo"))
        rest = table.where("NOT failed").join(hits[-1], "box", "left_anti")
        size = rest.count()
        if not size:
            break
        frontier = rest.select("box", "lo", "hi").repartition(tasks)
    hit = reduce(DataFrame.union, hits).groupBy("box").agg(F.min("lo").alias("counter_example"))
    open_ = rest.select("box", F.lit(True).alias("open")).distinct()
    status = F.when(F.col("counter_example").isNotNull(), "FAIL").when(F.col("open"), "UNKNOWN").otherwise("PASS")
    return boxes.select("box").join(hit, "box", "left").join(open_, "box", "left").select("box", status.alias("status"), "counter_example")


def _steps(v: sp.Variable) -> np.ndarray | None:
    """The values of a knob that has only some."""
    if v.grid:
        return np.array(sorted(float(g) for g in v.grid if (v.range is None) or all(a is None or s * g >= s * a for a, s in zip(v.range, (1, -1), strict=True))))
    if v.type == "int" and v.range and None not in v.range:
        return np.arange(math.ceil(v.range[0]), math.floor(v.range[1]) + 1, dtype=float)
    return None


def _range(v: sp.Variable) -> tuple[float, float]:
    if v.grid:
        return float(min(v.grid)), float(max(v.grid))
    if not v.range or None in v.range:
        raise ValueError(f"{v.label}: a smooth model is explored in finite ranges only")
    return float(v.range[0]), float(v.range[1])


@dataclass
class _Theta:
    """Stability boxes of the configurations: radii of the knobs and ranges of the inputs, by feature."""

    knobs: list[sp.Variable]
    features: list[str]
    inputs: dict[str, tuple[float, float]]

    def box(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The union of the stability boxes of a box of configurations, in the order of the features."""
        ends = {}
        for v, a, b in zip(self.knobs, lo, hi, strict=True):
            size = (lambda p, v=v: float(v.rad_abs)) if v.rad_abs is not None else (lambda p, v=v: float(v.rad_rel) * abs(p))
            ends[v.label] = (a - size(a), b + size(b))
        ends |= self.inputs
        return tuple(np.array([ends[f][s] for f in self.features]) for s in (0, 1))

    def around(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The configurations whose stability box holds a point, less a rounding error."""
        lo, hi = [], []
        for v in self.knobs:
            if v.label not in self.features:
                lo.append(-math.inf)
                hi.append(math.inf)
                continue
            p = float(x[self.features.index(v.label)])
            if v.rad_abs is not None:
                a, b = p - float(v.rad_abs), p + float(v.rad_abs)
            else:
                r = float(v.rad_rel)
                a, b = sorted((p / (1 + r), p / (1 - r)))
            slack = 1e-12 * max(1.0, abs(a), abs(b))
            lo.append(a + slack)
            hi.append(b - slack)
        return np.array(lo), np.array(hi)


def find(model: Smooth, theta: _Theta, steps: list, width: np.ndarray, condition: ex.Node, eta: ex.Node | None, todo: list[tuple], budget: int):
    """Opens boxes of configurations, the last first: a stable configuration or None, the boxes left, and the number that got too small."""
    small = 0
    while todo and budget > 0:
        lo, hi = todo.pop()
        lo, hi = lo.copy(), hi.copy()
        for j, s in enumerate(steps):
            if s is not None:
                inside = s[(s >= lo[j]) & (s <= hi[j])]
                lo[j], hi[j] = (inside[0], inside[-1]) if inside.size else (1.0, 0.0)
        if (lo > hi).any():
            continue
        budget -= 1
        center = (lo + hi) / 2
        for j, s in enumerate(steps):
            if s is not None:
                center[j] = s[np.abs(s - center[j]).argmin()]
        if eta is not None:
            named = {v.label: (float(a), float(b)) for v, a, b in zip(theta.knobs, lo, hi, strict=True)}
            ok = ex.interval(eta, named)
            if ok is False:
                continue
            fits = ok or ex.value(eta, {v.label: Fraction(float(c)) for v, c in zip(theta.knobs, center, strict=True)})
        else:
            fits = True
        failed, open_ = refute(model, condition, [(0, *theta.box(center, center))], 2 * BLOCK)
        if fits and not failed and not open_:
            return center, todo, small
        x = failed.get(0)  # refutes the center and all around, whether they are allowed or not
        if x is not None:
            a, b = theta.around(x)
            for j in range(lo.size):
                if lo[j] < a[j]:
                    end = hi.copy()
                    end[j] = np.nextafter(a[j], -math.inf)
                    todo.append((lo.copy(), end))
                    lo[j] = a[j]
                if b[j] < hi[j]:
                    start = lo.copy()
                    start[j] = np.nextafter(b[j], math.inf)
                    todo.append((start, hi.copy()))
                    hi[j] = b[j]
            continue
        j = int(((hi - lo) / width).argmax())
        if (hi[j] - lo[j]) / width[j] < SMALLEST:
            small += 1
            continue
        left, right = hi.copy(), lo.copy()
        left[j] = (lo[j] + hi[j]) / 2
        right[j] = np.nextafter(left[j], math.inf)
        todo += [(right, hi), (lo, left)]
    return None, todo, small


def query(spark: SparkSession, model: Smooth, spec: sp.Spec, condition: str | ex.Node, budget: int = 400, rounds: int = ROUNDS) -> tuple[str, dict | None]:
    """PASS with a configuration in whose whole stability box the condition holds, for all inputs in their ranges; FAIL if there is none; or UNKNOWN.

    A configuration's box that a failing point lies in is refuted; so is every other whose box holds that point, and all of these are cut out at once.
    """
    ship(spark)
    node = ex.parse(condition) if isinstance(condition, str) else condition
    theta = _Theta(list(spec.knobs), model.features, {v.label: _range(v) for v in spec.inputs if v.label in model.features})
    ends = [_range(v) for v in spec.knobs]
    lo, hi = (np.array([e[s] for e in ends]) for s in (0, 1))
    width, steps = np.maximum(hi - lo, 1e-12), [_steps(v) for v in spec.knobs]
    eta = sp.eta(spec) if spec.eta else None
    found, todo, small = find(model, theta, steps, width, node, eta, [(lo, hi)], 60)
    if found is None and todo:
        schema = "kind int, lo array<double>, hi array<double>"

        def run(batches):
            boxes = [(np.array(a), np.array(b)) for x in batches for a, b in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True)]
            got, left, tiny = find(model, theta, steps, width, node, eta, boxes, budget)
            rows = [(0, got, got)] * (got is not None) + [(1, a, b) for a, b in left] + [(2, lo, hi)] * bool(tiny)
            kind, a, b = zip(*rows, strict=True) if rows else ((),) * 3
            many = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array([x.tolist() for x in a], many), pa.array([x.tolist() for x in b], many)], names=["kind", "lo", "hi"])

        frontier = spark.createDataFrame([(1, a.tolist(), b.tolist()) for a, b in todo], schema)
        for _ in range(rounds):
            table = stored(frontier.select("kind", "lo", "hi").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, schema), "configurations")
            first = table.where("kind = 0").orderBy("lo").first()
            small += table.where("kind = 2").count()
            found = np.array(first.lo) if first else None
            frontier = table.where("kind = 1")
            todo = [] if found is not None or frontier.isEmpty() else [None]
            if not todo:
                break
    if found is not None:
        return "PASS", {v.label: (int if v.type == "int" else float)(x) for v, x in zip(spec.knobs, found, strict=True)}
    return ("UNKNOWN" if todo or small else "FAIL"), None


def optimize(spark: SparkSession, model: Smooth, spec: sp.Spec, objective: str, condition: str | ex.Node | None = None, epsilon: float = 0.05, **options) -> dict | None:
    """`lower` and `upper` end of the greatest value that a stable configuration keeps, at most `epsilon` of the objective's range apart unless UNKNOWN answers
    keep them wider, and the configuration of `lower`; and the objective's `range`. None if not even the lower end of the range is kept.
    """
    theta = _Theta(list(spec.knobs), model.features, {v.label: _range(v) for v in spec.inputs if v.label in model.features})
    ends = [_range(v) for v in spec.knobs]
    lo, hi = theta.box(*(np.array([e[s] for e in ends]) for s in (0, 1)))
    got = model.bounds(lo[None], hi[None])
    node = ex.parse(objective)
    lower, upper = ex.interval(node, {f: (float(lo[j]), float(hi[j])) for j, f in enumerate(model.features)} | {r: (float(a[0]), float(b[0])) for r, (a, b) in got.items()})
    goal = lambda t: ex.Logic("and", (ex.Compare(">=", node, ex.Num(Fraction(t))), *([condition if isinstance(condition, ex.Node) else ex.parse(condition)] if condition is not None else [])))
    ends = (lower, upper)
    status, at = query(spark, model, spec, goal(lower), **options)
    if status != "PASS":
        return None
    wide, sure = (upper - lower) * epsilon, upper
    top = upper
    while top - lower > wide:
        t = (lower + top) / 2
        status, new = query(spark, model, spec, goal(t), **options)
        if status == "PASS":
            lower, at = t, new
        else:
            top = t
            sure = t if status == "FAIL" else sure
    return {"lower": lower, "upper": sure, "configuration": at, "range": ends}


def box_column(spec: sp.Spec) -> list[Column]:
    """lo_ and hi_ columns of the stability box of each row's knobs."""
    out = []
    for v in spec.knobs:
        c = q(v.label).cast("double")
        r = F.lit(float(v.rad_abs)) if v.rad_abs is not None else F.lit(float(v.rad_rel)) * F.abs(c)
        out += [(c - r).alias(f"lo_{v.label}"), (c + r).alias(f"hi_{v.label}")]
    return out


def verify(model: Smooth, configurations: DataFrame, spec: sp.Spec, condition: str | ex.Node, name: str = "configuration", **options) -> DataFrame:
    """(box, status, counter_example) of rows (name, <knob>...): whether the condition holds in each configuration's whole stability box, for all inputs."""
    inputs = [F.lit(e).alias(f"{s}_{v.label}") for v in spec.inputs if v.label in model.features for s, e in zip(("lo", "hi"), _range(v), strict=True)]
    return verify_boxes(model, configurations.select(q(name).alias("box"), *box_column(spec), *inputs), condition, **options)


def certify(spark: SparkSession, model: Smooth, spec: sp.Spec, witnesses: Mapping[str, Mapping], condition: str | ex.Node) -> DataFrame:
    """(name, status) of given points (knobs, and inputs if there are any): not a witness / witness, not stable / stable witness, or unknown."""
    theta = _Theta(list(spec.knobs), model.features, {v.label: _range(v) for v in spec.inputs if v.label in model.features})
    rows = []
    for name, at in witnesses.items():
        knobs = np.array([float(Fraction(at[v.label])) for v in spec.knobs])
        given = {f: float(Fraction(at[f])) for f in model.features if f in at}
        rows.append((f"{name}:0", *(e for f in model.features for e in ((given[f],) * 2 if f in given else theta.inputs[f]))))
        rows.append((f"{name}:1", *(float(e) for pair in zip(*theta.box(knobs, knobs), strict=True) for e in pair)))
    boxes = spark.createDataFrame(rows, "box string, " + ", ".join(f"`lo_{f}` double, `hi_{f}` double" for f in model.features))
    got = {r["box"]: r["status"] for r in verify_boxes(model, boxes, condition).collect()}  # two rows for each witness
    out = []
    for name in witnesses:
        here, firm = got[f"{name}:0"], got[f"{name}:1"]
        out.append((name, "not a witness" if here == "FAIL" else "unknown" if "UNKNOWN" in (here, firm) else "stable witness" if firm == "PASS" else "witness, not stable"))
    return spark.createDataFrame(out, "name string, status string")


def as_queries(spark: SparkSession, model: Smooth, spec: sp.Spec, conditions: Mapping[str, str | ex.Node], **options) -> DataFrame:
    """(name, status, witness) of several stable queries."""
    rows = []
    for name, condition in conditions.items():
        status, at = query(spark, model, spec, condition, **options)
        rows.append((name, status, tuple(float(x) for x in at.values()) if at else None))
    return spark.createDataFrame(rows, f"name string, status string, witness struct<{_fields([v.label for v in spec.knobs])}>")


def _fields(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}`: double" for n in names)
