"""Specifications of variables: reading, upgrading, checking, splitting, and their constraints as expressions."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as ex


class SpecError(ValueError):
    """The specification is not valid."""


@dataclass(frozen=True)
class Variable:
    label: str
    interface: str  # input, knob or output
    type: str = "real"  # real or int
    range: tuple[Fraction | None, Fraction | None] | None = None
    grid: tuple[Fraction, ...] | None = None
    rad_abs: Fraction | None = None
    rad_rel: Fraction | None = None

    def check(self) -> None:
        if self.interface not in ("input", "knob", "output") or self.type not in ("real", "int"):
            raise SpecError(f"{self.label}: interface {self.interface!r}, type {self.type!r}")
        if self.range and self.interface == "output":
            raise SpecError(f"{self.label}: only inputs and knobs have ranges")
        if (self.grid or self.rad_abs is not None or self.rad_rel is not None) and self.interface != "knob":
            raise SpecError(f"{self.label}: only knobs have grids and radii")
        if self.interface == "knob" and (self.rad_abs is None) == (self.rad_rel is None):
            raise SpecError(f"{self.label}: a knob has just one of rad-abs and rad-rel")
        if self.range and None not in self.range and self.range[0] > self.range[1]:
            raise SpecError(f"{self.label}: empty range")

    def radius(self, center: Fraction | float):
        return self.rad_abs if self.rad_abs is not None else self.rad_rel * abs(center)


@dataclass(frozen=True)
class Spec:
    variables: tuple[Variable, ...]
    alpha: str | None = None
    beta: str | None = None
    eta: str | None = None
    assertions: Mapping[str, str] = field(default_factory=dict)
    queries: Mapping[str, str] = field(default_factory=dict)
    objectives: Mapping[str, str] = field(default_factory=dict)
    witnesses: Mapping[str, Mapping] = field(default_factory=dict)
    configurations: Mapping[str, Mapping] = field(default_factory=dict)
    system: Mapping[str, str] = field(default_factory=dict)

    def of(self, interface: str) -> list[Variable]:
        return [v for v in self.variables if v.interface == interface]

    @property
    def inputs(self):
        return self.of("input")

    @property
    def knobs(self):
        return self.of("knob")

    @property
    def outputs(self):
        return self.of("output")

    def check(self) -> Spec:
        labels = [v.label for v in self.variables]
        if len(set(labels)) < len(labels):
            raise SpecError("a label stands twice")
        for v in self.variables:
            v.check()
        for kind in ("assertions", "queries", "objectives"):
            for name, e in getattr(self, kind).items():
                if extra := ex.names(ex.parse(e)) - set(labels):
                    raise SpecError(f"{kind} {name}: unknown {sorted(extra)}")
        return self

    def constrained(self) -> set[str]:
        """Variables in any constraint or with a range, grid or radius: preprocessing keeps them."""
        texts = [self.alpha, self.beta, self.eta, *self.assertions.values(), *self.queries.values(), *self.objectives.values()]
        return set().union({v.label for v in self.variables if v.range or v.grid or v.interface == "knob"}, *(ex.names(ex.parse(t)) for t in texts if t))

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each variable."""
        num = lambda x: None if x is None else float(x)
        rows = [(v.label, v.interface, v.type, num(v.range[0]) if v.range else None, num(v.range[1]) if v.range else None, [float(g) for g in v.grid] if v.grid else None, num(v.rad_abs), num(v.rad_rel)) for v in self.variables]
        return spark.createDataFrame(rows, "label string, interface string, type string, lo double, hi double, grid array<double>, rad_abs double, rad_rel double")

    def schema(self) -> T.StructType:
        """Fields with their role in the metadata."""
        kinds = {"real": T.DoubleType(), "int": T.LongType()}
        return T.StructType([T.StructField(v.label, kinds[v.type], True, {"interface": v.interface}) for v in self.variables])


#: Keys of version 1.1 and what version 1.2 calls them; fixed values of the file format.
_RENAMED = {"spec": "variables", "bounds": "range", "safe": "grid", "const": "grid"}
_ROLES = {"input": "input", "knob": "knob", "output": "output", "response": "output", "control": "knob"}
_TYPES = {"float": "real", "real": "real", "int": "int"}
_KEYS = {"version", "variables", "alpha", "beta", "eta", "assertions", "queries", "objectives", "witnesses", "configurations", "system"}


def upgrade(raw: dict) -> dict:
    """A version 1.1 dictionary (or a 1.2 one with old names) as version 1.2; the input is not changed."""
    out = {_RENAMED.get(k, k): v for k, v in raw.items()}
    out["variables"] = [{_RENAMED.get(k, k): v for k, v in var.items()} for var in out.get("variables", [])]
    for var in out["variables"]:
        if "type" in var:
            var["type"] = _TYPES.get(var["type"], var["type"])
        if "interface" in var:
            var["interface"] = _ROLES.get(var["interface"], var["interface"])
    out["version"] = "1.2"
    return out


def _fraction(x) -> Fraction | None:
    return None if x is None else Fraction(x)


def from_dict(raw: dict) -> Spec:
    raw = upgrade(raw)
    if unknown := set(raw) - _KEYS:
        raise SpecError(f"unknown keys: {sorted(unknown)}")
    variables = []
    for v in raw["variables"]:
        v = dict(v)
        label, interface, kind = v.pop("label"), v.pop("interface"), v.pop("type", "real")
        rng, grid, ra, rr = v.pop("range", None), v.pop("grid", None), v.pop("rad-abs", None), v.pop("rad-rel", None)
        if v:
            raise SpecError(f"{label}: unknown keys {sorted(v)}")
        grid = [grid] if grid is not None and not isinstance(grid, list) else grid
        variables.append(Variable(label, interface, kind, tuple(map(_fraction, rng)) if rng else None, tuple(map(Fraction, grid)) if grid else None, _fraction(ra), _fraction(rr)))
    rest = {k: raw.get(k) for k in ("alpha", "beta", "eta")} | {k: raw.get(k) or {} for k in ("assertions", "queries", "objectives", "witnesses", "configurations", "system")}
    return Spec(tuple(variables), **rest).check()


def load(path: str) -> Spec:
    """A JSON file on the driver; its decimals are read exactly."""
    with open(path) as f:
        return from_dict(json.load(f, parse_float=Fraction))


def split(spec: Spec, splits: Mapping[str, int]) -> list[Spec]:
    """Specs with parts of the knobs' grids: part i of n has every n-th value from the i-th on; all combinations."""
    parts = []
    for label, n in splits.items():
        v = next(x for x in spec.variables if x.label == label)
        if not v.grid:
            raise SpecError(f"{label} has no grid")
        parts.append([(label, v.grid[i::n]) for i in range(n) if v.grid[i::n]])
    out = []
    for combo in itertools.product(*parts):
        new = dict(combo)
        out.append(replace(spec, variables=tuple(replace(v, grid=new[v.label]) if v.label in new else v for v in spec.variables)))
    return out


def split_grid(grid: DataFrame, column: str, n: int) -> DataFrame:
    """(part, value) of an array column: the same striding as `split`, on a DataFrame."""
    return grid.select(F.posexplode(column).alias("pos", "value")).select(F.pmod("pos", F.lit(n)).alias("part"), "pos", "value")


def _and(parts: Iterable[ex.Node]) -> ex.Node:
    parts = tuple(parts)
    return ex.fold(ex.Logic("and", parts)) if parts else ex.Bool(True)


def _ranges(variables: Iterable[Variable]) -> list[ex.Node]:
    out = []
    for v in variables:
        lo, hi = v.range or (None, None)
        if lo is not None:
            out.append(ex.Compare(">=", ex.Var(v.label), ex.Num(lo)))
        if hi is not None:
            out.append(ex.Compare("<=", ex.Var(v.label), ex.Num(hi)))
    return out


def alpha(spec: Spec) -> ex.Node:
    """What holds of inputs and knobs: input ranges and the global text."""
    return _and([*_ranges(spec.inputs), *([ex.parse(spec.alpha)] if spec.alpha else [])])


def beta(spec: Spec, assertions: bool = False) -> ex.Node:
    """What a solution must satisfy; on demand with the assertions."""
    return _and([*([ex.parse(spec.beta)] if spec.beta else []), *(ex.parse(e) for e in spec.assertions.values() if assertions)])


def eta(spec: Spec, grids: bool = True) -> ex.Node:
    """What candidates must satisfy: knob ranges, grids and the global text."""
    grid = [ex.Logic("or", tuple(ex.Compare("==", ex.Var(v.label), ex.Num(g)) for g in v.grid)) for v in spec.knobs if v.grid and grids]
    return _and([*_ranges(spec.knobs), *grid, *([ex.parse(spec.eta)] if spec.eta else [])])


def theta(spec: Spec, center: Mapping[str, Fraction], delta_abs: Fraction = Fraction(0), delta_rel: Fraction = Fraction(0)) -> ex.Node:
    """The stability box around a configuration; with a delta (in lemmas) radii grow, and relative ones follow the variable."""
    parts = []
    for v in spec.knobs:
        c, x = ex.Num(Fraction(center[v.label])), ex.Var(v.label)
        away = ex.absolute(ex.Arith("-", x, c))
        if v.rad_abs is not None:
            r: ex.Node = ex.Num(v.rad_abs * (1 + delta_rel) + delta_abs)
        elif delta_abs or delta_rel:
            r = ex.Arith("+", ex.Arith("*", ex.Num(v.rad_rel * (1 + delta_rel)), ex.absolute(x)), ex.Num(delta_abs))
        else:
            r = ex.Num(v.rad_rel * abs(Fraction(center[v.label])))
        parts.append(ex.Compare("<=", away, r))
    return _and(parts)


def grid_points(spark: SparkSession, spec: Spec) -> DataFrame:
    """All combinations of the knobs' grid values that satisfy eta; the grids are literals of the spec."""
    frames = []
    for v in spec.knobs:
        if not v.grid:
            raise SpecError(f"{v.label} has no grid")
        kind = "bigint" if v.type == "int" else "double"
        lits = F.array(*[F.lit(int(g) if v.type == "int" else float(g)).cast(kind) for g in v.grid])
        frames.append(spark.range(1).select(F.explode(lits).alias(v.label)))
    return reduce(lambda a, b: a.crossJoin(b), frames).where(ex.column(eta(spec, grids=False)))


def evaluate_system(df: DataFrame, spec: Spec) -> DataFrame:
    """Adds each system output, an expression of inputs and knobs."""
    return df.withColumns({name: ex.column(text) for name, text in spec.system.items()})


def system_terms(spec: Spec) -> dict[str, Column]:
    return {name: ex.column(text) for name, text in spec.system.items()}
