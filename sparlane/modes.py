"""Runs of whole modes from a specification and options: what the command line calls."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import expressions as ex
from .operators import boxes, design, discretize, explore, models, prep, selection, smooth, stable, subgroups
from .operators.prep import q
from .sources import files, reports
from .sources import spec as sp
from .stored import stored

#: Options and their defaults. Given ones go before those of a saved run, these before the defaults.
DEFAULTS: dict[str, object] = {
    "mode": None, "data": None, "new_data": None, "spec": None, "out": None, "name": None, "row_id": None, "features": None, "responses": None, "config": None, "log": "INFO",
    "model": "dt", "model_options": {}, "model_path": None, "use_model": False, "train_share": 0.7, "scale": False, "drop_constant": True, "impute": True, "weights": None, "top_features": 0,
    "bins": 10, "algorithm": "uniform", "labels": True, "estimators": ["pearson", "spearman"], "measure": "wracc", "depth": 3, "top": 15,
    "design": "full_factorial", "levels": None, "design_options": {}, "epsilon": 0.05, "pareto": False, "objectives": None, "assertions": None, "queries": None, "sample": 100,
}


@dataclass
class Run:
    """A run's session, options, specification and report files."""

    spark: SparkSession
    options: dict
    spec: sp.Spec | None
    reports: reports.Reports
    limits: dict = field(default_factory=dict)

    def __getattr__(self, name):
        try:
            return self.options[name]
        except KeyError:
            raise AttributeError(name) from None

    def table(self, which: str = "data") -> DataFrame:
        source = self.options[which]
        if source is None:
            raise ValueError(f"this mode needs {which}")
        return source if isinstance(source, DataFrame) else files.read_table(self.spark, source)

    @property
    def outputs(self) -> list[str]:
        """The responses: given, or the spec's outputs."""
        if self.options["responses"]:
            return list(self.options["responses"])
        if self.spec:
            return [v.label for v in self.spec.outputs]
        raise ValueError("no responses are given")

    def inputs(self, df: DataFrame) -> list[str]:
        """The features: given, or the spec's inputs and knobs, or all columns but responses and the row id."""
        if self.options["features"]:
            return list(self.options["features"])
        known = [v.label for v in self.spec.variables if v.interface != "output"] if self.spec else []
        return [c for c in known if c in df.columns] or [c for c in df.columns if c not in (*self.outputs, self.row_id)]

    def need_spec(self) -> sp.Spec:
        if self.spec is None:
            raise ValueError("this mode needs a specification")
        return self.spec


def prepared(run: Run, which: str = "data") -> tuple[DataFrame, list[str]]:
    """The table of a mode and its features: projected, rows without responses and constant columns dropped, nulls filled, factors encoded.

    Columns that constraints name are kept. The row id, or a hash of the row, is `_row`.
    """
    df = run.table(which)
    known = [r for r in run.outputs if r in df.columns]
    feats = run.inputs(df)
    df = df.withColumn("_row", q(run.row_id) if run.row_id else F.xxhash64(*map(q, df.columns))).select("_row", *map(q, [*feats, *known]))
    if isinstance(getattr(run, which), DataFrame) and which == "data":
        df = stored(df, "rows")  # may be a join or an aggregate, which the jobs below would each run again
    if which == "data":
        prep.check_responses(df, run.outputs)
        df = prep.drop_null_responses(df, known)
        keep = run.spec.constrained() if run.spec else set()
        if run.drop_constant:
            gone = set(prep.constant_columns(df.select(*map(q, feats)), [c for c in feats if c in keep]))
            feats = [c for c in feats if c not in gone]
            df = df.drop(*gone)
    if run.impute:
        df = prep.impute_mode(df, feats)
    return df, feats


def encoded(run: Run, df: DataFrame, feats: list[str], levels: Mapping[str, DataFrame] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Factors as integers in the order in which their levels first stand, by the given maps or new ones."""
    maps = dict(levels or {})
    for c in feats:
        if isinstance(df.schema[c].dataType, (T.StringType, T.BooleanType)):
            df = df.withColumn(c, q(c).cast("string"))
            maps.setdefault(c, prep.levels(df, c, "_row"))
            df = prep.encode(df, c, maps[c])
    return df, maps


def correlate(run: Run) -> DataFrame:
    """(feature, ranking) over all responses. With a response of two values or a factor, numeric features are binned first for the measures on factors."""
    df, feats = prepared(run)
    return run.reports.table("features_ranking", selection.correlate(df, feats, run.outputs, list(run.estimators)))


def discretized(run: Run) -> DataFrame:
    df = run.table()
    numbers = [c for c in (run.options["features"] or df.columns) if isinstance(df.schema[c].dataType, T.NumericType) and c != run.row_id]
    return run.reports.table("discretized", discretize.discretize(df, numbers, run.algorithm, run.bins, run.labels))


def subgroup(run: Run) -> DataFrame:
    """Ranked ranges of features for each response, and the data's projection on the features that they name."""
    df, feats = prepared(run)
    out = subgroups.discover(df, feats, run.outputs, measure=run.measure, depth=run.depth, top=run.top, bins=run.bins)
    if out is None:
        raise ValueError("no group of rows differs from all rows")
    out = run.reports.table("subgroups_ranking", out)
    named = {r[0] for c in ("feature_1", "feature_2", "feature_3") for r in out.select(c).distinct().collect() if r[0]}
    run.reports.table("subgroups_projection", df.select(*map(q, [*(c for c in feats if c in named), *run.outputs])))
    return out


def objectives_of(run: Run) -> dict[str, str]:
    named = run.objectives or (dict(run.spec.objectives) if run.spec else {})
    return dict(named) or {r: r for r in run.outputs}


def frontier(run: Run) -> DataFrame:
    """Rows of the stable Pareto frontier of a labelled table."""
    s = run.need_spec()
    df = run.table()
    if not run.row_id:
        df = df.withColumn("_row", F.xxhash64(*map(q, df.columns)))
    num = lambda x: None if x is None else float(x)
    axes = []
    for v in s.variables:
        if v.interface == "output" or v.label not in df.columns:
            continue
        lo, hi = v.range or (None, None)
        axes.append(boxes.Axis(v.label, num(v.rad_abs), num(v.rad_rel), num(lo), num(hi)))
    goals = objectives_of(run)
    names = {n: f"objective_{n}" if n in df.columns else n for n in goals}
    out = boxes.frontier(df, run.row_id or "_row", axes, [v.label for v in s.knobs], {names[n]: e for n, e in goals.items()}, ex.text(sp.alpha(s)), s.beta)
    return run.reports.table("pareto_frontier", out)


def doe(run: Run) -> DataFrame:
    """Points of a design; with a system in the spec its outputs are added, which makes the design training data."""
    levels = run.levels
    if levels is None:
        levels = {v.label: [float(g) for g in v.grid] if v.grid else [float(x) for x in v.range] for v in run.need_spec().variables if v.interface != "output"}
    elif not isinstance(levels, Mapping):
        levels = files.read_levels(files.read_table(run.spark, levels))
    if run.design not in design.DESIGNS:
        raise ValueError(f"design {run.design!r} is none of {sorted(design.DESIGNS)}")
    out = design.DESIGNS[run.design](run.spark, levels, **run.design_options)
    if run.spec and run.spec.system:
        out = sp.evaluate_system(out, run.spec)
    return run.reports.table("doe", out)


def fitted(run: Run) -> tuple[models.Fitted, DataFrame, DataFrame, list[str]]:
    """The model, trained or loaded, with training and test rows and features. Writes the model and its side files."""
    df, feats = prepared(run)
    if run.use_model:
        m, side = models.Fitted.load_all(run.spark, run.model_path)
        df, _ = encoded(run, df, m.features, reports.load_levels(run.spark, f"{run.model_path}/levels.json") if side else None)
        limits = reports.load_scaling(f"{run.model_path}/scaling.json") if run.scale else {}
        feats = m.features
    else:
        df, maps = encoded(run, df, feats)
        if run.top_features:
            picked = [f for r in run.outputs for f, _ in selection.mrmr(df, feats, r, run.top_features)]
            feats = selection.model_features(picked, list(run.spec.constrained()) if run.spec else [], feats)
        limits = prep.bounds(df, [*feats, *run.outputs]) if run.scale else {}
    df = prep.scale(df, limits) if limits else df
    train, test = prep.split(df, "_row", run.train_share)
    if not run.use_model:
        weight = None
        if run.weights:
            train, weight = prep.weights(train, run.outputs, *run.weights), "weight"
        m = models.train(train, feats, run.outputs, run.model, weight, **run.model_options)
        if run.model_path:
            m.save_all(run.model_path)
            reports.save_levels(f"{run.model_path}/levels.json", maps)
            files.save_json(f"{run.model_path}/features.json", {r: feats for r in run.outputs})
            if limits:
                reports.save_scaling(f"{run.model_path}/scaling.json", limits)
            files.save_json(f"{run.model_path}/rerun.json", {k: v for k, v in run.options.items() if isinstance(v, (str, int, float, bool, list, dict, type(None))) and k not in ("data", "new_data")})
    run.limits = limits
    return m, train, test, feats


def _predicted(run: Run, m: models.Fitted, df: DataFrame, part: str) -> DataFrame:
    """Predictions in the responses' own units, written with their precisions where the responses are known."""
    out = m.predict(df)
    names = {r: f"{r}_{m.kind}" for r in m.responses}
    limits = {k: v for k, v in run.limits.items() if k in out.columns} | {p: run.limits[r] for r, p in names.items() if r in run.limits}
    out = prep.unscale(out, limits) if limits else out
    known = [r for r in m.responses if r in out.columns]
    run.reports.table(f"{part}_predictions_summary", out.select(*map(q, [*known, *names.values()])))
    if known:
        run.reports.table(f"{part}_prediction_precisions", models.precision(out, {r: names[r] for r in known}))
    return out


def train(run: Run) -> DataFrame:
    """(part, response, mse, r2, rmse) of training, test and all labelled rows, and of new rows that have responses."""
    m, train_df, test_df, feats = fitted(run)
    parts = {"training": train_df, "test": test_df, "labeled": train_df.unionByName(test_df) if run.train_share < 1 else train_df}
    if run.new_data is not None:
        new, _ = prepared(run, "new_data")
        new, _ = encoded(run, new, feats, reports.load_levels(run.spark, f"{run.model_path}/levels.json") if run.model_path else None)
        parts["new"] = prep.scale(new, {k: v for k, v in run.limits.items() if k in new.columns}) if run.limits else new
    out = None
    for part, df in parts.items():
        got = _predicted(run, m, df, part)
        known = {r: f"{r}_{m.kind}" for r in m.responses if r in got.columns}
        if known:
            one = models.precision(got, known).select(F.lit(part).alias("part"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def loaded(run: Run) -> tuple[models.Fitted, dict | None]:
    """A saved model alone, with its level maps; the run takes its features, responses and scaling."""
    m, side = models.Fitted.load_all(run.spark, run.model_path)
    run.options = run.options | {"features": m.features, "responses": m.responses}
    if files.there(f"{run.model_path}/scaling.json"):
        run.limits = reports.load_scaling(f"{run.model_path}/scaling.json")
    return m, reports.load_levels(run.spark, f"{run.model_path}/levels.json") if side else None


def predict(run: Run) -> DataFrame:
    """The new rows with their predictions, by a trained model, or by a loaded one without the data that it was trained on."""
    if run.use_model:
        m, maps = loaded(run)
    else:
        m = fitted(run)[0]
        maps = reports.load_levels(run.spark, f"{run.model_path}/levels.json") if run.model_path else None
    new, _ = prepared(run, "new_data")
    new, _ = encoded(run, new, m.features, maps)
    new = prep.scale(new, {k: v for k, v in run.limits.items() if k in new.columns}) if run.limits else new
    return _predicted(run, m, new, "new").drop("_row")


def explored(run: Run) -> DataFrame | smooth.Smooth:
    """What is explored, in the variables' own units: a given cell relation, that of trees, or a network or polynomial; trained or loaded."""
    if isinstance(run.options["data"], DataFrame) and any(c.startswith("lo_") for c in run.options["data"].columns):
        return run.options["data"].cache()
    m = loaded(run)[0] if run.use_model and run.options["data"] is None else fitted(run)[0]
    if m.kind in ("nn", "poly", "linear"):
        out = smooth.smooth_model(m, (run.model_options or {}).get("degree", 2))
        return smooth.in_own_units(out, run.limits) if run.limits else out
    if m.kind not in ("dt", "rf", "et", "gbr"):
        raise ValueError(f"{m.kind}: only trees, forests, networks and polynomials are explored")
    run.reports.table("model_rules", reduce(lambda a, b: a.unionByName(b), [models.rules_text(models.leaf_boxes(run.spark, m.models[r], m.features), m.features, r) for r in m.responses]))
    out = stable.model_cells(run.spark, m)
    for name, (lo, hi) in run.limits.items():
        own = lambda c, lo=lo, hi=hi: q(c) * F.lit(float(hi) - float(lo)) + F.lit(float(lo))
        out = out.withColumns({c: own(c) for c in ((name,) if name in m.responses else (f"lo_{name}", f"hi_{name}"))})
    return out.cache()


def cells(run: Run) -> DataFrame:
    """The cell relation that is explored."""
    out = explored(run)
    if isinstance(out, smooth.Smooth):
        raise ValueError("this needs a tree model")
    return out


def consistent(run: Run, c: DataFrame) -> bool:
    ok = stable.feasible(run.spark, run.need_spec(), c)
    run.reports.state("consistency", ok)
    return all(ok.values())


def _none(run: Run, columns: str, rows: list[tuple]) -> DataFrame:
    return run.spark.createDataFrame(rows, columns)


def query(run: Run) -> DataFrame:
    """(name, status, witness) of the spec's queries."""
    s, c = run.need_spec(), explored(run)
    named = dict(run.queries or s.queries)
    if isinstance(c, smooth.Smooth):
        return run.reports.statuses("query_results", smooth.as_queries(run.spark, c, s, named), "name")
    if not consistent(run, c):
        return run.reports.statuses("query_results", _none(run, "name string, status string, witness string", [(n, "ERROR", None) for n in named]), "name")
    return run.reports.statuses("query_results", stable.query(run.spark, s, c, named), "name")


def verify(run: Run) -> DataFrame:
    """(configuration, assertion, status, counter_example) of the spec's assertions at its configurations."""
    s, c = run.need_spec(), explored(run)
    asked = dict(run.assertions or s.assertions)
    if isinstance(c, smooth.Smooth):
        out = None
        at = run.spark.createDataFrame([(n, *(float(Fraction(x[v.label])) for v in s.knobs)) for n, x in s.configurations.items()], "configuration string, " + ", ".join(f"`{v.label}` double" for v in s.knobs))
        for label, text in asked.items():
            point = F.when(F.col("counter_example").isNotNull(), F.struct(*[F.col("counter_example")[i].alias(f) for i, f in enumerate(c.features)]))
            one = smooth.verify(c, at, s, text).select(F.col("box").alias("configuration"), F.lit(label).alias("assertion"), "status", point.alias("counter_example"))
            out = one if out is None else out.unionByName(one)
    else:
        out = stable.verify(run.spark, s, c, s.configurations, asked)
    return run.reports.statuses("verify_results", out.withColumn("name", F.concat_ws(":", "configuration", "assertion")), "name").drop("name")


def certify(run: Run) -> DataFrame:
    """(query, name, status) of the spec's witnesses, each for the query of its name, or for all."""
    s, c = run.need_spec(), explored(run)
    out = None
    for name, text in dict(run.queries or s.queries).items():
        at = {name: s.witnesses[name]} if name in s.witnesses else dict(s.witnesses)
        at = {k: w for k, w in at.items() if explore.witness_consistent(s, w)}
        if at:
            one = smooth.certify(run.spark, c, s, at, text) if isinstance(c, smooth.Smooth) else stable.certify(run.spark, s, c, at, text)
            one = one.select(F.lit(name).alias("query"), "name", "status")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no consistent witness")
    return run.reports.statuses("certify_results", out.withColumn("key", F.concat_ws(":", "query", "name")), "key").drop("key")


def synthesize(run: Run) -> DataFrame:
    """(name, status, witness): a configuration for beta and the assertions."""
    s, c = run.need_spec(), explored(run)
    out = smooth.as_queries(run.spark, c, s, {"synthesis": sp.beta(s, assertions=True)}) if isinstance(c, smooth.Smooth) else stable.synthesize(run.spark, s, c)
    return run.reports.statuses("synthesis_results", out, "name")


def _optimize_smooth(run: Run, model: smooth.Smooth, condition) -> DataFrame:
    s, goals, knobs = run.need_spec(), objectives_of(run), [v.label for v in run.need_spec().knobs]
    if run.pareto and len(goals) > 1:
        raise ValueError("networks and polynomials are optimized for one objective at a time")
    rows = []
    for o, e in goals.items():
        best = smooth.optimize(run.spark, model, s, e, condition, run.epsilon)
        if best:
            lo, hi = best["range"]
            rows.append((o, best["lower"], (best["lower"] - lo) / ((hi - lo) or 1.0), *(float(best["configuration"][k]) for k in knobs)))
    run.reports.state("optimization_results", {r[0]: {"threshold": r[1], "scaled": r[2], **dict(zip(knobs, r[3:], strict=True))} for r in rows} or {"status": "UNSAT"})
    return run.reports.table("optimization_results", _none(run, "objective string, threshold double, scaled double, " + ", ".join(f"`{k}` double" for k in knobs), rows))


def _optimize(run: Run, condition) -> DataFrame:
    """(objective, threshold, scaled, <knob>...) of each objective by itself, or with `pareto` of all together, with the course of the search."""
    s, c = run.need_spec(), explored(run)
    if isinstance(c, smooth.Smooth):
        return _optimize_smooth(run, c, condition)
    goals, knobs = objectives_of(run), [v.label for v in s.knobs]
    if not consistent(run, c):
        run.reports.state("optimization_results", {"status": "ERROR"})
        return _none(run, "objective string, threshold double, scaled double, " + ", ".join(f"`{k}` double" for k in knobs), [])
    rows, steps = [], []
    if run.pareto and len(goals) > 1:
        valued = c.withColumns({f"_{o}": ex.column(e).cast("double") for o, e in goals.items()})
        points = stable.stable(stable.critical_points(run.spark, s, c), s, c, condition)
        got = explore.thresholds(points, s, valued, [f"_{o}" for o in goals])
        steps = [{f"{o}_scaled": g["fixed"].get(f"_{o}", g["level"]) for o in goals} for g in got[:-1]]
        ends = {o: valued.agg(F.min(f"_{o}"), F.max(f"_{o}")).first() for o in goals}
        rows = [(o, got[-1]["objectives"][f"_{o}"], (got[-1]["objectives"][f"_{o}"] - ends[o][0]) / ((ends[o][1] - ends[o][0]) or 1.0), *(float(got[-1]["solution"][k]) for k in knobs)) for o in goals] if got else []
    else:
        for o, e in goals.items():
            lo, hi = c.agg(F.min(ex.column(e).cast("double")), F.max(ex.column(e).cast("double"))).first()
            for step in stable.bisect(run.spark, s, c, e, run.epsilon, condition).orderBy("step").collect():
                steps.append({o: step["lower"], f"{o}_scaled": None if step["lower"] is None else (step["lower"] - lo) / ((hi - lo) or 1.0)})
                run.reports.state("optimization_progress", steps)
            best = stable.optimize(run.spark, s, c, e, condition).first()
            if best is not None:
                rows.append((o, best["least"], (best["least"] - lo) / ((hi - lo) or 1.0), *(float(best[k]) for k in knobs)))
    out = _none(run, "objective string, threshold double, scaled double, " + ", ".join(f"`{k}` double" for k in knobs), rows)
    run.reports.table("optimization_progress", reports.progress(run.spark, steps, knobs, [], list(goals)))
    run.reports.state("optimization_results", {r[0]: {"threshold": r[1], "scaled": r[2], **dict(zip(knobs, r[3:], strict=True))} for r in rows} or {"status": "UNSAT"})
    return run.reports.table("optimization_results", out)


def optimize(run: Run) -> DataFrame:
    return _optimize(run, sp.beta(run.need_spec()))


def optsyn(run: Run) -> DataFrame:
    """As `optimize`, under the assertions as well."""
    return _optimize(run, sp.beta(run.need_spec(), assertions=True))


def refine(run: Run) -> DataFrame:
    """(response, mse, r2, rmse) of the model against the system in the box of the best configuration."""
    m = fitted(run)[0]
    best = _optimize(run, sp.beta(run.need_spec())).first()
    if best is None:
        raise ValueError("no stable configuration")
    out = models.refine(run.spark, run.spec, {v.label: best[v.label] for v in run.spec.knobs}, m, dict(run.spec.system), run.sample)
    return run.reports.table("refinement", out)


MODES: dict[str, Callable[[Run], DataFrame]] = {"correlate": correlate, "discretize": discretized, "subgroups": subgroup, "frontier": frontier, "doe": doe, "train": train, "predict": predict, "query": query, "verify": verify, "certify": certify, "synthesize": synthesize, "optimize": optimize, "optsyn": optsyn, "refine": refine}


def run(spark: SparkSession, mode: str, **given) -> DataFrame:
    """Runs a mode and gives its main table; with `out` its reports are written to <out>/<name>_<data>_<report>.

    `spec` is a path or a dictionary, `data` and `new_data` are paths or DataFrames, `config` is a saved run's JSON.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {sorted(MODES)}")
    saved = files.load_json(given["config"]) if given.get("config") else None
    options = files.options(DEFAULTS, {k: v for k, v in (saved or {}).items() if k in DEFAULTS}, given | {"mode": mode})
    spec = options["spec"]
    spec = spec if spec is None or isinstance(spec, sp.Spec) else sp.from_dict(spec) if isinstance(spec, Mapping) else sp.load(spec)
    data = options["data"] if isinstance(options["data"], str) else None
    prefix = files.output_prefix(options["out"], data, options["name"]) if options["out"] else None
    prefix = prefix.rstrip("/") + ("" if options["name"] or data else "/run") if prefix else None
    log = reports.logger(level=options["log"])
    log.info("mode %s begins", mode)
    out = MODES[mode](Run(spark, options, spec, reports.Reports(prefix)))
    log.info("mode %s has ended", mode)
    return out


def _value(text: str):
    """A value of the command line: JSON where it reads as such, else the text."""
    try:
        return json.loads(text, parse_float=lambda x: float(Fraction(x)))
    except ValueError:
        return text


def main(argv: list[str] | None = None) -> int:
    """`python -m sparlane MODE --option value ...`: options are those of `DEFAULTS`, lists and mappings as JSON."""
    import argparse

    p = argparse.ArgumentParser(prog="sparlane", description="Runs a mode over a labelled table.")
    p.add_argument("mode", choices=sorted(MODES))
    for name, default in DEFAULTS.items():
        if name != "mode":
            p.add_argument(f"--{name}", type=_value, default=None, help=f"default: {default!r}")
    given = {k: v for k, v in vars(p.parse_args(argv)).items() if v is not None}
    spark = SparkSession.builder.appName("sparlane").getOrCreate()
    run(spark, given.pop("mode"), **given).show(50, truncate=False)
    return 0
