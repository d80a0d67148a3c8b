"""Models over labelled tables: training, prediction, reports, and refinement by sampling around a configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..shipping import ship
from ..sources.files import load_json, save_json, there
from .neighbours import TableNeighbours, table_neighbours
from .network import Network, train_network
from .prep import q


def _stages(kind: str, features: Sequence[str], response: str, weight: str | None, options: Mapping) -> list:
    out = f"{response}_{kind}"
    columns = {"labelCol": response, "predictionCol": out} | ({"weightCol": weight} if weight else {})
    first = VectorAssembler(inputCols=list(features), outputCol="_features")
    if kind == "poly":
        return [first, PolynomialExpansion(degree=options.get("degree", 2), inputCol="_features", outputCol="_powers"), LinearRegression(featuresCol="_powers", solver="normal", **columns)]
    made = {
        "dt": lambda: DecisionTreeRegressor(featuresCol="_features", seed=17, **columns, **options),
        "rf": lambda: RandomForestRegressor(featuresCol="_features", seed=17, **columns, **options),
        "gbr": lambda: GBTRegressor(featuresCol="_features", seed=17, **columns, **options),
        "linear": lambda: LinearRegression(featuresCol="_features", **columns, **options),
    }
    return [first, made[kind]()]


KINDS = ("dt", "rf", "et", "poly", "gbr", "linear", "nn", "knn")


@dataclass
class Fitted:
    kind: str
    features: list[str]
    responses: list[str]
    models: dict[str, object]

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds <response>_<kind> for each response."""
        out = df
        for r in self.responses:
            m = self.models[r]
            out = m(out) if callable(m) else m.transform(out).drop("_features", "_powers")
        return out

    def save(self, path: str) -> None:
        """The models, in a folder each, and what is needed to load them."""
        for i, r in enumerate(self.responses):
            m = self.models[r]
            if isinstance(m, PipelineModel):
                m.write().overwrite().save(f"{path}/{i}")
        states = {r: m.store(f"{path}/{i}") if isinstance(m, TableNeighbours) else m.state() for i, (r, m) in enumerate(self.models.items()) if not isinstance(m, PipelineModel)}
        save_json(f"{path}/model.json", {"kind": self.kind, "features": self.features, "responses": self.responses, "states": states})

    save_all = save

    @classmethod
    def load(cls, path: str, *_) -> Fitted:
        side = load_json(f"{path}/model.json")
        kinds = {"nn": Network, "knn": Neighbours, "et": RandomTrees}
        pick = lambda state: TableNeighbours if "path" in state else kinds[side["kind"]]
        made = {r: pick(side["states"][r]).from_state(side["states"][r]) if r in side["states"] else PipelineModel.load(f"{path}/{i}") for i, r in enumerate(side["responses"])}
        return cls(side["kind"], side["features"], side["responses"], made)

    @classmethod
    def load_all(cls, spark, path: str) -> tuple[Fitted, bool]:
        """The model, and whether level maps were saved beside it."""
        return cls.load(path), there(f"{path}/levels.json")


def train(df: DataFrame, features: Sequence[str], responses: Sequence[str], kind: str = "dt", weight: str | None = None, **options) -> Fitted:
    """One model for each response. Rows with a null feature or response are left out of training."""
    use = df.dropna("any", subset=[*features, *responses])
    make = {
        "nn": lambda r: train_network(use, features, r, f"{r}_nn", **options),
        "knn": lambda r: neighbours(use, features, r, f"{r}_knn", **options),
        "et": lambda r: random_trees(use, features, r, f"{r}_et", weight, **options),
    }.get(kind, lambda r: Pipeline(stages=_stages(kind, features, r, weight, options)).fit(use))
    return Fitted(kind, list(features), list(responses), {r: make(r) for r in responses})


class Neighbours:
    """Mean response of the k nearest training points (Euclid); of points at one distance those that come first."""

    def __init__(self, features: Sequence[str], out: str, points: np.ndarray, values: np.ndarray, k: int):
        self.features, self.out, self.points, self.values, self.k = list(features), out, points, values, k

    def __call__(self, df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast((self.points, self.values, self.k))

        @F.pandas_udf("double")
        def f(*cols: pd.Series) -> pd.Series:
            points, values, k = shared.value
            x, out = np.stack([c.to_numpy(float) for c in cols], 1), []
            step = max(1, 4_000_000 // max(1, len(points)))
            for lo in range(0, len(x), step):
                d = ((x[lo : lo + step, None, :] - points[None]) ** 2).sum(2)
                out.append(values[np.argsort(d, axis=1, kind="stable")[:, :k]].mean(1))
            return pd.Series(np.concatenate(out) if out else np.zeros(0))

        return df.withColumn(self.out, f(*[q(c).cast("double") for c in self.features]))

    def state(self) -> dict:
        return {"features": self.features, "out": self.out, "points": self.points.tolist(), "values": self.values.tolist(), "k": self.k}

    @classmethod
    def from_state(cls, s: dict) -> Neighbours:
        return cls(s["features"], s["out"], np.array(s["points"]), np.array(s["values"]), s["k"])


def neighbours(df: DataFrame, features: Sequence[str], response: str, out: str, k: int = 5, most: int = 20_000) -> Neighbours | TableNeighbours:
    """k-nearest-neighbour regression over all training rows: up to `most` of them go to every task, more stay a table that queries are dealt to."""
    if df.limit(most + 1).count() > most:
        return table_neighbours(df, features, response, out, k)
    turn = F.xxhash64(*map(q, features), q(response))
    rows = np.array([tuple(map(float, r)) for r in df.orderBy(turn, *map(q, [*features, response])).select(*map(q, [*features, response])).collect()], float).reshape(-1, len(features) + 1)
    if not len(rows):
        raise ValueError("no training rows")
    return Neighbours(features, out, rows[:, :-1], rows[:, -1], min(k, len(rows)))


class RandomTrees:
    """Extremely random trees as nested (feature, cut, left, right); a leaf is (value, count). The prediction is the trees' mean, a plain expression."""

    def __init__(self, features: Sequence[str], out: str, trees: list):
        self.features, self.out, self.trees = list(features), out, trees

    def __call__(self, df: DataFrame) -> DataFrame:
        def column(node) -> Column:
            return F.lit(float(node[0])) if len(node) == 2 else F.when(q(node[0]) <= F.lit(node[1]), column(node[2])).otherwise(column(node[3]))

        return df.withColumn(self.out, sum((column(t) for t in self.trees[1:]), column(self.trees[0])) / F.lit(float(len(self.trees))))

    def state(self) -> dict:
        return {"features": self.features, "out": self.out, "trees": self.trees}

    @classmethod
    def from_state(cls, s: dict) -> RandomTrees:
        return cls(s["features"], s["out"], s["trees"])


def random_trees(df: DataFrame, features: Sequence[str], response: str, out: str, weight: str | None = None, numTrees: int = 10, cuts: int = 24, seed: int = 17, **options) -> RandomTrees:  # noqa: N803
    """Trees whose thresholds are drawn at random: each tree sees a feature only as its place among `cuts` uniform draws in the feature's range.

    All rows and features take part in each tree (no bootstrap).
    """
    ends = df.agg(*[e for f in features for e in (F.min(q(f)), F.max(q(f)))]).first()
    rng, trees = np.random.default_rng(seed), []
    use = df.select(*[q(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], q(response).cast("double").alias("y"), *([q(weight).alias("w")] if weight else [])).cache()
    for t in range(numTrees):
        drawn = [sorted(rng.uniform(float(ends[2 * i]), float(ends[2 * i + 1]), cuts).tolist()) for i in range(len(features))]
        places = [sum(((F.col(f"x{i}") > F.lit(c)).cast("int") for c in drawn[i][1:]), (F.col(f"x{i}") > F.lit(drawn[i][0])).cast("int")).alias(f"p{i}") for i in range(len(features))]
        stages = [VectorAssembler(inputCols=[f"p{i}" for i in range(len(features))], outputCol="_features"), DecisionTreeRegressor(featuresCol="_features", labelCol="y", seed=seed + t, maxBins=max(32, cuts + 2), **({"weightCol": "w"} if weight else {}), **options)]
        root = Pipeline(stages=stages).fit(use.select(*places, "y", *(["w"] if weight else []))).stages[-1]._call_java("rootNode")

        def grown(node, drawn=drawn):
            if node.getClass().getSimpleName() == "LeafNode":
                return [node.prediction(), float(node.impurityStats().count())]
            s = node.split()
            return [features[s.featureIndex()], drawn[s.featureIndex()][int(s.threshold())], grown(node.leftChild()), grown(node.rightChild())]

        trees.append(grown(root))
    use.unpersist()
    return RandomTrees(features, out, trees)


def tune(df: DataFrame, features: Sequence[str], response: str, kind: str, grid: Mapping[str, Sequence], folds: int = 3) -> tuple[Fitted, list[float]]:
    """The best of a grid of options by cross-validated RMSE, and all averages."""
    use = df.dropna("any", subset=[*features, response])
    stages = _stages(kind, features, response, None, {})
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(stages[-1].getParam(name), list(values))
    cv = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=b.build(), evaluator=RegressionEvaluator(labelCol=response, predictionCol=f"{response}_{kind}"), numFolds=folds, seed=17)
    m = cv.fit(use)
    return Fitted(kind, list(features), [response], {response: m.bestModel}), list(m.avgMetrics)


def precision(df: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """(response, mse, r2, rmse) of true columns and their predictions, in one aggregate."""
    cells = []
    for y, p in pairs.items():
        both = q(y).isNotNull() & q(p).isNotNull()
        a, b = F.when(both, q(y).cast("double")), F.when(both, q(p).cast("double"))
        mse = F.avg((a - b) * (a - b))
        cells.append(F.struct(F.lit(y).alias("response"), mse.alias("mse"), (1 - F.try_divide(mse, F.var_pop(a))).alias("r2"), F.sqrt(mse).alias("rmse")))
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("c")).select("c.*")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, lo, hi, n): what a plot of a response's distribution shows."""
    lo, hi = map(float, df.agg(F.min(q(column)), F.max(q(column))).first())
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((q(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.where(q(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "n")


def rounded_weights(df: DataFrame, column: str, digits: int) -> DataFrame:
    return df.withColumn(column, F.transform(q(column), lambda w: F.round(w, digits)))


def grid_predictions(points: DataFrame, model: Fitted, objective: str, threshold: float) -> DataFrame:
    """Grid points whose predicted objective (an expression of predictions and knobs) reaches the threshold."""
    return model.predict(points).withColumn("objective", ex.column(objective)).where(F.col("objective") >= threshold)


def refine(spark, spec, center: Mapping[str, float], model: Fitted, system: Mapping[str, str], n: int = 100, seed: int = 17) -> DataFrame:
    """(response, mse, r2, rmse) of the model against the system over points in the stability box of a configuration; all responses."""
    from .design import latin_hypercube

    box = {}
    for v in spec.variables:
        if v.interface == "knob":
            r = float(v.radius(center[v.label]))
            lo, hi = center[v.label] - r, center[v.label] + r
            if v.range:
                lo, hi = (lo if v.range[0] is None else max(lo, float(v.range[0]))), (hi if v.range[1] is None else min(hi, float(v.range[1])))
            box[v.label] = [lo, hi]
        elif v.interface == "input" and v.range and None not in v.range:
            box[v.label] = [float(x) for x in v.range]
    points = latin_hypercube(spark, box, n, seed)
    both = model.predict(points.withColumns({k: ex.column(e).cast("double") for k, e in system.items()}))
    return precision(both, {r: f"{r}_{model.kind}" for r in system})


def tree_nodes(model: PipelineModel) -> list[dict]:
    """Leaves of a fitted tree or forest: tree, weight, value, and the half-open range (lo, hi] of each feature that its path bounds."""
    if isinstance(model, RandomTrees):
        out, todo = [], [(t, tree, {}) for t, tree in enumerate(model.trees)]
        while todo:
            t, node, box = todo.pop()
            if len(node) == 2:
                out.append({"tree": t, "weight": 1.0 / len(model.trees), "value": node[0], "count": node[1], "box": box})
                continue
            f, cut = node[:2]
            lo, hi = box.get(f, (float("-inf"), float("inf")))
            todo += [(t, node[2], box | {f: (lo, min(hi, cut))}), (t, node[3], box | {f: (max(lo, cut), hi)})]
        return out
    stage, names = model.stages[-1], model.stages[0].getInputCols()
    trees = list(stage.trees) if hasattr(stage, "trees") else [stage]
    weights = list(stage.treeWeights) if hasattr(stage, "treeWeights") else [1.0]
    total = 1.0 if type(stage).__name__.startswith("GBT") else sum(weights)
    out = []
    for t, (tree, w) in enumerate(zip(trees, weights, strict=True)):
        todo = [(tree._call_java("rootNode"), {})]
        while todo:
            node, box = todo.pop()
            if node.getClass().getSimpleName() == "LeafNode":
                out.append({"tree": t, "weight": w / total, "value": node.prediction(), "count": node.impurityStats().count(), "box": box})
                continue
            s = node.split()
            f, cut = names[s.featureIndex()], s.threshold()
            lo, hi = box.get(f, (float("-inf"), float("inf")))
            todo.append((node.leftChild(), box | {f: (lo, min(hi, cut))}))
            todo.append((node.rightChild(), box | {f: (max(lo, cut), hi)}))
    return out


def leaf_boxes(spark, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(tree, leaf, weight, value, count, lo_<f>, hi_<f>): the tree as a relation. Its rows are the model's own leaves."""
    rows = [(n["tree"], i, n["weight"], float(n["value"]), float(n["count"]), *[float(x) for f in features for x in n["box"].get(f, (float("-inf"), float("inf")))]) for i, n in enumerate(tree_nodes(model))]
    return spark.createDataFrame(rows, "tree int, leaf int, weight double, value double, count double, " + ", ".join(f"`lo_{f}` double, `hi_{f}` double" for f in features))


def rules_text(boxes: DataFrame, features: Sequence[str], response: str) -> DataFrame:
    """(rule, coverage): leaves as text, the most covering first."""
    inf = F.lit(float("inf"))
    parts = [e for f in features for e in (F.when(q(f"lo_{f}") > -inf, F.concat(F.lit(f"{f} > "), q(f"lo_{f}").cast("string"))), F.when(q(f"hi_{f}") < inf, F.concat(F.lit(f"{f} <= "), q(f"hi_{f}").cast("string"))))]
    return boxes.select(F.concat(F.lit("if "), F.coalesce(F.nullif(F.concat_ws(" and ", *parts), F.lit("")), F.lit("true")), F.lit(f" then {response} = "), F.col("value").cast("string")).alias("rule"), F.col("count").alias("coverage")).orderBy(F.desc("coverage"), "rule")


def forest_boxes(boxes: DataFrame, features: Sequence[str], most: int = 200_000) -> DataFrame:
    """The forest as one relation of disjoint boxes: non-empty intersections of one leaf of each tree, with the weighted sum.

    Trees are joined one by one and empty boxes dropped at once; more than `most` boxes is an error.
    """
    trees = sorted(r[0] for r in boxes.select("tree").distinct().collect())
    out = None
    for t in trees:
        one = boxes.where(F.col("tree") == t).select((F.col("weight") * F.col("value")).alias("value"), *[q(f"{s}_{f}") for f in features for s in ("lo", "hi")])
        if out is None:
            out = one
            continue
        a, b = out.alias("a"), one.alias("b")
        meet = reduce(lambda x, y: x & y, [F.greatest(F.col(f"a.`lo_{f}`"), F.col(f"b.`lo_{f}`")) < F.least(F.col(f"a.`hi_{f}`"), F.col(f"b.`hi_{f}`")) for f in features])
        out = a.join(b, meet).select((F.col("a.value") + F.col("b.value")).alias("value"), *[e for f in features for e in (F.greatest(F.col(f"a.`lo_{f}`"), F.col(f"b.`lo_{f}`")).alias(f"lo_{f}"), F.least(F.col(f"a.`hi_{f}`"), F.col(f"b.`hi_{f}`")).alias(f"hi_{f}"))])
        if out.limit(most + 1).count() > most:
            raise ValueError(f"the forest has more than {most} boxes")
    return out


def polynomial_term(model: PipelineModel, features: Sequence[str], degree: int = 2) -> tuple[Column, str]:
    """The fitted polynomial as a Column and as text; powers in the order of PolynomialExpansion."""
    stage = model.stages[-1]

    def expand(names: list[str], deg: int) -> list[dict[str, int]]:
        if not names:
            return [{}]
        out = []
        for p in range(deg + 1):
            out += [d | ({names[-1]: p} if p else {}) for d in expand(names[:-1], deg - p)]
        return out

    terms = [d for d in expand(list(features), degree) if d]
    coef = list(stage.coefficients)
    col, parts = F.lit(float(stage.intercept)), [repr(float(stage.intercept))]
    for c, d in zip(coef, terms, strict=True):
        prod = reduce(lambda a, b: a * b, [q(n).cast("double") for n, p in d.items() for _ in range(p)])
        col = col + F.lit(float(c)) * prod
        parts.append(f"{float(c)!r} * " + " * ".join(n for n, p in d.items() for _ in range(p)))
    return col, " + ".join(parts)
