"""A small dense network for regression, trained by averaged gradients over partitions."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .prep import q


def initial(sizes: Sequence[int], seed: int = 17) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]


def forward(layers, x: np.ndarray) -> list[np.ndarray]:
    """Activations of all layers; relu inside, linear at the end."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(z if i == len(layers) - 1 else np.maximum(z, 0))
    return out


def gradient(layers, x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    acts, grads = forward(layers, x), []
    d = (acts[-1][:, 0] - y)[:, None] * 2
    for i in range(len(layers) - 1, -1, -1):
        grads.append((acts[i].T @ d, d.sum(0)))
        if i:
            d = (d @ layers[i][0].T) * (acts[i] > 0)
    return grads[::-1]


def _add(a, b):
    return (a[0] + b[0], [(w + v, c + d) for (w, c), (v, d) in zip(a[1], b[1], strict=True)])


class Network:
    """A trained network: adds its prediction `out` to rows with its features; `state` is what JSON can hold of it."""

    def __init__(self, features: Sequence[str], out: str, layers, lo: np.ndarray, span: np.ndarray):
        self.features, self.out, self.layers, self.lo, self.span = list(features), out, layers, lo, span

    def __call__(self, d: DataFrame) -> DataFrame:
        ship(d.sparkSession)
        layers, lo, span = self.layers, self.lo, self.span

        @F.pandas_udf("double")
        def f(*cols: pd.Series) -> pd.Series:
            x = (np.stack([c.to_numpy(float) for c in cols], 1) - lo[:-1]) / span[:-1]
            return pd.Series(forward(layers, x)[-1][:, 0] * span[-1] + lo[-1])

        return d.withColumn(self.out, f(*[q(c).cast("double") for c in self.features]))

    def state(self) -> dict:
        return {"features": self.features, "out": self.out, "layers": [[w.tolist(), b.tolist()] for w, b in self.layers], "lo": self.lo.tolist(), "span": self.span.tolist()}

    @classmethod
    def from_state(cls, s: dict) -> Network:
        return cls(s["features"], s["out"], [(np.array(w), np.array(b)) for w, b in s["layers"]], np.array(s["lo"]), np.array(s["span"]))


def train_network(df: DataFrame, features: Sequence[str], response: str, out: str, hidden: Sequence[int] = (16, 8), epochs: int = 60, rate: float = 0.05, digits: int | None = None) -> Network:
    """A dense network. Inputs and the response are scaled to [0, 1]; each epoch sums full gradients over Arrow blocks, and these in a tree of partitions."""
    ship(df.sparkSession)
    names = [*features, response]
    ends = df.agg(*[e for c in names for e in (F.min(q(c)), F.max(q(c)))]).first()
    lo, span = np.array([float(ends[2 * i]) for i in range(len(names))]), np.array([max(float(ends[2 * i + 1]) - float(ends[2 * i]), 1e-12) for i in range(len(names))])
    data = df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).cache()
    layers = initial([len(features), *hidden, 1])
    m = [(np.zeros_like(w), np.zeros_like(b)) for w, b in layers]
    v = [(np.zeros_like(w), np.zeros_like(b)) for w, b in layers]
    for step in range(1, epochs + 1):

        def run(batches, layers=layers):
            total, rows = None, 0
            for b in batches:
                if b.num_rows:
                    a = (np.stack([c.to_numpy() for c in b.columns], 1) - lo) / span
                    g = gradient(layers, a[:, :-1], a[:, -1])
                    total, rows = g if total is None else _add((0, total), (0, g))[1], rows + b.num_rows
            if rows:
                flat = np.concatenate([x.ravel() for pair in total for x in pair])
                yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([flat.tobytes()], pa.binary())], names=["n", "g"])

        n, flat = data.mapInArrow(run, "n long, g binary").rdd.map(lambda r: (r[0], np.frombuffer(r[1]))).treeReduce(lambda x, y: (x[0] + y[0], x[1] + y[1]))
        g, at = [], 0
        for w, b in layers:
            g.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size].reshape(b.shape)))
            at += w.size + b.size
        new = []
        for i, ((w, b), (dw, db)) in enumerate(zip(layers, g, strict=True)):
            pair = []
            for j, (p, d) in enumerate(((w, dw / n), (b, db / n))):
                mm, vv = m[i][j], v[i][j]
                mm += 0.1 * (d - mm)
                vv += 0.001 * (d * d - vv)
                pair.append(p - rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8))
            new.append(tuple(pair))
        layers = new
    data.unpersist()
    if digits is not None:
        layers = [(np.round(w, digits), np.round(b, digits)) for w, b in layers]
    return Network(features, out, layers, lo, span)


def tune_network(df: DataFrame, features: Sequence[str], response: str, out: str, row_id: str, grid: Mapping[str, Sequence], share: float = 0.8, penalty: float = 0.0, seed: int = 17) -> tuple[Network, list[dict]]:
    """The network of the options with the least error on held-out rows, plus `penalty` for each weight; with all trials, best first.

    The error is the mean square over the response's variance. Ties go to the smaller network.
    """
    from .prep import split

    train, test = (x.cache() for x in split(df, row_id, share, seed))
    trials = []
    for values in itertools.product(*grid.values()):
        options = dict(zip(grid, values, strict=True))
        net = train_network(train, features, response, out, **options)
        r = net(test).agg(F.avg(F.pow(q(out) - q(response), F.lit(2))).alias("mse"), F.var_pop(q(response).cast("double")).alias("var")).first()
        size = sum(w.size + b.size for w, b in net.layers)
        error = (r["mse"] or 0.0) / (r["var"] or 1.0)
        trials.append({"options": options, "error": error, "weights": size, "score": error + penalty * size, "network": net})
    train.unpersist()
    test.unpersist()
    trials.sort(key=lambda t: (t["score"], t["weights"]))
    return trials[0]["network"], [{k: v for k, v in t.items() if k != "network"} for t in trials]


def interval_forward(layers, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the output over a box of scaled inputs."""
    for i, (w, b) in enumerate(layers):
        pos, neg = np.maximum(w, 0), np.minimum(w, 0)
        lo, hi = lo @ pos + hi @ neg + b, hi @ pos + lo @ neg + b
        if i < len(layers) - 1:
            lo, hi = np.maximum(lo, 0), np.maximum(hi, 0)
    return lo, hi
