"""Quality scores by a factorisation machine (operator 6)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import WORD_BYTES, hash_runs, slices, text_bytes, words
from .language import held_out
from .shared import mapped

WORD_BITS, RANK, BINS = 14, 8, 12
#: Labelled rows that training reads at most (in expectation; rows are chosen by a hash of doc_id).
SAMPLE = 8192
_SETS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9), "line": (10,), "high": range(128, 256),
    "stop": b".,;:?'\"-()", "shout": b"!", "mark": b"#*&$%@^~=_+<>/\\", "bar": b"|[]{}",
}
_MEMBER = np.zeros((len(_SETS), 256), bool)
for _i, _s in enumerate(_SETS.values()):
    _MEMBER[_i, list(_s)] = True
N_STATS = len(_SETS) + 7
N_FEATURES = (1 << WORD_BITS) + N_STATS * (BINS + 2)


def statistics(data: np.ndarray, off: np.ndarray, word_hash: np.ndarray, word_off: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """Texts x statistics: shares of byte classes, word length, distinct words, repeated lines, sizes, and the metadata n_chars."""
    n = np.maximum(np.diff(off), 1)
    out = []
    kind = np.zeros(256, np.uint8)
    for i in range(len(_SETS)):
        kind[_MEMBER[i]] = i + 1
    k = kind[data].astype(np.int64) + np.repeat(np.arange(off.size - 1), np.diff(off)) * (len(_SETS) + 1)
    share = np.bincount(k, minlength=(off.size - 1) * (len(_SETS) + 1)).reshape(off.size - 1, -1) / n[:, None]
    out.extend(share[:, 1:].T)
    w = np.diff(word_off)
    doc = np.repeat(np.arange(off.size - 1), w)
    out.append(n / np.maximum(w, 1) / 20)
    order = np.lexsort((word_hash, doc))
    new = np.ones(order.size, bool)
    new[1:] = (word_hash[order][1:] != word_hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    out.append(np.bincount(doc[order], weights=new, minlength=off.size - 1) / np.maximum(w, 1))
    edge = np.zeros(data.size + 1, bool)
    edge[off[:-1]] = True
    edge[:-1][1:] |= data[:-1] == 10
    st = np.flatnonzero(edge[:-1])
    line_len = np.diff(np.append(st, data.size))
    lh = hash_runs(data, st, np.append(st[1:], data.size))
    ld = np.searchsorted(off, st, side="right") - 1
    lo = np.lexsort((lh, ld))
    first = np.ones(lo.size, bool)
    first[1:] = (lh[lo][1:] != lh[lo][:-1]) | (ld[lo][1:] != ld[lo][:-1])
    lines = np.bincount(ld, minlength=off.size - 1)
    out.append(1 - np.bincount(ld[lo], weights=first, minlength=off.size - 1) / np.maximum(lines, 1))
    out.append(np.log1p(np.bincount(ld, weights=line_len, minlength=off.size - 1) / np.maximum(lines, 1)) / 8)
    out.append(np.log1p(w) / 12)
    out.append(np.log1p(np.diff(off)) / 14)
    out.append(np.log1p(np.maximum(n_chars, 0)) / 14)
    return np.stack(out, 1).astype(np.float32)


@dataclass
class Machine:
    edges: np.ndarray  # statistics x BINS-1 cut points
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def features(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and weights, offsets of the texts into them, statistics. A text's word weights have the length 1."""
    data, off = text_bytes(b.column(b.schema.get_field_index("text")))
    _, _, h, woff = words(data, off, WORD_BYTES)
    doc = np.repeat(np.arange(off.size - 1), np.diff(woff))
    key, count = np.unique((doc << WORD_BITS) | (h & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64), return_counts=True)
    owner = key >> WORD_BITS
    x = np.sqrt(count.astype(np.float32))
    norm = np.sqrt(np.bincount(owner, weights=x * x, minlength=off.size - 1))
    x /= np.maximum(norm[owner], 1e-9).astype(np.float32)
    size = b.column(b.schema.get_field_index("n_chars"))
    given = size.cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
    stats = statistics(data, off, h, woff, np.where(given < 0, np.diff(off), given))
    return key & ((1 << WORD_BITS) - 1), x, np.searchsorted(owner, np.arange(off.size)), stats


def _rows(idx, x, at, stats, edges):
    """Adds to each text its statistics: a one-hot bin, the value itself and its square."""
    n, s = stats.shape
    base = (1 << WORD_BITS) + np.arange(s) * (BINS + 2)
    bins = (stats[:, :, None] > edges[None]).sum(2)
    si = np.concatenate([base + bins, np.broadcast_to(base + BINS, (n, s)), np.broadcast_to(base + BINS + 1, (n, s))], 1)
    sx = np.concatenate([np.ones((n, s), np.float32), stats, stats * stats], 1)
    w = np.diff(at)
    out_i, out_x = np.empty(idx.size + si.size, np.int64), np.empty(idx.size + si.size, np.float32)
    start = at[:-1] + np.arange(n) * si.shape[1]
    place = (start + w)[:, None] + np.arange(si.shape[1])
    free = np.ones(out_i.size, bool)
    free[place.ravel()] = False
    out_i[place], out_x[place] = si, sx
    out_i[free], out_x[free] = idx, x
    return out_i, out_x, start


def _forward(m: Machine, idx, x, start):
    """Bias, linear part and half of (square of sums - sum of squares) over the factors, in time linear in the features."""
    vx = m.factor[idx] * x[:, None]
    s = np.add.reduceat(vx, start, 0)
    pair = 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), start))
    return m.bias + np.add.reduceat(m.weight[idx] * x, start) + pair, s


def fit(rows: list, label: np.ndarray, steps: int = 1200, batch: int = 128, rate: float = 0.06, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Logistic loss with AdaGrad over (features, statistics) of texts in the given order, for 4 epochs and `steps` steps at least; no rows give the score 0.5."""
    rng = np.random.default_rng(seed)
    m = Machine(np.zeros((N_STATS, BINS - 1), np.float32), 0.0, np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.02, (N_FEATURES, RANK)).astype(np.float32))
    if not rows:
        m.factor[:] = 0
        return m
    stats = np.stack([r[2] for r in rows])
    m.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T.astype(np.float32)
    rate_p = min(max(float(label.mean()), 1e-3), 1 - 1e-3)
    m.bias = float(np.log(rate_p / (1 - rate_p)))
    gw, gv, gb = np.full(N_FEATURES, 1e-2, np.float32), np.full((N_FEATURES, RANK), 1e-2, np.float32), 1e-2
    for _ in range(max(4, -(-steps * batch // len(rows)))):
        turn = rng.permutation(len(rows))
        for lo in range(0, turn.size, batch):
            pick = turn[lo : lo + batch]
            at = np.concatenate([[0], np.cumsum([rows[i][0].size for i in pick])])
            idx, x, start = _rows(np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick]), at, stats[pick], m.edges)
            z, s = _forward(m, idx, x, start)
            d = ((1 / (1 + np.exp(-z)) - label[pick]) / pick.size).astype(np.float32)
            width = np.diff(np.append(start, idx.size))
            dd = np.repeat(d, width)
            gwx = dd * x
            gvx = gwx[:, None] * (np.repeat(s, width, 0) - m.factor[idx] * x[:, None])
            order = np.argsort(idx, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(idx[order]) > 0]))
            f = idx[order][first]
            dw = np.add.reduceat(gwx[order], first) + decay * m.weight[f]
            dv = np.add.reduceat(gvx[order], first, 0) + decay * m.factor[f]
            gw[f] += dw * dw * 100
            gv[f] += dv * dv * 100
            m.weight[f] -= rate * dw / np.sqrt(gw[f]) * 3
            m.factor[f] -= rate * dv / np.sqrt(gv[f])
            gb += float(d.sum()) ** 2 * 100
            m.bias -= rate * float(d.sum()) / gb**0.5
    return m


def _inputs(docs: DataFrame, *keep: str) -> DataFrame:
    """The `keep` columns, text and n_chars; a table without n_chars has nulls there."""
    size = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(*keep, F.col("text").cast("string").alias("text"), size.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """From the texts of at most about `sample` labelled ids (in expectation, chosen by a hash), one text of each.

    Null labels and ids are left out. Of an id with several labels the least counts, of one with several texts that of the least hash: a
    repeated id brings one row, and neither the broadcast ids nor what reaches the driver grows with its rows.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * sample / n))

    def run(batches):
        for b in slices(batches, "text"):
            idx, x, at, stats = features(b)
            cut = lambda a, t: pa.array([a[i:j].astype(t).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("quality")), cut(idx, np.uint16), cut(x, np.float32), pa.array([s.tobytes() for s in stats], pa.binary())], names=["doc_id", "quality", "idx", "x", "stats"])

    met = _inputs(docs, "doc_id").join(F.broadcast(known), "doc_id")
    rows = met.groupBy("doc_id").agg(F.min_by(F.struct("text", "n_chars", "quality"), F.struct(F.xxhash64("text"), "n_chars")).alias("r")).select("doc_id", "r.*")
    got = mapped(rows, run, "doc_id long, quality int, idx binary, x binary, stats binary").toArrow().to_pydict()
    order = sorted(range(len(got["doc_id"])), key=lambda i: (got["doc_id"][i], got["stats"][i], got["quality"][i]))
    return fit([(np.frombuffer(got["idx"][i], np.uint16).astype(np.int64), np.frombuffer(got["x"][i], np.float32), np.frombuffer(got["stats"][i], np.float32)) for i in order], np.array([float(got["quality"][i] > 0) for i in order]))


def score(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """The `keep` columns, score and predicted of every row of (text, n_chars). A null text is empty, a null n_chars its size in bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        m = shared.value
        for b in slices(batches, "text"):
            idx, x, at, stats = features(b)
            z, _ = _forward(m, *_rows(idx, x, at, stats, m.edges))
            p = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    rows = _inputs(docs, *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return mapped(rows, run, f"{schema}, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of all `docs`; labels are read outside the held-out fifth only.

    A null text is empty, and empty texts are scored by their statistics; a null n_chars (or none at all) is the text's size in bytes. A null doc_id has no label
    and is held out as the empty text is. Equal rows have equal scores; rows of one doc_id are scored each, and trained on as one (see
    `train`). Texts of any length are read whole, a long one alone. Without a usable label every score is 0.5; without rows there are none.
    Further columns are not read.
    """
    machine = train(docs, labels.where(~held_out(5, 0)))
    return score(docs.withColumn("held_out", held_out(5, 0)), machine, ("doc_id", "held_out"))
