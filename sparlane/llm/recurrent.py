"""Gated recurrent language model (operator 1): truncated backpropagation in numpy, class-factored softmax, carried state.

Tokens: words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, then one end. The `HEAD` most frequent training tokens have
their own outputs, in classes of like frequency; all others share the class `rest`, inside which a token has the smoothed
share of its count, so that every token has a probability and they sum to one.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import TOKEN_BYTES, Table, ragged, slices, text_bytes, words
from .language import held_out
from .shared import mapped, tree_total, written

#: Own outputs, units, words of a class, most words whose counts every task holds.
HEAD, UNITS, CLASS, COMMON = 2048, 16, 45, 1 << 19
#: Texts side by side in training and in scoring, steps of a window, averaging rounds, step size.
LANES, WIDE, WINDOW, ROUNDS, RATE = 192, 768, 24, 2, 0.03
#: Tokens of a step at least, and tokens that a task scores and learns at a time: long texts then share their windows with more others.
BATCH, PART, TEACH = 3_000, 800_000, 1_600_000
END = np.uint64(0x656E64)
#: Logits up to which exponentials are taken as they are.
FAR = 60
SMOOTH = 0.1


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and their offsets."""
    data, off = text_bytes(texts)
    _, _, h, woff = words(data, off, TOKEN_BYTES)
    n = np.diff(woff) + 1
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.full(int(at[-1]), END, np.uint64)
    keep = np.ones(out.size, bool)
    keep[at[1:] - 1] = False
    out[keep] = h
    return out, at


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, c = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(c, first)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(h, c): hash and count of every token of the texts, summed in each task before the shuffle."""

    def run(batches):
        held, size = [], 0

        def out():
            h, c = _merged(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

        for b in slices(batches, "text"):
            h, c = np.unique(tokens(b.column(0))[0], return_counts=True)
            held.append((h, c.astype(np.int64)))
            size += h.size
            if size > 1_200_000:
                one = _merged(held)
                held[:], size = [one], one[0].size
                if size > 900_000:
                    yield out()
                    size = 0
        if held:
            yield out()

    return mapped(docs.select("text"), run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    head: np.ndarray  # hashes, most frequent first
    head_count: np.ndarray
    common: np.ndarray  # hashes and counts of the words that every task knows, the head among them
    common_count: np.ndarray
    total: int
    distinct: int

    @property
    def rest(self) -> float:
        """Weight of the tokens outside the head, the unknown one among them."""
        return self.total - float(self.head_count.sum()) + SMOOTH * (self.distinct - self.head.size + 1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least power of two that at most COMMON words reach, so that what is collected is bounded
    reach = counts.agg(*[F.count_if(F.col("c") >= (1 << i)) for i in range(48)]).first()
    least = next(1 << i for i in range(48) if (reach[i] or 0) <= COMMON)
    pick = lambda df: (lambda t: (t["h"].to_numpy().view(np.uint64), t["c"].to_numpy()))(df.toArrow().combine_chunks())
    head = pick(counts.orderBy(F.desc("c"), "h").limit(HEAD))
    common = pick(counts.where(F.col("c") >= least))
    return Vocabulary(*(np.array(x) for x in (*head, *common)), int(total), int(distinct))


def _softmax(a: np.ndarray, w: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each row's goal, and the rows' sums; the logits `a` become their exponentials.

    States are within -1 and 1, so the weights `w` (their last row is the bias) bound the logits: rows need their own shift only where these are far from 0.
    """
    reach, bias = np.abs(w[..., :-1, :]).sum(-2), w[..., -1, :]
    if (bias + reach).max(initial=0) > FAR or (bias - reach).max(-1).min(initial=0) < -FAR:
        a -= a.max(1, keepdims=True, initial=-np.inf)
    own = a[np.arange(goal.size), goal]
    np.exp(a, out=a)
    total = a @ np.ones(a.shape[1], np.float32)
    return own - np.log(total), total


class Network:
    """Parameters in one flat float32 array; `emb` holds the input part of the gates by token, biases included."""

    def __init__(self, vocab: Vocabulary, flat: np.ndarray | None = None, seed: int = 3):
        k, h = vocab.head.size, UNITS
        self.k, self.classes = k, -(-k // CLASS)
        shapes = {"emb": (k + 2, 3 * h), "u": (h, 3 * h), "wc": (h, self.classes + 1), "bc": (self.classes + 1,), "wv": (self.classes, h, CLASS), "bv": (self.classes, CLASS)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        fresh = flat is None
        self.flat = np.zeros(size, np.float32) if fresh else flat.astype(np.float32)
        self.p, at = {}, 0
        for name, s in shapes.items():
            n = int(np.prod(s))
            self.p[name] = self.flat[at : at + n].reshape(s)
            at += n
        self.slots = np.zeros((self.classes, CLASS), np.float32)
        self.slots.reshape(-1)[k:] = -1e9
        if fresh:
            rng = np.random.default_rng(seed)
            self.p["emb"][:] = rng.normal(0, 0.3, shapes["emb"])
            self.p["u"][:] = rng.normal(0, h**-0.5, shapes["u"])
            self.p["wc"][:] = rng.normal(0, 0.02, shapes["wc"])
            self.p["wv"][:] = rng.normal(0, 0.02, shapes["wv"])
            weight = np.zeros(self.classes * CLASS)
            weight[:k] = vocab.head_count
            weight = weight.reshape(self.classes, CLASS)
            mass = np.append(weight.sum(1), vocab.rest)
            self.p["bc"][:] = np.log(np.maximum(mass, 1e-9) / mass.sum())
            self.p["bv"][:] = np.log(np.maximum(weight, 1e-9) / np.maximum(weight.sum(1, keepdims=True), 1e-9))

    def steps(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
        """States after each input of a window (steps x lanes); where `fresh`, the state begins at zero. On demand what `back` needs, by step."""
        p, n = self.p, UNITS
        u2, u1 = np.ascontiguousarray(p["u"][:, : 2 * n]), np.ascontiguousarray(p["u"][:, 2 * n :])
        out = np.empty((*ids.shape, n), np.float32)
        kept = tuple(np.empty((*ids.shape, w), np.float32) for w in (n, 2 * n, n, n)) if keep else ()
        for t in range(ids.shape[0]):
            if fresh[t].any():
                h = h * ~fresh[t][:, None]
            x = np.take(p["emb"], ids[t], 0)
            a = np.matmul(h, u2, out=kept[1][t] if keep else None)
            a += x[:, : 2 * n]
            np.negative(a, out=a)
            np.exp(a, out=a)
            a += 1
            np.reciprocal(a, out=a)
            r, z = a[:, :n], a[:, n:]
            rh = np.multiply(r, h, out=kept[2][t] if keep else None)
            c = np.matmul(rh, u1, out=kept[3][t] if keep else None)
            c += x[:, 2 * n :]
            np.tanh(c, out=c)
            if keep:
                kept[0][t] = h
            h = np.subtract(h, c, out=out[t])
            h *= z
            h += c
        return out, h, kept

    def outputs(self, s: np.ndarray, target: np.ndarray, grad: bool):
        """Natural log probability of each target (k: the class of the rest), and on demand the loss's gradients.

        Rows stand by class inside, with a one behind each state for the biases, so the words of a class are a slice.
        """
        p, k, n = self.p, self.k, UNITS
        cls = np.where(target < k, target // CLASS, self.classes).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        cls = cls[order].astype(np.int64)
        edge = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        own = [(c, slice(edge[c], edge[c + 1])) for c in range(self.classes) if edge[c] < edge[c + 1]]
        state, known = np.ones((target.size, n + 1), np.float32), edge[-1]
        state[:, :n] = s[order]
        wc = np.concatenate([p["wc"], p["bc"][None]])
        wv = np.concatenate([p["wv"], (p["bv"] + self.slots)[:, None]], 1)
        e, f = state @ wc, np.empty((known, CLASS), np.float32)
        for c, at in own:
            np.matmul(state[at], wv[c], out=f[at])
        logp, total = _softmax(e, wc, cls)
        word = target[order[:known]] - cls[:known] * CLASS
        more, inner = _softmax(f, wv, word)
        logp[:known] += more
        out = np.empty_like(logp)
        out[order] = logp
        if not grad:
            return out, {}, None
        for x, of, hit in ((e, total, cls), (f, inner, word)):
            x *= (1 / of)[:, None]
            x[np.arange(hit.size), hit] -= 1
        gc, gv = state.T @ e, np.zeros_like(wv)
        d = e @ p["wc"].T
        for c, at in own:
            gv[c] = state[at].T @ f[at]
            d[at] += f[at] @ p["wv"][c].T
        ds = np.empty_like(d)
        ds[order] = d
        return out, {"wc": gc[:n], "bc": gc[n], "wv": gv[:, :n], "bv": gv[:, n]}, ds

    def back(self, fresh: np.ndarray, kept: tuple, ds: np.ndarray, g: dict) -> np.ndarray:
        """Backpropagation through one window; the state before it is taken as given. Gives the gradient of each input's gates."""
        n = UNITS
        u2, u1 = (np.ascontiguousarray(x.T) for x in (self.p["u"][:, : 2 * n], self.p["u"][:, 2 * n :]))
        h, a, rh, c = kept
        r, z = a[..., :n].copy(), a[..., n:].copy()
        # what the gradients of the state, of the reset state and of the state again are multiplied by, for all steps at once
        to_c, to_r, to_z = (1 - z) * (1 - c * c), h * r * (1 - r), (h - c) * z * (1 - z)
        dx, dh = np.empty((*fresh.shape, 3 * n), np.float32), np.zeros_like(ds[0])
        some = fresh.any(1)
        for t in range(fresh.shape[0] - 1, -1, -1):
            dh += ds[t]
            dc = dh * to_c[t]
            drh = dc @ u1
            np.multiply(drh, to_r[t], out=dx[t, :, :n])
            np.multiply(dh, to_z[t], out=dx[t, :, n : 2 * n])
            dx[t, :, 2 * n :] = dc
            dh *= z[t]
            drh *= r[t]
            dh += drh
            dh += dx[t, :, : 2 * n] @ u2
            if some[t]:
                dh *= ~fresh[t][:, None]
        dx = dx.reshape(-1, 3 * n)
        du = np.concatenate([h.reshape(-1, n).T @ dx[:, : 2 * n], rh.reshape(-1, n).T @ dx[:, 2 * n :]], 1)
        g["u"] = g["u"] + du if "u" in g else du
        return dx

    def inputs(self, ids: np.ndarray, dx: np.ndarray, g: dict) -> None:
        """Gradient of the inputs' table from that of each input's gates."""
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) > 0]))
        g["emb"] = np.zeros_like(self.p["emb"])
        g["emb"][ids[order][first]] = np.add.reduceat(dx[order], first, 0)


class Lanes:
    """Texts dealt to lanes, the longest first to the emptiest lane; the fullest lane is the leftmost.

    Only the tokens themselves are held, in the order of their lanes: a window's arrays are made when it is read, so that one long text
    beside many short ones takes no more than its own length.
    """

    def __init__(self, target: np.ndarray, off: np.ndarray, lanes: int, k: int):
        n = np.diff(off)
        lanes = max(1, min(lanes, n.size))
        heap, place = [(0, i) for i in range(lanes)], np.empty(n.size, np.int64)
        start = np.empty(n.size, np.int64)
        for d in np.argsort(-n, kind="stable").tolist():
            used, lane = heapq.heappop(heap)
            place[d], start[d] = lane, used
            heapq.heappush(heap, (used + int(n[d]), lane))
        load = np.zeros(lanes, np.int64)
        for used, lane in heap:
            load[lane] = used
        rank = np.empty(lanes, np.int64)
        rank[np.argsort(-load, kind="stable")] = np.arange(lanes)
        order = np.lexsort((start, rank[place]))
        at = ragged(off[:-1][order], n[order])
        begin = np.zeros(target.size, bool)
        begin[off[:-1]] = True
        prev = np.concatenate([[k + 1], target[:-1]])
        prev[begin] = k + 1
        self.size, self.none = lanes, k + 1
        self.load = np.sort(load)[::-1]
        self.first = np.cumsum(self.load) - self.load
        self.target, self.input, self.begin, self.doc = target[at].astype(np.int32), prev[at].astype(np.int32), begin[at], np.repeat(order, n[order]).astype(np.int32)
        self.active = np.searchsorted(-self.load, -np.arange(1, int(self.load[0]) + 1), side="right")

    def window(self, lo: int, hi: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Steps x lanes of targets (-1: none), inputs, document numbers, begins."""
        step = np.arange(lo, hi)[:, None]
        if hi <= self.load[n - 1]:  # no lane ends in it
            at = step + self.first[:n]
            return self.target[at], self.input[at], self.doc[at], self.begin[at]
        there = step < self.load[:n]
        at = np.where(there, step + self.first[:n], 0)
        return np.where(there, self.target[at], np.int32(-1)), np.where(there, self.input[at], np.int32(self.none)), np.where(there, self.doc[at], np.int32(-1)), there & self.begin[at]


def _windows(active: np.ndarray, size: int):
    """Ranges of steps of one number of lanes, at most `size` long."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(active)) + 1, [active.size]])
    if edge.size > active.size // 8:  # lanes end all the time: keep windows long and let ended lanes idle
        edge = np.arange(0, active.size + size, size)
        edge[-1] = active.size
        edge = np.unique(edge)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        for at in range(lo, hi, size):
            yield at, min(hi, at + size), int(active[at])


def score_texts(net: Network, target: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each whole text, its state carried through all windows."""
    out = np.zeros(off.size - 1)
    lanes = Lanes(target, off, WIDE, net.k)
    h = np.zeros((lanes.size, UNITS), np.float32)
    held: list[tuple] = []

    def flush():
        s, goal, own = (np.concatenate(v) for v in zip(*held, strict=True))
        held.clear()
        out[:] += np.bincount(own, weights=net.outputs(s, goal, False)[0], minlength=out.size)

    for lo, hi, n in _windows(lanes.active, WINDOW):
        t, x, who, new = lanes.window(lo, hi, n)
        s, h, _ = net.steps(x, new, h[:n], False)
        use = np.flatnonzero(t.ravel() >= 0)
        held.append((s.reshape(-1, UNITS)[use], t.ravel()[use], who.ravel()[use]))
        if sum(v[1].size for v in held) >= BATCH:
            flush()
    if held:
        flush()
    return out


class Learner:
    """Adam over windows of the texts it is given, in turn. A step takes the gradient of all windows since the last one, `BATCH` tokens or more."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.n, self.seen = net, rate, 0, 0
        self.m, self.v = np.zeros_like(net.flat), np.zeros_like(net.flat)
        self.grad, self.room, self.square = (np.zeros_like(net.flat) for _ in range(3))
        self.held: list[tuple] = []

    def learn(self, target: np.ndarray, off: np.ndarray) -> None:
        net = self.net
        lanes = Lanes(target, off, LANES, net.k)
        h = np.zeros((lanes.size, UNITS), np.float32)
        for lo, hi, n in _windows(lanes.active, WINDOW):
            t, x, _, new = lanes.window(lo, hi, n)
            s, h, kept = net.steps(x, new, h[:n], True)
            goal = t.ravel()
            use = np.flatnonzero(goal >= 0)
            self.held.append((s.reshape(-1, UNITS)[use], goal[use], use, x, new, kept))
            if sum(v[1].size for v in self.held) >= BATCH:
                self.taught()
        if self.held:
            self.taught()
        self.seen += target.size

    def taught(self) -> None:
        """Outputs, loss and gradient of the held windows, and one step."""
        goal = np.concatenate([v[1] for v in self.held])
        _, g, d = self.net.outputs(np.concatenate([v[0] for v in self.held]), goal, True)
        at, ids, dx = 0, [], []
        for _, own, use, x, new, kept in self.held:
            ds = np.zeros((x.size, UNITS), np.float32)
            ds[use] = d[at : at + own.size]
            at += own.size
            dx.append(self.net.back(new, kept, ds.reshape(*x.shape, UNITS), g))
            ids.append(x.ravel())
        self.net.inputs(np.concatenate(ids), np.concatenate(dx), g)
        self.held.clear()
        self.step(g, max(1, goal.size))

    def step(self, g: dict, n: int) -> None:
        at = 0
        for name, p in self.net.p.items():
            self.grad[at : at + p.size] = g[name].ravel()
            at += p.size
        grad, room = self.grad, self.room
        grad /= n
        norm = float(np.sqrt(grad @ grad))
        if norm > 1:
            grad /= norm
        self.n += 1
        for mean, new, share in ((self.m, grad, 0.1), (self.v, np.multiply(grad, grad, out=self.square), 0.01)):
            np.subtract(new, mean, out=room)
            room *= share
            mean += room
        np.sqrt(self.v, out=room)
        room *= (1 - 0.99**self.n) ** -0.5
        room += 1e-6
        np.divide(self.m, room, out=room)
        room *= self.rate / (1 + self.n / 400) / (1 - 0.9**self.n)
        self.net.flat -= room


def _parts(batches, prepare, most: int = PART):
    """Lists of what `prepare` makes of (batch, token hashes, offsets), for about `most` tokens; a longer text comes alone."""
    held, size = [], 0
    for b in slices(batches, "text"):
        h, off = tokens(b.column(b.schema.get_field_index("text")))
        if held and h.size >= most:
            yield held
            held, size = [], 0
        held.append(prepare(b, h, off))
        size += h.size
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    base = np.cumsum([0] + [x.size for x, _ in parts])
    return np.concatenate([x for x, _ in parts]), np.concatenate([[0], *(off[1:] + k for (_, off), k in zip(parts, base, strict=False))])


def _targets(table: Table, h: np.ndarray, k: int) -> np.ndarray:
    at = table.find(h)
    at[at < 0] = k
    return at


def train(docs: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """Parameters after `ROUNDS` rounds. Each round's share of the texts (by a hash) is learned in all partitions apart,
    from the same start; then the parameters are averaged by tokens, in a tree of partitions."""
    flat = Network(vocab).flat
    for k in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast((vocab, flat))
        rate = RATE / (1 + k)

        def run(batches, shared=shared, rate=rate):
            vocab, flat = shared.value
            net = Network(vocab, flat.copy())
            table = Table(12)
            table.add(vocab.head, np.arange(vocab.head.size, dtype=np.int32))
            learner = Learner(net, rate)
            for held in _parts(batches, lambda b, h, off: (_targets(table, h, net.k), off), TEACH):
                learner.learn(*_joined(held))
            if learner.seen:
                blob = np.append(net.flat.astype(np.float64) * learner.seen, learner.seen)
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([blob.tobytes()], pa.binary())], names=["key", "blob"])

        share = docs.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k).select("text")
        total = tree_total(mapped(share, run, "key long, blob binary"), np.float64)
        if total:
            flat = (total[0][:-1] / total[0][-1]).astype(np.float32)
    return flat


def score(docs: DataFrame, vocab: Vocabulary, flat: np.ndarray, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of (doc_id, text, held_out).

    Words that not every task knows are joined with their counts by hash.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocab, flat))

    def run(batches):
        vocab, flat = shared.value
        net = Network(vocab, flat)
        head, common = Table(12), Table(20)
        head.add(vocab.head, np.arange(vocab.head.size, dtype=np.int32))
        common.add(vocab.common, np.arange(vocab.common.size, dtype=np.int32))
        logs = np.append(np.log10(vocab.common_count + SMOOTH), 0.0)
        uid = TaskContext.get().partitionId() << 40

        def prepare(b, h, off):
            n = off.size - 1
            target, at = _targets(head, h, net.k), common.find(h)
            doc, value, out = np.repeat(np.arange(n), np.diff(off)), logs[at], target == net.k
            s = lambda w: np.bincount(doc, weights=w, minlength=n)
            rare = np.flatnonzero(at < 0)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, off).astype(np.int32)), pa.array(h[rare].view(np.int64)))
            return target, off, b.column(0), b.column(1), s(at >= 0).astype(np.int64), s(value), s(value * out), s(out).astype(np.int64), lists

        for held in _parts(batches, prepare):
            model = score_texts(net, *_joined([x[:2] for x in held])) / np.log(10)
            col = lambda i, held=held: np.concatenate([x[i] for x in held])
            n = np.concatenate([np.diff(x[1]) for x in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid + np.arange(n.size)), *(pa.concat_arrays([x[i] for x in held]) for i in (2, 3)), pa.array(n), pa.array(col(4)), pa.array(col(5)), pa.array(col(6) + model), pa.array(col(7)), pa.concat_arrays([x[8] for x in held])],
                names=["uid", "doc_id", "held_out", "n_tokens", "known", "base", "model", "n_rest", "rare"],
            )
            uid += n.size

    rows = written(mapped(docs.select(F.col("doc_id").cast("long"), "held_out", "text"), run, "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, n_rest long, rare array<long>"), "scores")
    rare = rows.select("uid", F.explode("rare").alias("h")).groupBy("h", "uid").agg(F.count("*").alias("n")).join(counts, "h", "left")
    extra = rare.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"))
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    whole = float(np.log10(vocab.total + SMOOTH * (vocab.distinct + 1)))
    rest = float(np.log10(vocab.rest))
    return rows.join(extra, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + seen).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("model") + more - F.col("n_rest") * F.lit(rest)).alias("score"),
    )


def language_model(docs: DataFrame) -> DataFrame:
    """Train outside the held-out tenth and score all rows of (doc_id, text).

    A null text is empty: its end alone is scored. A null doc_id counts as the empty text for the split. Repeated rows are
    scored and counted each. No training rows: every token has the unigram share 0.1 / 0.1, so both scores are 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(10, 0).alias("held_out"))
    learn = rows.where(~F.col("held_out"))
    counts = written(count_tokens(learn), "counts")
    vocab = vocabulary(counts)
    flat = train(learn, vocab) if vocab.total else Network(vocab).flat
    return score(rows, vocab, flat, counts)
