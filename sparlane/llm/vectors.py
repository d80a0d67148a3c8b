"""Near-duplicate vectors by cross-polytope hashing (operator 2)."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import mix
from .shared import components, mapped, written

#: Hash tables, rotations whose codes are joined in a table, buckets that a vector looks into in each table.
TABLES, JOINED, PROBES = 8, 2, 4
#: Rows of a bucket that are compared at once; larger buckets are compared block by block.
BLOCK = 1024


@functools.lru_cache(16)
def _signs(width: int) -> np.ndarray:
    rng = np.random.default_rng(width)
    return rng.choice([-1.0, 1.0], (TABLES, JOINED, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def codes(x: np.ndarray) -> np.ndarray:
    """vectors x TABLES x PROBES bucket codes. The first is a vector's own: of each rotation the axis and sign of the
    largest component; the others take the second largest in one rotation or in both, least loss first."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    full = np.zeros((n, width))
    full[:, :d] = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = np.empty((n, TABLES, PROBES), np.int64)
    row = np.arange(n)
    for t in range(TABLES):
        axis, loss = [], []
        for k in range(JOINED):
            y = full
            for s in _signs(width)[t, k]:
                y = hadamard(y * s) / width**0.5
            two = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            two = np.take_along_axis(two, np.argsort(-np.abs(np.take_along_axis(y, two, 1)), axis=1, kind="stable"), 1)
            v = np.take_along_axis(y, two, 1)
            axis.append(two * 2 + (v < 0))
            loss.append(np.abs(v[:, 0]) - np.abs(v[:, 1]))
        a, b = axis
        size = 2 * width
        own, one, two, both = (a[row, i] * size + b[row, j] for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)))
        swap = loss[0] > loss[1]
        out[:, t] = np.stack([own, np.where(swap, two, one), np.where(swap, one, two), both], 1)
    return out


def _prepare(rows: DataFrame) -> DataFrame:
    """rid, vector (float64 bytes), codes, and the bucket keys; rows that can link only."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            arr = b.column(2)
            off = arr.offsets.to_numpy().astype(np.int64)
            flat = arr.flatten() if arr.null_count == 0 else arr.values.slice(off[0], off[-1] - off[0])
            val = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            off = off - off[0]
            n = np.diff(off)
            valid = arr.is_valid().to_numpy(zero_copy_only=False) & (n > 0)
            for d in np.unique(n[valid]):
                at = np.flatnonzero(valid & (n == d))
                x = val[off[at][:, None] + np.arange(d)]
                with np.errstate(over="ignore"):
                    norm = np.sqrt((x * x).sum(1))
                big = ~np.isfinite(norm) & np.isfinite(x).all(1)
                x[big] /= np.abs(x[big]).max(1, keepdims=True)
                tiny = (norm < 1e-150) & (np.abs(x).max(1) > 0)
                x[tiny] /= np.abs(x[tiny]).max(1, keepdims=True)
                good = np.isfinite(x).all(1) & (np.abs(x).max(1) > 0)
                x, at = x[good], at[good]
                if not at.size:
                    continue
                c = codes(x)
                label = b.column(1).take(pa.array(at)).to_numpy()
                base = mix(mix(label.astype(np.int64).view(np.uint64), 5) + np.uint64(d), 6)
                key = mix(base[:, None, None] + (c + (np.arange(TABLES, dtype=np.int64)[:, None] << 40)).view(np.uint64), 7).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in c], pa.binary()), pa.array(list(key.reshape(at.size, -1)), pa.list_(pa.int64()))],
                    names=["rid", "vector", "codes", "keys"],
                )

    whole = isinstance(rows.schema["label"].dataType, T.IntegralType)
    label = F.col("label").cast("long") if whole else F.xxhash64("label").alias("label")  # others by a 64-bit hash
    ready = rows.where("label IS NOT NULL AND embedding IS NOT NULL").select("rid", label, F.col("embedding").cast("array<double>"))
    return mapped(ready, run, "rid long, vector binary, codes binary, keys array<long>")


def _meet(ca: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of code sets: the first table in which the pair meets, and the least own code that it meets at there."""
    own_a, own_b = ca[:, :, :1], cb[:, :, :1]
    at_b, at_a = (ca == own_b).any(2), (cb == own_a).any(2)
    first = (at_a | at_b).argmax(1)
    row = np.arange(first.size)
    far = np.int64(1) << 62
    code = np.minimum(np.where(at_a[row, first], own_a[row, first, 0], far), np.where(at_b[row, first], own_b[row, first, 0], far))
    return first, code


def _compare(x, norm, own, code, rid, ia, ib, here, cut):
    """Of row pairs of a bucket: those that link, and of these whether the bucket is the one that counts them."""
    good = own[ia] | own[ib]
    ia, ib = ia[good], ib[good]
    good = np.einsum("ij,ij->i", x[ia], x[ib]) >= cut * norm[ia] * norm[ib]
    ia, ib = ia[good], ib[good]
    table, at = _meet(code[ia], code[ib])
    return ia, ib, (table == here[0][ia]) & (at == here[1][ia])


def _links(groups: DataFrame, cut: float) -> DataFrame:
    """(a, b, n): n > 0 counts links of a (b is null); n = 0 is a link a-b for the components."""

    def flush(rows: pa.Table):
        key, bi, bj = (rows[c].to_numpy() for c in ("key", "bi", "bj"))
        order = np.lexsort((bj, bi, key))
        rows = rows.take(pa.array(order))
        key, bi, bj = key[order], bi[order], bj[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, key.size))
        rid, own, block = rows["rid"].to_numpy(), rows["own"].to_numpy(zero_copy_only=False), rows["block"].to_numpy()
        spot = rows["at"].to_numpy()
        raw, width = rows["vector"].to_pylist(), np.array([len(v) for v in rows["vector"].to_pylist()]) // 8
        code = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.int64).reshape(-1, TABLES, PROBES)
        table, here_code = spot // PROBES, code.reshape(rid.size, -1)[np.arange(rid.size), spot]
        count, ea, eb = np.zeros(rid.size, np.int64), [], []
        for d in np.unique(width):
            x = np.zeros((rid.size, d))
            mine = np.flatnonzero(width == d)
            x[mine] = np.frombuffer(b"".join(raw[i] for i in mine), np.float64).reshape(-1, d)
            norm = np.sqrt((x * x).sum(1))
            use = np.flatnonzero(width[first] == d)
            small = use[size[use] <= 32]
            lot = np.cumsum(size[small] ** 2) // 200_000
            for k in np.unique(lot):
                g = small[lot == k]
                n = size[g]
                sq = np.repeat(np.arange(g.size), n * n)
                w = np.arange(sq.size) - np.repeat(np.cumsum(n * n) - n * n, n * n)
                ia, ib = first[g][sq] + w // n[sq], first[g][sq] + w % n[sq]
                ok = (ia < ib) & ((bi[ia] == bj[ia]) | (block[ia] != block[ib]))
                ia, ib, counts = _compare(x, norm, own, code, rid, ia[ok], ib[ok], (table, here_code), cut)
                np.add.at(count, ia[counts], 1)
                np.add.at(count, ib[counts], 1)
                ea.append(rid[ia[counts]])
                eb.append(rid[ib[counts]])
            for g in use[size[use] > 32].tolist():
                lo, hi = first[g], first[g] + size[g]
                label, last = np.arange(lo, hi), None
                link = x[lo:hi] @ x[lo:hi].T >= cut * np.outer(norm[lo:hi], norm[lo:hi])
                link &= own[lo:hi, None] | own[None, lo:hi]
                if bi[lo] != bj[lo]:
                    link &= block[lo:hi, None] != block[None, lo:hi]
                np.fill_diagonal(link, False)
                ia, ib = np.nonzero(np.triu(link))
                for at in range(0, ia.size, 100_000):
                    pa_, pb_ = ia[at : at + 100_000] + lo, ib[at : at + 100_000] + lo
                    tab, cod = _meet(code[pa_], code[pb_])
                    counts = (tab == table[lo]) & (cod == here_code[lo])
                    count += np.bincount(pa_[counts], minlength=rid.size) + np.bincount(pb_[counts], minlength=rid.size)
                link |= np.eye(size[g], dtype=bool)
                while last is None or (label != last).any():
                    last = label
                    label = np.where(link, label[None, :], hi).min(1)
                    label = label[label - lo]
                away = np.flatnonzero(label != np.arange(lo, hi))
                ea.append(rid[lo + away])
                eb.append(rid[label[away]])
        has = np.flatnonzero(count)
        a, b = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in (ea, eb))
        none = np.zeros(has.size, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([rid[has], a])), pa.array(np.concatenate([none, b]), mask=np.arange(has.size + a.size) < has.size), pa.array(np.concatenate([count[has], np.zeros(a.size, np.int64)]))],
            names=["a", "b", "n"],
        )

    def run(batches):
        """Rows come sorted by group; a group's rows are compared once they are all there."""
        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows < 8 * BLOCK:
                continue
            t = pa.concat_tables(held)
            g = [t[c].to_numpy() for c in ("key", "bi", "bj")]
            same = (g[0] == g[0][-1]) & (g[1] == g[1][-1]) & (g[2] == g[2][-1])
            cut_at = int(np.flatnonzero(same)[0])
            if cut_at:
                yield flush(t.slice(0, cut_at))
            held = [t.slice(cut_at)]
            rows = t.num_rows - cut_at
        if held:
            yield flush(pa.concat_tables(held))

    return mapped(groups, run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, cut: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Two rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is `cut`
    or more. A vector that is null, empty, zero or holds null or non-finite components links with nothing, nor do vectors of
    different lengths. Repeated rows are vectors of their own; a null vec_id counts links but never names a component unless
    nothing else is in it. Candidates are the pairs of which one's own bucket is among the other's probes in any table; a
    pair is compared in each such bucket and counted in the first. Buckets of over `BLOCK` rows are compared in pairs of blocks.
    """
    rows = written(vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label"), "vectors")
    ready = written(_prepare(rows), "hashed")
    probes = ready.select("rid", F.posexplode("keys").alias("p", "key")).select("rid", "key", (F.col("p") % PROBES == 0).alias("own"))
    full = probes.groupBy("key").agg(F.count("*").alias("size"), F.count_if("own").alias("owners")).where("size > 1 AND owners > 0")
    met = probes.join(full.select("key", "size"), "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rid", "key", "own", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    with_vectors = met.join(ready, "rid")
    at = (F.array_position("keys", F.col("key")) - 1).cast("int").alias("at")
    groups = with_vectors.select("key", "bi", "bj", "rid", "own", "block", at, "vector", "codes")
    found = written(_links(groups.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj"), cut), "links")
    n = found.where("n > 0").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n_links"))
    comp = components(found.where("n = 0").select("a", "b")).withColumnRenamed("node", "rid")
    out = rows.select("rid", "vec_id").join(n, "rid", "left").join(comp, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    names = out.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return out.join(names, "component").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))

