"""Exact substring dedup over bytes by suffix sorting (operator 4).

Two places that share a string of `length` bytes share its minimizer: the `GRAM`-byte string in it with the least hash.
Such places (anchors) are dealt to buckets by that hash, so equal strings meet. Anchors with equal bytes on both sides as
far as a string can reach need no more than their hashes (64 bits of the string around, 40 bits beside the bucket of the anchor); of the others the bytes are fetched, and the suffixes from the
anchor rightwards and leftwards are ordered by deep-shallow sorting. Neighbours' common prefixes then tell which strings
through the anchor are equal, and the least document of each.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mix, slices, text_bytes
from .shared import mapped, written

LENGTH, GRAM = 50, 16
#: Bytes of text of which one bucket gets the anchors; anchors that a task gathers before it sends them; bytes compared in the shallow sort.
BUCKET_BYTES, HELD, SHALLOW = 8 << 20, 3_000_000, 16
#: doc_ids with several texts up to which only their rows get tags of full width; beyond, all rows do.
SHARED_IDS = 1 << 18
_ONE, _BASE = np.uint64(0xBF58476D1CE4E5B9), 0x9E3779B97F4A7C15


def _rolled(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k values in a row, from those of powers of two."""
    cur, p, n, out, m = (x + np.uint64(1)) * _ONE, _BASE, 1, None, 0
    while True:
        if k & n:
            if out is None:
                out, m = cur, n
            else:
                size = max(0, x.size - m - n + 1)
                out, m = out[:size] * np.uint64(p) + cur[m : m + size], m + n
        if n * 2 > k:
            return mix(out, 3)
        size = max(0, cur.size - n)
        cur, p, n = cur[:size] * np.uint64(p) + cur[n : n + size], p * p & (1 << 64) - 1, n * 2


def _slid(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each w values in a row."""
    n = 1
    while n * 2 <= w:
        x, n = f(x[:-n], x[n:]), n * 2
    return f(x[: x.size - (w - n)], x[w - n :]) if n < w else x


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, place, hash of the anchor, and hash of all bytes that strings through it reach, with the text's ends marked."""
    n, pad, w = np.diff(off), length, length - gram + 1
    shift = np.arange(1, n.size + 1) * pad
    x = np.full(data.size + pad * (n.size + 1), 256, np.uint64)
    at = np.arange(data.size) + np.repeat(shift, n)
    x[at] = data
    real = np.zeros(x.size + 1, np.int32)
    real[1:] = np.cumsum(x < 256)
    h = _rolled(x, gram)
    h[h == 0] = 1
    low = _slid(h, w, np.minimum)
    low[real[length : length + low.size] - real[: low.size] < length] = 0
    edge = np.zeros(w - 1, np.uint64)
    pick = np.flatnonzero(_slid(np.concatenate([edge, low, edge]), w, np.maximum)[: h.size] == h)
    around = _rolled(x, 2 * length - gram)
    doc = np.searchsorted(off[:-1] + shift, pick, side="right") - 1
    return doc, pick - shift[doc] - off[:-1][doc], h[pick], around[pick - (length - gram)]


def _packed(**arrays) -> bytes:
    """`tag` goes byte by byte, as most tags have two bytes and zeros."""
    if "tag" in arrays:
        arrays["tag"] = np.ascontiguousarray(np.ascontiguousarray(arrays["tag"]).view(np.uint8).reshape(-1, 8).T)
    return zlib.compress(b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays.values()), 1)


def _opened(blob: bytes, kinds: str) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(blob), 0, []
    for kind in kinds.split():
        size = int(np.frombuffer(raw, np.int64, 1, at)[0])
        if kind == "tag":
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at + 8).reshape(8, -1).T).view(np.int64).ravel())
        else:
            out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def _sent(doc: np.ndarray, tag: np.ndarray, place: np.ndarray, h: np.ndarray, mask: np.ndarray, groups: int):
    """Answers for documents as (group, blob) pairs."""
    g = _group(doc, tag, groups)
    order = np.lexsort((place, tag, doc, g))
    edge = np.searchsorted(g[order], np.arange(groups + 1))
    for k in np.flatnonzero(np.diff(edge)).tolist():
        i = order[edge[k] : edge[k + 1]]
        yield k, _packed(doc=np.diff(doc[i], prepend=0), tag=tag[i], place=place[i].astype(np.int32), h=h[i], mask=mask[i])


def _group(doc: np.ndarray, tag: np.ndarray, groups: int) -> np.ndarray:
    """As `grp` in `repeats`; the tag is a hash, so that any numbering of documents spreads."""
    return (doc ^ tag) % groups


_WHOLE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _find(docs: DataFrame, buckets: int, groups: int, length: int, gram: int) -> DataFrame:
    """(bucket, kind, group, blob): kind 0 anchors, kind 1 answers that a task could give alone."""

    def flush(held):
        doc, tag, place, h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, c, h))
        same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(same.size)))
        later = doc[order] > doc[order][first]
        done, rest = order[later], order[~later]
        rows = [(g * 7919 % buckets, 1, g, b) for g, b in _sent(doc[done], tag[done], place[done], np.zeros(done.size, np.uint64), np.full(done.size, _WHOLE), groups)]
        b = (h[rest] % np.uint64(buckets)).astype(np.int64)
        rest = rest[np.lexsort((place[rest], tag[rest], doc[rest], b))]
        b = (h[rest] % np.uint64(buckets)).astype(np.int64)
        edge = np.searchsorted(b, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edge)).tolist():
            i = rest[edge[k] : edge[k + 1]]
            short = (h[i] // np.uint64(buckets)).view(np.uint8).reshape(-1, 8)[:, :5]
            rows.append((k, 0, 0, _packed(doc=np.diff(doc[i], prepend=0), tag=tag[i], place=place[i].astype(np.int32), h=np.ascontiguousarray(short), c=c[i])))
        cols = zip(*rows, strict=True) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "grp", "blob"])

    def run(batches):
        held, n = [], 0
        for b in slices(batches, "text"):
            data, off = text_bytes(b.column(2))
            d, place, h, c = anchors(data, off, length, gram)
            held.append((b.column(0).to_numpy()[d], b.column(1).to_numpy()[d], place, h, c))
            n += d.size
            if n >= HELD:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return mapped(docs.select("doc", "tag", "text"), run, "bucket int, kind int, grp int, blob binary")


def _by(batches, key: str):
    """(key, batches' rows of it) of rows sorted by it."""
    now, held = None, []
    for b in batches:
        k = b.column(b.schema.get_field_index(key)).to_numpy()
        if not k.size:
            continue
        edge = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [k.size]])
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if held and k[lo] != now:
                yield now, held
                held = []
            now = int(k[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, held


def _answers(rows, names=("grp", "blob")) -> pa.RecordBatch:
    g, b = zip(*rows, strict=True) if rows else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(list(g), pa.int32()), pa.array(list(b), pa.binary())], names=list(names))


def _meet(found: DataFrame, buckets: int, groups: int) -> DataFrame:
    """(group, blob): anchors whose whole reach stands in an earlier document, and those whose bytes are needed."""

    def run(batches):
        for bucket, parts in _by(batches, "bucket"):
            rows, cols = [], []
            for p in parts:
                for kind, g, blob in zip(*(p.column(p.schema.get_field_index(c)).to_pylist() for c in ("kind", "grp", "blob")), strict=True):
                    if kind:
                        rows.append((g, blob))
                        continue
                    doc, tag, place, short, c = _opened(blob, "i8 tag i4 u1 u8")
                    h = np.zeros((doc.size, 8), np.uint8)
                    h[:, :5] = short.reshape(-1, 5)
                    cols.append((np.cumsum(doc), tag, place, h.view(np.uint64).ravel(), c))
            if cols:
                doc, tag, place, h, c = (np.concatenate(x) for x in zip(*cols, strict=True))
                order = np.lexsort((doc, c, h))
                doc, tag, place, h, c = doc[order], tag[order], place[order], h[order], c[order]
                new_h = np.concatenate([[True], h[1:] != h[:-1]])
                new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
                fh, fc = np.flatnonzero(new_h), np.flatnonzero(new_c)
                sh, sc = np.diff(np.append(fh, h.size)), np.diff(np.append(fc, h.size))
                whole = doc > np.repeat(doc[fc], sc)
                mixed = np.repeat((np.minimum.reduceat(doc, fh) < np.maximum.reduceat(doc, fh)) & (np.add.reduceat(new_c.astype(np.int64), fh) > 1), sh)
                ask = mixed & ~whole
                use = np.flatnonzero(whole | ask)
                label = np.where(whole[use], np.uint64(0), (h[use] * np.uint64(buckets) + np.uint64(bucket)) | np.uint64(1 << 63))
                rows.extend(_sent(doc[use], tag[use], place[use], label, np.where(whole[use], _WHOLE, np.uint64(0)), groups))
            yield _answers(rows)

    return mapped(found.repartition(buckets, "bucket").sortWithinPartitions("bucket"), run, "grp int, blob binary")


def _read(blobs: list) -> list[np.ndarray]:
    cols = []
    for blob in blobs:
        doc, tag, place, h, mask = _opened(blob, "i8 tag i4 u8 u8")
        cols.append((np.cumsum(doc), tag, place, h, mask))
    if not cols:
        return [np.zeros(0, k) for k in (np.int64, np.int64, np.int32, np.uint64, np.uint64)]
    out = [np.concatenate(x) for x in zip(*cols, strict=True)]
    order = np.lexsort((out[1], out[0]))
    return [x[order] for x in out]


def _with_texts(docs: DataFrame, answers: DataFrame, groups: int) -> DataFrame:
    """Answers and then documents of each group, in the order of groups."""
    a = answers.selectExpr("grp", "0 AS kind", "blob", "CAST(NULL AS long) AS doc", "CAST(NULL AS long) AS tag", "CAST(NULL AS long) AS doc_id", "CAST(NULL AS string) AS text")
    own = ["rest"] if "rest" in docs.columns else []
    d = docs.selectExpr("grp", "1 AS kind", "CAST(NULL AS binary) AS blob", "doc", "tag", "doc_id", "text", *own)
    if own:
        a = a.withColumn("rest", F.lit(None).cast(docs.schema["rest"].dataType))
    return a.union(d).repartition(groups, "grp").sortWithinPartitions("grp", "kind")


def _met(batches):
    """(document rows, answers for their group) slice by slice; the answers of a group come before its documents."""
    now, blobs, table = None, [], None
    for b in slices(batches, "text", 2 << 20):
        g, kind = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("grp", "kind"))
        edge = np.concatenate([[0], np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1, [g.size]])
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if g[lo] != now:
                now, blobs, table = int(g[lo]), [], None
            part = b.slice(lo, hi - lo)
            if kind[lo] == 0:
                blobs.extend(part.column(part.schema.get_field_index("blob")).to_pylist())
                continue
            if table is None:
                table, blobs = _read(blobs), []
            yield part, table


def _own(table, doc: int, tag: int) -> slice:
    lo, hi = (np.searchsorted(table[0], doc, side) for side in ("left", "right"))
    a, b = (np.searchsorted(table[1][lo:hi], tag, side) for side in ("left", "right"))
    return slice(lo + a, lo + b)


def _fetch(docs: DataFrame, answers: DataFrame, buckets: int, groups: int, length: int, gram: int) -> DataFrame:
    """(bucket, blob): the bytes around the anchors that are asked for."""
    left = length - gram

    def run(batches):
        for part, table in _met(batches):
            docs_, tags, text = (part.column(part.schema.get_field_index(c)) for c in ("doc", "tag", "text"))
            data, off = text_bytes(text)
            cols = []
            for i, (d, t) in enumerate(zip(docs_.to_pylist(), tags.to_pylist(), strict=True)):
                at = _own(table, d, t)
                ask = np.flatnonzero(table[3][at] > 0) + at.start
                if not ask.size:
                    continue
                body = data[off[i] : off[i + 1]]
                p = table[2][ask].astype(np.int64)
                idx = p[:, None] + np.arange(-left, length)
                inside = (idx >= 0) & (idx < body.size)
                cols.append((np.full(p.size, d), np.full(p.size, t, np.int64), p.astype(np.int32), table[3][ask], np.where(inside, body[np.clip(idx, 0, body.size - 1)], 0).astype(np.uint8), np.minimum(p, left).astype(np.uint8), np.minimum(body.size - p, length).astype(np.uint8)))
            if not cols:
                continue
            doc, tag, place, h, ctx, before, after = (np.concatenate(x) for x in zip(*cols, strict=True))
            b = (mix(h, 13) % np.uint64(buckets)).astype(np.int64)
            rows = []
            for k in np.unique(b).tolist():
                i = np.flatnonzero(b == k)
                rows.append((k, _packed(doc=doc[i], tag=tag[i], place=place[i], h=h[i], ctx=ctx[i], before=before[i], after=after[i])))
            yield _answers(rows, ("bucket", "blob"))

    return mapped(_with_texts(docs, answers, groups), run, "bucket int, blob binary")


class _Trie:
    """A blind trie of distinct strings: inner nodes hold only where their strings first differ."""

    def __init__(self, strings: list[bytes]):
        self.s, self.root = strings, None
        for i in range(len(strings)):
            self.add(i)

    def add(self, i: int) -> None:
        s = self.s[i]
        if self.root is None:
            self.root = i
            return
        node = self.root
        while not isinstance(node, int):  # blindly down to some leaf
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        o = self.s[node]
        at = next(k for k in range(len(s)) if s[k] != o[k])
        up, node = None, self.root
        while not isinstance(node, int) and node[0] < at:
            up, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == at:
            node[1][s[at]] = i
            return
        new = (at, {s[at]: i, o[at]: node})
        if up is None:
            self.root = new
        else:
            up[1][s[up[0]]] = new

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                todo.extend(node[1][k] for k in sorted(node[1], reverse=True))
        return out


def multikey_quicksort(chars: np.ndarray) -> np.ndarray:
    """The stable order of rows of characters; all ranges of a round are split at once.

    A range is split by a pivot at its depth into less, equal and greater; the equal part goes on at the next character.
    """
    m, levels = chars.shape
    order, rng = np.arange(m), np.random.default_rng(0)
    lo, size, depth = np.zeros(1, np.int64), np.array([m]), np.zeros(1, np.int64)
    while True:
        go = (size > 1) & (depth < levels)
        lo, size, depth = lo[go], size[go], depth[go]
        if not lo.size:
            return order
        start = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(lo - start, size)
        row = order[at]
        c = chars[row, np.repeat(depth, size)]
        pivot = np.repeat(c[start + rng.integers(0, size)], size)
        base, parts = lo, []
        for k, mine in enumerate((c < pivot, c == pivot, c > pivot)):
            n = np.add.reduceat(mine.astype(np.int64), start)
            order[(np.cumsum(mine) - 1 + np.repeat(base - (np.cumsum(n) - n), size))[mine]] = row[mine]
            parts.append((base, n, depth + (k == 1)))
            base = base + n
        lo, size, depth = (np.concatenate(x) for x in zip(*parts, strict=True))


def deep_shallow(rows: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The order of byte rows of one width.

    Multikey quicksort with eight bytes as a character and all ranges of a level at once, down to `shallow` bytes; then,
    of rows that still agree, equal ones stay together and a blind trie orders the distinct ones.
    """
    m, width = rows.shape
    full = -(-width // 8) * 8
    padded = np.zeros((m, full), np.uint8)
    padded[:, :width] = rows
    chars = padded.view(">u8").astype(np.uint64)
    levels = min(chars.shape[1], max(1, shallow // 8))
    order = multikey_quicksort(chars[:, :levels])
    same = (chars[order[1:], :levels] == chars[order[:-1], :levels]).all(1)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.diff(np.append(first, m))
    rest = chars[order, levels:]
    equal = np.logical_and.reduceat((rest == rest[np.repeat(first, size)]).all(1), first) if m and rest.shape[1] else np.ones(first.size, bool)
    for g in np.flatnonzero(~equal).tolist():
        part = order[first[g] : first[g] + size[g]]
        by: dict[bytes, list[int]] = {}
        for i in part.tolist():
            by.setdefault(rows[i].tobytes(), []).append(i)
        strings = list(by)
        order[first[g] : first[g] + size[g]] = [i for k in _Trie(strings).order() for i in by[strings[k]]]
    return order


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and the common prefix of each row in it with the one before (0 for the first)."""
    order = deep_shallow(rows)
    lcp = np.zeros(order.size, np.int64)
    if order.size > 1:
        diff = rows[order[1:]] != rows[order[:-1]]
        lcp[1:] = np.where(diff.any(1), diff.argmax(1), rows.shape[1])
    return order, lcp


def covered(ctx: np.ndarray, before: np.ndarray, after: np.ndarray, doc: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Bit o of each anchor: the string that begins o bytes before it also begins in a document with a smaller number."""
    left = length - gram
    ro, rl = _classes(np.ascontiguousarray(ctx[:, left:]))
    lo, ll = _classes(np.ascontiguousarray(ctx[:, :left][:, ::-1]))
    out = np.zeros(doc.size, np.uint64)
    rc, lc = np.empty(doc.size, np.int64), np.empty(doc.size, np.int64)
    for o in range(left + 1):
        rc[ro], lc[lo] = np.cumsum(rl < length - o), np.cumsum(ll < o) if o else 0
        use = np.flatnonzero((before >= o) & (after >= length - o))
        key = rc[use] * (doc.size + 2) + lc[use]
        order = np.lexsort((doc[use], key))
        k, d = key[order], doc[use][order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if k.size else np.zeros(0, int)
        least = np.repeat(d[first], np.diff(np.append(first, k.size)))
        out[use[order[d > least]]] |= np.uint64(1 << o)
    return out


def _sort(fetched: DataFrame, buckets: int, groups: int, length: int, gram: int) -> DataFrame:
    width = 2 * length - gram

    def run(batches):
        for _, parts in _by(batches, "bucket"):
            cols = []
            for p in parts:
                for blob in p.column(p.schema.get_field_index("blob")).to_pylist():
                    doc, tag, place, h, ctx, before, after = _opened(blob, "i8 tag i4 u8 u1 u1 u1")
                    cols.append((doc, tag, place, h, ctx.reshape(-1, width), before, after))
            doc, tag, place, h, ctx, before, after = (np.concatenate(x) for x in zip(*cols, strict=True))
            mask = covered(ctx, before, after, doc, length, gram)
            use = np.flatnonzero(mask)
            yield _answers(list(_sent(doc[use], tag[use], place[use], np.zeros(use.size, np.uint64), mask[use], groups)))

    return mapped(fetched.repartition(buckets, "bucket").sortWithinPartitions("bucket"), run, "grp int, blob binary")


def _runs(n: int, place: np.ndarray, mask: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs of a text of n bytes."""
    left = length - gram
    whole = mask == _WHOLE
    p = place[whole].astype(np.int64)
    lo, hi = [np.maximum(p - left, 0)], [np.minimum(p, n - length) + length]
    part = place[~whole].astype(np.int64)
    for o in range(left + 1):
        s = part[(mask[~whole] >> np.uint64(o)) & np.uint64(1) > 0] - o
        lo.append(s)
        hi.append(s + length)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.concatenate(lo), 1)
    np.add.at(edge, np.concatenate(hi), -1)
    inside = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    at = np.flatnonzero(inside[1:] != inside[:-1])
    return at[::2], at[1::2]


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans, kept_text, kept_sha256 of every row of (doc_id, text).

    `spans` are the maximal runs [from, to) of bytes covered by a `length`-byte string that also starts in a document with a
    smaller doc_id; strings overlap, never cross documents, and are judged on the input. `kept_sha256` is of the bytes
    outside the spans. `kept_text` is the text without them, where a character that a span cuts stays whole. A null text is
    empty; a null doc_id counts as greater than all others; rows with one doc_id remove nothing from each other. `carry` adds
    the other columns as the struct `rest`.
    """
    big = (1 << 63) - 1
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_")).alias("rest")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    rows = rows.select(F.coalesce("doc_id", F.lit(big)).alias("doc"), F.xxhash64("doc_id", "text").alias("tag"), "doc_id", "text", *["rest"] * carry)
    ids = written(rows.groupBy("doc").agg(F.sum(F.octet_length("text")).alias("size"), (F.min("tag") < F.max("tag")).alias("several")), "ids")
    size, several = ids.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_if("several")).first()
    buckets = groups = max(1, -(-size // BUCKET_BYTES))

    # (doc, tag) names a text: where a doc_id has one text only, any tag does, and a short one packs well
    if several <= SHARED_IDS:
        rows = rows.join(F.broadcast(ids.where("several").select("doc", "several")), "doc", "left")
        rows = rows.withColumn("tag", F.when(F.col("several"), F.col("tag")).otherwise(F.col("tag").bitwiseAND(F.lit(0xFFFF)))).drop("several")
    grouped = rows.withColumn("grp", F.pmod(F.col("doc").bitwiseXOR(F.col("tag")), F.lit(groups)).cast("int"))
    met = written(_meet(_find(rows, buckets, groups, length, gram), buckets, groups), "met")
    found = written(_sort(_fetch(grouped, met, buckets, groups, length, gram), buckets, groups, length, gram), "covered")

    def run(batches):
        for part, table in _met(batches):
            doc, tag, text = (part.column(part.schema.get_field_index(c)) for c in ("doc", "tag", "text"))
            data, off = text_bytes(text)
            spans, kept, sha = [], [], []
            for i, (d, t) in enumerate(zip(doc.to_pylist(), tag.to_pylist(), strict=True)):
                at = _own(table, d, t)
                body = data[off[i] : off[i + 1]]
                use = table[4][at] > 0
                lo, hi = _runs(body.size, table[2][at][use], table[4][at][use], length, gram) if use.any() else (np.zeros(0, int), np.zeros(0, int))
                spans.append([{"from": a, "to": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
                cut = np.ones(body.size, bool)
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    cut[a:b] = False
                sha.append(hashlib.sha256(body[cut].tobytes()).hexdigest())
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                    while a < b and body[a] & 0xC0 == 0x80:
                        cut[a] = True
                        a += 1
                    if b < body.size and body[b] & 0xC0 == 0x80:
                        b -= 1
                        while b > a and body[b] & 0xC0 == 0x80:
                            cut[b] = True
                            b -= 1
                        cut[b] = True
                kept.append(body[cut].tobytes().decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")), pa.array(np.diff(off)), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array(kept, pa.string()), pa.array(sha, pa.string()), *[part.column(part.schema.get_field_index("rest"))] * carry],
                names=["doc_id", "n_bytes", "spans", "kept_text", "kept_sha256", *["rest"] * carry],
            )

    schema = "doc_id long, n_bytes long, spans array<struct<from:int,to:int>>, kept_text string, kept_sha256 string"
    if carry:
        schema += f", rest {rows.schema['rest'].dataType.simpleString()}"
    return mapped(_with_texts(grouped, met.union(found), groups), run, schema)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with each text less its repeats, in all its columns; n_chars, if there, becomes the new length. A null text becomes empty."""
    r = repeats(docs, length, carry=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return r.select(*[(new[c] if c in new else F.col("rest").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of `repeats`."""
    r = repeats(docs, length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return r.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
