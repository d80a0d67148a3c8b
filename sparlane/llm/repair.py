"""Re-Pair compressed token-id shards (operator 5).

A shard file has rows (part, shard, before, first_doc, n_docs, n_tokens, payload); `before` counts the ids of the part's earlier
shards. The payload, little-endian:
  b"SLRP2\0", u8 bits of a symbol, u8 bytes of an expansion length, u8 bytes of a place, u32 base, u32 rules, u32 documents,
  u64 symbols, left and right symbol of each rule, expansion length of each rule, doc_ids (i64), null flags (u8), symbols before each
  document and after the last, ids before each document and after the last, symbols.
A row of symbols is their low 16 bits (u16 each) and then one row of packed bits for each bit above.
Symbols below `base` are ids; base+r is rule r, whose parts are ids or earlier rules. No rule crosses a document's end,
so any document, or any range of ids in it, is decoded from its own symbols alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import ragged, slices
from .shared import mapped, new_path, setting
from .tokens import default_path, encoder

_HEAD = struct.Struct("<6sBBBIIIQ")
_PLACE = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<u8"}
#: Text bytes of a shard, and most of a partition of shards.
SHARD_BYTES, PART_BYTES = 4 << 20, 256 << 20
_LENGTH = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)
#: A rule takes two symbols and an expansion length, and each of its places saves one symbol.
LEAST = 4


def _levels(count: np.ndarray) -> np.ndarray:
    """Bit lengths, of greater counts than the table's that of its last one and more."""
    small = count < _LENGTH.size
    return _LENGTH[count] if small.all() else np.where(small, _LENGTH[np.minimum(count, _LENGTH.size - 1)], np.frexp(count)[1]).astype(np.uint8)


def _batch(code: np.ndarray, most: int) -> np.ndarray:
    """Of pairs by falling count those that can be replaced together: no pair's left symbol is another's right one.

    Their places never overlap, so their counts hold until the last of them is replaced.
    """
    left, right, out = set(), set(), []
    for i, c in enumerate(code.tolist()):
        a, b = c >> 32, c & 0xFFFFFFFF
        if a in right or b in left or (a == b and (a in left or b in right)):
            continue
        left.add(a)
        right.add(b)
        out.append(i)
        if a == b:
            right.add(a)
            left.add(b)
        if len(out) == most:
            break
    return np.array(out, np.int64)


def grammar(ids: np.ndarray, doc_end: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, left and right parts of the rules, and the positions before which documents begin.

    Each round counts the pairs of the highest power of two that any pair inside a document may reach, takes those of them that
    do not share places (`_batch`), and replaces them from the left; in a run of one symbol every other pair. It ends when no pair
    occurs `least` times; if symbols need 17 bits then and the rules beyond 16 bits do not pay for that, those are left out.

    `level` is the bit length of a pair's count (or of a bound above it) when it was last counted, by its left symbol; a pair's
    count only falls until it is replaced, so pairs below the level at hand need no count. Symbols keep their positions and are
    chained by `after` and `before`, so a round costs the places that it counts and replaces; all levels are scanned only when those of the highest one are used up.
    """
    n = ids.size
    seq, ends = ids.astype(np.uint32), doc_end.astype(np.int64)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    begins, dead = np.zeros(n + 1, bool), np.zeros(n, bool)
    begins[ends] = True
    left, right = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    rules, size, narrow = 0, n, None
    level = np.zeros(n, np.uint8)

    def bound(at):
        """Levels of pairs all of whose places are at hand, by counts of their hashes."""
        bits = min(22, max(10, int(at.size).bit_length()))
        spot = ((seq[at] * np.uint32(2654435761) + seq[after[at]] * np.uint32(2246822519)) * np.uint32(3266489917)) >> np.uint32(32 - bits)
        return _levels(np.bincount(spot, minlength=1 << bits)[spot])

    fresh = np.flatnonzero(~begins[1:])  # no pair goes over a document's end
    known: list[list[np.ndarray]] = [[] for _ in range(65)]  # places by level, from `floor` on, with some that have left it
    floor = 65

    def found(at):
        now = level[at]
        for x in range(floor, int(now.max(initial=0)) + 1):
            if (here := at[now == x]).size:
                known[x].append(here)

    while True:
        level[fresh] = bound(fresh)
        found(fresh)
        top, at = 64, fresh[:0]
        while top >= floor and not at.size:
            if known[top]:
                at = np.concatenate(known[top])
                at = np.sort(at[level[at] == top], kind="stable")
                at = at[np.diff(at, prepend=-1) > 0]
                known[top] = []
            top -= not at.size
        if not at.size:
            floor = top = int(level.max(initial=0))
            if 1 << top <= least:
                break
            at = np.flatnonzero(level == top)
        fresh = at[:0]
        code = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[after[at]]
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        pairs, times = code[first], np.diff(np.append(first, code.size))
        which = np.empty(at.size, np.int64)
        which[order] = np.repeat(np.arange(first.size), times)
        level[at] = _levels(times)[which]
        found(at)
        ok = np.flatnonzero(times >= max(least, 1 << top - 1))
        use = ok[np.argsort(-times[ok], kind="stable")]
        use = use[_batch(pairs[use], 1 << 14)]
        if not use.size:
            if 1 << top - 1 <= least:
                level[at] = 0  # counts of this level, but under `least`
            continue
        number = np.full(pairs.size, -1, np.int64)
        number[use] = np.arange(use.size)
        own = number[which]
        hit, own = at[own >= 0], own[own >= 0]
        run = np.concatenate([[True], after[hit[:-1]] != hit[1:]])
        starts = np.flatnonzero(run)
        nth = np.arange(hit.size) - np.repeat(starts, np.diff(np.append(starts, hit.size)))
        real = np.bincount(own[nth % 2 == 0], minlength=use.size) >= least  # in runs of one symbol fewer places are left
        level[hit[~real[own]]] = 0
        room = (1 << 16) - base - rules
        if room > 0:
            real &= np.cumsum(real) <= room  # the others wait for the next round
        take = (nth % 2 == 0) & real[own]
        hit, own, use = hit[take], (np.cumsum(real) - 1)[own[take]], use[real]
        if not use.size:
            continue
        if room == 0:
            narrow = seq.copy(), dead.copy(), rules, size
        left.append((pairs[use] >> np.uint64(32)).astype(np.uint32))
        right.append((pairs[use] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        gone = after[hit]
        seq[hit] = np.uint32(base + rules) + own.astype(np.uint32)
        rules, size = rules + use.size, size - hit.size
        dead[gone], level[gone] = True, 0
        after[hit] = after[gone]
        follow = after[hit]
        before[follow[follow < n]] = hit[follow < n]
        lead = before[hit]
        fresh = np.concatenate([hit, lead[(lead >= 0) & ~begins[hit]]])
        level[fresh] = 0
        fresh = np.sort(fresh[~begins[after[fresh]]])
        fresh = fresh[np.diff(fresh, prepend=-1) > 0]
    left, right = np.concatenate(left), np.concatenate(right)
    if narrow is not None and (narrow[3] + 3 * narrow[2]) * 16 <= (size + 2 * rules) * _bits(base + rules) + rules * 16:
        seq, dead, rules, size = narrow
    return seq[~dead], left[:rules], right[:rules], ends - np.searchsorted(np.flatnonzero(dead), ends)


def _bits(symbols: int) -> int:
    return max(16, int(symbols - 1).bit_length())


def _packed(x: np.ndarray, bits: int) -> bytes:
    """The low 16 bits of each, then a row of packed bits for each bit above."""
    return b"".join([x.astype("<u2").tobytes(), *(np.packbits(((x >> np.uint32(k)) & np.uint32(1)).astype(np.uint8)).tobytes() for k in range(16, bits))])


class _Row:
    """Symbols as `_packed` writes them; a slice reads only its own part."""

    def __init__(self, payload, at: int, n: int, bits: int):
        self.low = np.frombuffer(payload, "<u2", n, at)
        step = -(-n // 8)
        self.planes = [np.frombuffer(payload, np.uint8, step, at + 2 * n + k * step) for k in range(bits - 16)]
        self.size, self.end = n, at + 2 * n + len(self.planes) * step

    def __getitem__(self, part: slice) -> np.ndarray:
        lo, hi, _ = part.indices(self.size)
        out = self.low[lo:hi].astype(np.uint32)
        for k, plane in enumerate(self.planes):
            bit = np.unpackbits(plane[lo // 8 : -(-hi // 8)])[lo % 8 : lo % 8 + out.size]
            out |= bit.astype(np.uint32) << np.uint32(16 + k)
        return out


def expansion_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    size: list[int] = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        size.append((size[a - base] if a >= base else 1) + (size[b - base] if b >= base else 1))
    return np.array(size, np.uint32)


def expand(seq: np.ndarray, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    seq = seq.astype(np.uint32)
    while (deep := seq >= base).any():
        width = 1 + deep.astype(np.int64)
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.uint32)
        rule = seq[deep] - np.uint32(base)
        out[at] = seq
        out[at[deep]], out[at[deep] + 1] = left[rule], right[rule]
        seq = out
    return seq


def _size(most: int) -> int:
    return next(k for k in (1, 2, 4, 8) if most < 1 << 8 * k)


def dump(ids: np.ndarray, ends: np.ndarray, docs: np.ndarray, null: np.ndarray, base: int) -> bytes:
    seq, left, right, places = grammar(ids, ends, base)
    size = expansion_lengths(left, right, base)
    bits, wide, place = _bits(base + left.size), _size(int(size.max(initial=1))), _size(int(ends[-1]))
    return b"".join([
        _HEAD.pack(b"SLRP2\0", bits, wide, place, base, left.size, docs.size, seq.size), _packed(left, bits), _packed(right, bits), size.astype(_PLACE[wide]).tobytes(),
        docs.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), places.astype(_PLACE[place]).tobytes(), ends.astype(_PLACE[place]).tobytes(), _packed(seq, bits),
    ])


class Shard:
    """A payload opened for reading: `document(i)`, `ids(i, start, stop)`, `all()`."""

    def __init__(self, payload: bytes):
        magic, bits, wide, place, self.base, rules, docs, symbols = _HEAD.unpack_from(payload)
        if magic != b"SLRP2\0":
            raise ValueError("not a shard of token ids")
        at = _HEAD.size

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        left = _Row(payload, at, rules, bits)
        right = _Row(payload, left.end, rules, bits)
        self.left, self.right, at = left[:], right[:], right.end
        self.size = take(_PLACE[wide], rules)
        self.doc_ids, self.null = take("<i8", docs), take("u1", docs)
        self.places, self.starts = take(_PLACE[place], docs + 1).astype(np.int64), take(_PLACE[place], docs + 1).astype(np.int64)
        self.seq = _Row(payload, at, symbols, bits)

    def all(self) -> np.ndarray:
        """The ids of all documents. Each rule is expanded once."""
        seq = self.seq[:]
        rule = seq >= self.base
        if not rule.any():
            return seq
        size = self.size.astype(np.int64)
        at = np.cumsum(size) - size
        flat = expand(np.arange(self.base, self.base + size.size, dtype=np.uint32), self.left, self.right, self.base)
        own = (seq[rule] - np.uint32(self.base)).astype(np.int64)
        width, start = np.ones(seq.size, np.int64), np.empty(seq.size, np.int64)
        width[rule], start[rule] = size[own], at[own]
        start[~rule] = flat.size + np.arange(seq.size - own.size)
        return np.concatenate([flat, seq[~rule]])[ragged(start, width)]

    def document(self, i: int) -> np.ndarray:
        return expand(self.seq[self.places[i] : self.places[i + 1]], self.left, self.right, self.base)

    def ids(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1 of document i; only symbols that overlap the range are expanded."""
        seq = self.seq[self.places[i] : self.places[i + 1]].astype(np.int64)
        size = np.where(seq >= self.base, self.size[np.maximum(seq - self.base, 0)] if self.size.size else 1, 1).astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        start, stop = max(0, start), min(stop, int(edge[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        lo, hi = np.searchsorted(edge, start, side="right") - 1, np.searchsorted(edge, stop, side="left")
        return expand(seq[lo:hi], self.left, self.right, self.base)[start - edge[lo] : stop - edge[lo]]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 2, base: int | None = None, shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES) -> None:
    """Encode whole texts, append `end_id` to each, and write Re-Pair shards in ascending doc_id order to `path`.

    Null doc_ids come first; rows of one doc_id stand in the order of their texts, nulls (empty) first. Rows are dealt to partitions
    of at most about `part_bytes` of text by doc_id and the beginning of the text, so null and repeated doc_ids are dealt to several
    as well (all but whole repeated rows). A task writes its partition as shards of about `shard_bytes`
    of text, of which it holds one; a document is never divided. `base` is above every id: the tokenizer's vocabulary size by default.
    """
    tokenizer_path = tokenizer_path or default_path()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(4 * cores, -(-size // shard_bytes)), -(-size // part_bytes))

    def run(batches):
        enc = encoder(tokenizer_path)
        above = base or enc.tok.get_vocab_size(with_added_tokens=True)
        part = TaskContext.get().partitionId()
        held: list = []
        shard = before = fill = 0

        def flush():
            nonlocal shard, before, fill
            ids, n, doc, null = (np.concatenate(x) for x in zip(*held, strict=True))
            ends = np.concatenate([[0], np.cumsum(n)])
            out = [[part], [shard], [before], [None if null[0] else int(doc[0])], [doc.size], [int(ends[-1])], [dump(ids, ends, doc, null, above)]]
            held.clear()
            shard, before, fill = shard + 1, before + int(ends[-1]), 0
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()), strict=True)], names=["part", "shard", "before", "first_doc", "n_docs", "n_tokens", "payload"])

        for b in slices(batches, "text", min(1 << 20, shard_bytes)):
            ids, off = enc.encode(b.column(1))
            at = off[1:] + np.arange(b.num_rows)
            full = np.empty(ids.size + b.num_rows, np.uint32)
            keep = np.ones(full.size, bool)
            keep[at], full[at] = False, end_id
            full[keep] = ids
            doc = b.column(0)
            held.append((full, np.diff(off) + 1, doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False)))
            fill += b.column(1).nbytes
            if fill >= shard_bytes:
                yield flush()
        if held:
            yield flush()

    placed = docs.withColumn("begin", F.substring("text", 1, 64)).repartitionByRange(parts, "doc_id", "begin").sortWithinPartitions("doc_id", "text")
    # a batch to Python holds about one shard's text; payloads are compressed already, and their pages and row groups end as they fill
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(shard_bytes)):
        mapped(placed.select("doc_id", "text"), run, _FILE).write.options(**_PARQUET).parquet(path)


_FILE = "part int, shard int, before long, first_doc long, n_docs long, n_tokens long, payload binary"
#: Parquet looks at the size of a page and of a row group after 100 rows by default, which is 200 MB of payloads.
_PARQUET = {"compression": "uncompressed", "parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.enable.dictionary": "false"}


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids as bytes) of each document in the shards at `path`.

    `start` counts the ids of all documents before it. The totals of partitions, one number for each 256 MB of text or so, are
    summed in one task and broadcast: 400,000 rows for 100 TB.
    """
    table = spark.read.schema(_FILE).parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.selectExpr("part", "coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS base")

    def run(batches):
        for b in batches:
            for payload, base in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                s = Shard(payload.as_buffer())
                ids = s.all()
                view, at = memoryview(ids).cast("B"), (s.starts * 4).tolist()
                cols = [pa.array(s.doc_ids, mask=s.null.astype(bool)), pa.array(s.starts[:-1] + base), pa.array(np.diff(s.starts)), pa.array([zlib.crc32(view[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.int64())]
                if with_ids:
                    cols.append(pa.array([bytes(view[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    joined = table.select("part", "before", "payload").join(F.broadcast(parts), "part").select("payload", (F.col("base") + F.col("before")).alias("base"))
    return mapped(joined, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_file(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """`write_tokens` to `path` (or a new folder in the shared one), then `read_tokens` from it. No documents: no rows."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path)
