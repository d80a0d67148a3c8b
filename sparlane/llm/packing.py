"""Sum-of-squares packing of token sequences (operator 8)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import slices
from .shared import mapped, written
from .tokens import default_path, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one task packs: the open bins of a shard are its only waste.
SHARD = 32_768


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Ids of each whole text and then `end_id`, cut into pieces of at most `capacity`; only the first may be shorter.

    A null text is empty: one piece with the end id alone. A null doc_id stays null; repeated rows are separate documents.
    `with_ids` adds the ids themselves as little-endian unsigned 32-bit integers.
    """

    def run(batches):
        enc = encoder(tokenizer_path)
        for b in slices(batches, "text"):
            ids, off = enc.encode(b.column(1))
            size = np.diff(off) + 1
            full = np.empty(int(size.sum()), np.uint32)
            at = np.concatenate([[0], np.cumsum(size)])
            full[at[1:] - 1] = end_id
            keep = np.ones(full.size, bool)
            keep[at[1:] - 1] = False
            full[keep] = ids
            n = -(-size // capacity)
            doc = np.repeat(np.arange(size.size), n)
            k = np.arange(doc.size) - np.repeat(np.cumsum(n) - n, n)
            head = (size - (n - 1) * capacity)[doc]
            start = np.where(k == 0, 0, head + (k - 1) * capacity)
            length = np.where(k == 0, head, capacity)
            view, base = memoryview(full).cast("B"), at[doc] + start
            lo, hi = (base * 4).tolist(), ((base + length) * 4).tolist()
            crc = [zlib.crc32(view[x:y]) for x, y in zip(lo, hi, strict=True)]
            cols = [b.column(0).take(pa.array(doc)), pa.array(k, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array([bytes(view[x:y]) for x, y in zip(lo, hi, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES + ", ids binary" * with_ids)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the given order, by the sum-of-squares rule.

    `count[g]` open bins have the gap g. Using a bin of gap g for a length s changes the sum of squared counts by
    2*(count[g-s] - count[g] + 1), a new bin counting as gap `capacity`; gaps 0 and `capacity` are not counted. The
    least change wins, then the least gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = np.empty(lengths.size, np.int64), np.empty(lengths.size, np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        change = 2 * (count[: capacity + 1 - s] - count[s:] + 1)
        change[count[s:] == 0] = 1 << 40
        if count[s]:
            change[0] += -1
        change[-1] = 2 * count[capacity - s] + 1 if s < capacity else 0
        g = s + int(change.argmin())
        if g == capacity:
            bins[i], n = n, n + 1
        else:
            bins[i] = stacks[g].pop()
            count[g] -= 1
        offsets[i] = capacity - g
        if 0 < g - s < capacity:
            stacks[g - s].append(int(bins[i]))
            count[g - s] += 1
    return bins, offsets


def settle(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Give up part-filled bins, from the emptiest up, whose pieces all find a place in other open bins by the same rule; bins and offsets.

    A bin whose pieces do not all find one stays as it is, so this moves only the pieces of bins that it saves.
    """
    if not lengths.size:
        return bins, bins
    bins = bins.copy()
    gap = capacity - np.bincount(bins, weights=lengths).astype(np.int64)
    open_bins = np.flatnonzero(gap > 0)
    count = np.bincount(gap[open_bins], minlength=capacity + 1)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for b in open_bins.tolist():
        stacks[gap[b]].append(b)
    by_bin = np.argsort(bins, kind="stable")
    edge = np.searchsorted(bins[by_bin], np.arange(gap.size + 1))
    for b in open_bins[np.argsort(-gap[open_bins], kind="stable")].tolist():
        own = by_bin[edge[b] : edge[b + 1]]
        if (bins[own] != b).any() or gap[b] != capacity - lengths[own].sum():
            continue  # it took pieces of a bin that was given up
        count[gap[b]] -= 1
        stacks[gap[b]].remove(b)
        moves: list[tuple[int, int, int]] = []
        for i in own[np.argsort(-lengths[own], kind="stable")].tolist():
            s = int(lengths[i])
            change = 2 * (count[: capacity - s] - count[s:capacity])
            change[0] -= 1
            change[count[s:capacity] == 0] = 1 << 40
            g = s + int(change.argmin())
            if not count[g]:
                break
            to = stacks[g].pop()
            count[g] -= 1
            if g > s:
                stacks[g - s].append(to)
                count[g - s] += 1
            moves.append((i, to, g))
        if len(moves) == own.size:
            for i, to, g in moves:
                bins[i], gap[to] = to, g - lengths[i]
            gap[b] = 0
            continue
        for i, to, g in reversed(moves):
            left = g - int(lengths[i])
            if left:
                stacks[left].remove(to)
                count[left] -= 1
            stacks[g].append(to)
            count[g] += 1
        count[gap[b]] += 1
        stacks[gap[b]].append(b)
    order = np.argsort(bins, kind="stable")
    size, own = lengths[order], bins[order]
    before = np.cumsum(size) - size
    offsets = np.empty_like(before)
    offsets[order] = before - before[np.searchsorted(own, own)]
    return bins, offsets


def pack(df: DataFrame, capacity: int = 2048, shard: int = SHARD) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and a `length` of 1 to `capacity`; other columns are kept as they are.

    Rows are dealt evenly to shards of about `shard` rows, whatever their keys: null and repeated doc_ids, pieces or whole rows are
    rows like all others. A task places its rows from the longest down (ties by doc_id, nulls last, and piece) by the sum-of-squares rule (`place`),
    then gives up what few sequences it can (`settle`). Sequences never mix shards, so the number of part-filled ones follows the
    number of shards. `df` must give the same rows in the same partitions when it is computed again, as a written table does.
    """
    n = max(1, -(-df.count() // shard))
    names, mark = df.columns, "_shard"
    while mark in names:
        mark += "_"

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        rows = rows.sort_by([(mark, "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        key, length = rows[mark].to_numpy(), rows["length"].to_numpy()
        for k in np.unique(key):
            lo, hi = np.searchsorted(key, [k, k + 1])
            bins, offsets = settle(length[lo:hi], place(length[lo:hi], capacity)[0], capacity)
            out = rows.slice(lo, hi - lo).select(names).append_column("sequence_id", pa.array((int(k) << 32) + bins)).append_column("offset", pa.array(offsets))
            yield from out.to_batches()

    keyed = df.withColumn(mark, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", sequence_id long, offset long"
    return mapped(keyed.repartition(n, mark), run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack `docs` (doc_id, text). One row per piece, see `pieces` and `pack`. No documents: no rows.

    The pieces (with `with_ids` their ids too) are written to the shared folder once, so that texts are encoded once.
    """
    return pack(written(pieces(docs, tokenizer_path or default_path(), capacity, end_id, with_ids), "pieces"), capacity)
