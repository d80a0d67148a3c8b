"""Benchmark decontamination by training suffix arrays (operator 3).

A shard is a slice of the documents' words. Its suffix array holds the suffixes that begin with the first words of some
test window, as no other suffix can be found. Every test suffix that a window begins is looked up in it by binary search; where
its window is found, the suffixes of texts and tests are put in one order, in which the longest match of each stands next to it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import WORD_BYTES, Table, mix, ragged, slices, text_bytes, words
from .shared import mapped

WINDOW = 10
#: Bytes of benchmark text that are held in memory at once; more is gone through in blocks, each with GROUP_BYTES of documents at a time.
BLOCK_BYTES, GROUP_BYTES = 32 << 20, 64 << 20


def _keys(ids: np.ndarray) -> np.ndarray:
    """Rows of word ids as byte strings that compare like them."""
    return np.ascontiguousarray(ids.astype(">u4")).view(f"S{4 * ids.shape[1]}").ravel()


@dataclass
class Tests:
    """Every suffix of the test items, as ids of their words (from 1; 0 is no test word)."""

    names: list[str]
    hashes: np.ndarray  # of the words with ids 1, 2, ...
    ids: np.ndarray  # words of all items in turn, then WINDOW zeros
    item: np.ndarray  # name of each suffix
    left: np.ndarray  # words that its item has from there
    length: np.ndarray  # of its window; 0 if none begins there
    lead: int  # words that the prefilter takes

    @classmethod
    def build(cls, texts: pa.Array, names: list[str], window: int) -> Tests:
        data, off = text_bytes(texts)
        _, _, h, woff = words(data, off, WORD_BYTES)
        uniq, inv = np.unique(h, return_inverse=True)
        order = sorted(set(names))
        number = {n: i for i, n in enumerate(order)}
        code = np.array([number[n] for n in names], np.int64)
        n = np.diff(woff)
        item = np.repeat(np.arange(n.size), n)
        left = woff[1:][item] - np.arange(h.size)
        first = np.arange(h.size) == woff[:-1][item]
        length = np.where(left >= window, window, np.where(first, left, 0))
        lead = int(min(3, length[length > 0].min())) if h.size else 0
        return cls(order, uniq, np.concatenate([inv + 1, np.zeros(window, np.int64)]), code[item], left, length, lead)


class Searcher:
    def __init__(self, t: Tests, window: int):
        self.t, self.window = t, window
        self.vocab = Table(12)
        self.vocab.add(t.hashes, np.arange(1, t.hashes.size + 1, dtype=np.int32))
        at = np.flatnonzero(t.length > 0)
        rows = t.ids[at[:, None] + np.arange(window)]
        rows = np.where(np.arange(window) < t.length[at][:, None], rows, 0)
        self.grams = Table(12)
        lead = np.unique(self._gram(rows[:, : t.lead].T)) if at.size else np.zeros(0, np.uint64)
        self.grams.add(lead, np.zeros(lead.size, np.int32))
        low, which = np.unique(rows, axis=0, return_inverse=True) if at.size else (rows, np.zeros(0, int))
        size = np.zeros(low.shape[0], np.int64)
        size[which.ravel()] = t.length[at]
        self.low, self.high = _keys(low), _keys(np.where(np.arange(window) < size[:, None], low, 0xFFFFFFFF))
        self.size, self.use, self.which = size, at, which.ravel()
        pairs = np.unique(np.stack([which.ravel(), t.item[at]], 1), axis=0) if at.size else np.zeros((0, 2), int)
        self.owner, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(low.shape[0] + 1))

    def _gram(self, cols) -> np.ndarray:
        code = np.zeros(len(cols[0]), np.uint64)
        for c in cols:
            code = mix(code + c.astype(np.uint64), 3)
        code[code == 0] = 1
        return code

    def shard(self, h: np.ndarray, woff: np.ndarray):
        """Ids of the shard's words, and its suffix array: starts in the order of their first `window` words, and these as keys."""
        t, w = self.t, self.window
        ids = np.zeros(h.size + w, np.int64)
        ids[: h.size] = np.maximum(self.vocab.find(h), 0)
        ends = np.repeat(woff[1:], np.diff(woff))
        ok = (ids[: h.size] > 0) & (np.arange(h.size) + t.lead <= ends) if t.lead else np.zeros(h.size, bool)
        for k in range(1, t.lead):
            ok &= ids[k : h.size + k] > 0
        start = np.flatnonzero(ok)
        start = start[self.grams.find(self._gram([ids[start + k] for k in range(t.lead)])) >= 0] if start.size else start
        rows = ids[start[:, None] + np.arange(w)]
        rows[start[:, None] + np.arange(w) >= ends[start][:, None]] = 0
        key = _keys(rows) if start.size else np.zeros(0, f"S{4 * w}")
        order = np.argsort(key, kind="stable")
        return ids, ends, start[order], key[order]

    def windows(self, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and window numbers of all occurrences."""
        lo, hi = np.searchsorted(key, self.low, "left"), np.searchsorted(key, self.high, "right")
        found = np.flatnonzero(hi > lo)
        n = (hi - lo)[found]
        at = np.repeat(lo[found] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return start[at], np.repeat(found, n)

    def extend(self, ids, woff, start, key, rank):
        """Places in the shard that a window of a test suffix is found at, and the length of each one's longest match; and of every test
        suffix whose window is found: its number, the place and length of its longest match in the shard.

        Of equally long matches the one in the document of the least `rank`, then the first, is given. The suffixes that begin
        like a window, of texts and tests alike, are ordered as far as a test reaches; the longest match of a test suffix is
        then next to it, as is that of a place.
        """
        t = self.t
        none = np.zeros(0, np.int64)
        low, high = (np.searchsorted(key, x, side) if start.size else np.zeros(x.size, np.int64) for x, side in ((self.low, "left"), (self.high, "right")))
        got = (high > low)[self.which]
        use, low, high = self.use[got], low[self.which[got]], high[self.which[got]]
        if not use.size:
            return none, none, none, none, none
        inside = np.cumsum(np.bincount(low, minlength=start.size + 1) - np.bincount(high, minlength=start.size + 1))[:-1] > 0
        short = np.zeros(start.size, np.int64)  # the longest item of fewer words than a window that begins at a place
        for n in np.unique(t.length[use]).tolist():
            at = t.length[use] == n
            if n < self.window:
                short[np.cumsum(np.bincount(low[at], minlength=start.size + 1) - np.bincount(high[at], minlength=start.size + 1))[:-1] > 0] = n
        spots, short = start[inside], short[inside]
        # one row of words: the documents that hold a place, then the parts of items, a 0 after each
        end, which = np.unique(use + t.left[use], return_inverse=True)
        begin = use[np.searchsorted(which, np.arange(end.size))]
        doc = np.searchsorted(woff, spots, side="right") - 1
        own, number = np.unique(doc, return_inverse=True)
        size = np.diff(woff)[own]
        base = int(size.sum()) + own.size
        move = np.cumsum(size + 1) - (size + 1) - woff[own]
        shift = base + np.cumsum(end - begin + 1) - (end + 1)
        seq = np.zeros(int(base + (end - begin + 1).sum()) + 1, np.int64)
        text = ragged(woff[own], size)
        seq[text + np.repeat(move, size)] = ids[text]
        part = ragged(begin, end - begin)
        seq[part + np.repeat(shift, end - begin)] = t.ids[part]
        at = np.concatenate([spots + move[number], use + shift[which]])
        reach = int(t.left[use].max())
        order = np.argsort(_doubled(seq, reach)[at], kind="stable")
        at, test = at[order], order >= spots.size
        # common words of each suffix with the one before, as far as a test reaches
        common, todo = np.zeros(at.size, np.int64), np.arange(1, at.size)
        for s in range(reach):
            x = seq[at[todo] + s]
            todo = todo[(x > 0) & (x == seq[at[todo - 1] + s])]
            if not todo.size:
                break
            common[todo] += 1
        best = lambda mark: np.maximum(_since(common, mark, reach), _since(np.append(common[1:], 0)[::-1], mark[::-1], reach)[::-1])
        most = np.zeros(spots.size, np.int64)
        most[order[~test]] = best(test)[~test]
        most = np.where(most >= self.window, most, short)
        best = best(~test)
        turn = np.lexsort((spots - woff[doc], rank[doc]))
        tie = np.full(at.size, spots.size)
        tie[np.argsort(order)[turn]] = np.arange(spots.size)
        place, length = np.zeros(use.size, np.int64), np.zeros(use.size, np.int64)
        length[order[test] - spots.size] = best[test]
        for n in np.unique(best[test]).tolist():
            group = np.cumsum(common < n)
            edge = np.flatnonzero(np.diff(group, prepend=-1))
            least = np.minimum.reduceat(tie, edge)[np.searchsorted(group[edge], group)]
            mine = test & (best == n)
            place[order[mine] - spots.size] = spots[turn[least[mine]]]
        return spots, most, use, place, length


def _doubled(seq: np.ndarray, reach: int) -> np.ndarray:
    """Ranks of the suffixes of `seq` by `reach` words or more, by prefix doubling; none has more words than lie up to its next 0."""
    ends = np.flatnonzero(seq == 0)
    reach = min(reach, int(np.diff(ends, prepend=-1).max()))
    rank, k = seq, 1
    while k < reach:
        ahead = np.zeros(seq.size, np.int64)
        ahead[:-k] = rank[k:]
        rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)[1].ravel()
        k *= 2
    return rank


def _since(common: np.ndarray, mark: np.ndarray, most: int) -> np.ndarray:
    """At each place the least of `common` since the last mark, that of the mark left out; 0 before the first mark."""
    part = np.cumsum(mark)
    x = np.where(mark, most, common)
    return np.where(part > 0, np.minimum.accumulate(x - part * (most + 1)) + part * (most + 1), 0)


_searchers: dict[tuple, Searcher] = {}


def _searcher(block, window: int) -> Searcher:
    """The index of a (name, broadcast) block; a worker keeps the last one, by the name that the driver gave it."""
    name, shared = block
    if (name, window) not in _searchers:
        _searchers.clear()
        _searchers[name, window] = Searcher(shared.value, window)
    return _searchers[name, window]


def _blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """(name, broadcast) of the benchmark's blocks; the driver holds one at a time, and its broadcasts stand in files."""
    sc = docs.sparkSession.sparkContext
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    out = []
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        out.append((uuid.uuid4().hex, sc.broadcast(Tests.build(part["text"].combine_chunks(), part["item_id"].to_pylist(), window))))
    return out


def _groups(batches, blocks: list):
    """Lists of slices of about 1 MB of text. With several blocks they are held for GROUP_BYTES, so that each index is built once for these."""
    held, size = [], 0
    for b in slices(batches, "text"):
        held.append(b)
        size += b.nbytes
        if len(blocks) < 2 or size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans, longest of each document.

    Words are lower-cased (A-Z) runs of ASCII letters and digits and of non-ASCII characters. A test window is `window`
    words of an item in a row, or all words of a shorter item that has any. `spans` are the maximal runs [from, to) of
    document words inside matches, `items` the sorted ids of the items that occur, `longest` the words of the longest match. A null text has no words; null test
    texts are left out; a null item_id counts as the empty string; repeated rows keep their own result rows. Each slice of documents
    meets the benchmark in blocks of `block_bytes` text, of which a worker holds one index at a time.
    """
    blocks = _blocks(docs, benchmark, window, block_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<from:int,to:int>>, longest long"
    return mapped(rows, _hit_rows(blocks, window), schema)


def _hit_rows(blocks, window: int):
    def run(batches):
        for held in _groups(batches, blocks):
            shards = [words(*text_bytes(b.column(1)), WORD_BYTES)[2:] for b in held]
            cover = [np.zeros(h.size + 1, np.int64) for h, _ in shards]
            longest = [np.zeros(woff.size - 1, np.int64) for _, woff in shards]
            found: list[list[list[str]]] = [[[] for _ in range(b.num_rows)] for b in held]
            for shared in blocks:
                s = _searcher(shared, window)
                for i, (h, woff) in enumerate(shards):
                    ids, _, start, key = s.shard(h, woff)
                    spots, length, _, _, _ = s.extend(ids, woff, start, key, np.arange(woff.size))
                    if not spots.size:
                        continue
                    cover[i] += np.bincount(spots, minlength=h.size + 1) - np.bincount(spots + length, minlength=h.size + 1)
                    np.maximum.at(longest[i], np.searchsorted(woff, spots, side="right") - 1, length)
                    at, win = s.windows(start, key)
                    doc = np.searchsorted(woff, at, side="right") - 1
                    for d, w in np.unique(np.stack([doc, win], 1), axis=0).tolist():
                        found[i][d].extend(s.t.names[x] for x in s.owner[s.first[w] : s.first[w + 1]].tolist())
            for b, (h, woff), c, most, items in zip(held, shards, cover, longest, found, strict=True):
                inside = np.cumsum(c[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(inside)])
                n_hit = total[woff[1:]] - total[woff[:-1]]
                spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
                for d in np.flatnonzero(n_hit):
                    own = np.concatenate([[False], inside[woff[d] : woff[d + 1]], [False]])
                    edge = np.flatnonzero(own[1:] != own[:-1]).tolist()
                    spans[d] = [{"from": x, "to": y} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.diff(woff)), pa.array(n_hit), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array(most)],
                    names=["doc_id", "n_words", "n_hit", "items", "spans", "longest"],
                )

    return run


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, item_word, doc_id, doc_word, length: for every test suffix, the longest verbatim match in any document.

    Each shard gives its own longest match; the longest of all stays, then the least doc_id (null last) and place. Only
    matches of a whole window count. Rows are at most the suffixes of the benchmark.
    """
    blocks = _blocks(docs, benchmark, window, block_bytes)

    def run(batches):
        for held in _groups(batches, blocks):
            shards = [words(*text_bytes(b.column(1)), WORD_BYTES)[2:] for b in held]
            for (k, shared), (b, (h, woff)) in ((x, y) for x in enumerate(blocks) for y in zip(held, shards, strict=True)):
                doc_id = b.column(0)
                rank = np.unique(doc_id.fill_null(0).to_numpy(), return_inverse=True)[1].ravel()
                rank[doc_id.is_null().to_numpy(zero_copy_only=False)] = rank.size
                s = _searcher(shared, window)
                ids, _, start, key = s.shard(h, woff)
                _, _, suffix, place, length = s.extend(ids, woff, start, key, rank)
                doc = np.searchsorted(woff, place, side="right") - 1
                begin = np.flatnonzero(np.concatenate([[True], s.t.left[1:] >= s.t.left[:-1]])) if s.t.left.size else suffix
                own = suffix - begin[np.searchsorted(begin, suffix, side="right") - 1] if suffix.size else suffix
                yield pa.RecordBatch.from_arrays([pa.array([s.t.names[i] for i in s.t.item[suffix].tolist()], pa.string()), pa.array(np.full(suffix.size, k)), pa.array(suffix), pa.array(own), b.column(0).take(pa.array(doc)), pa.array(place - woff[doc] if suffix.size else place), pa.array(length)], names=["item_id", "block", "suffix", "item_word", "doc_id", "doc_word", "length"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = mapped(rows, run, "item_id string, block long, suffix long, item_word long, doc_id long, doc_word long, length long")
    best = found.groupBy("block", "suffix", "item_id", "item_word").agg(F.max_by(F.struct("length", "doc_id", "doc_word"), F.struct("length", -F.col("doc_id"), -F.col("doc_word"))).alias("m"))
    return best.select("item_id", "item_word", "m.doc_id", "m.doc_word", "m.length")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` (all columns) that no test window occurs in; rows with a null doc_id or text stay on the same terms."""
    names = docs.columns
    schema = docs.schema
    blocks = _blocks(docs, benchmark, window, BLOCK_BYTES)

    def run(batches):
        for held in _groups(batches, blocks):
            shards = [words(*text_bytes(b.column(b.schema.get_field_index("text"))), WORD_BYTES)[2:] for b in held]
            bad = [np.zeros(b.num_rows, bool) for b in held]
            for shared in blocks:
                s = _searcher(shared, window)
                for own, (h, woff) in zip(bad, shards, strict=True):
                    at, _ = s.windows(*s.shard(h, woff)[2:])
                    own[np.searchsorted(woff, at, side="right") - 1] = True
            for b, own in zip(held, bad, strict=True):
                yield b.filter(pa.array(~own))

    return mapped(docs.select(*names), run, schema)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest of `hits`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    h = hits(docs, benchmark)
    return h.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
