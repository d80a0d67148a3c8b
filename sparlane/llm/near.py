"""Near-duplicate documents by order MinHash (operator 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import WORD_BYTES, mix, ragged, slices, text_bytes, words
from .shared import discard, mapped, pointed, stars, written

#: K-mers of a sketch, bins of the word histogram, rows of a bucket compared at once.
TAKEN, BINS, BLOCK = 2, 64, 4096
#: Texts of `from` words or more and under `below` have so many sketches of k-mers of so many words: (from, below, words, sketches). Five words in a row
#: tell long texts apart, but at the limit, where a fifth of the words differ, two thirds of them are touched: three-word k-mers find
#: those pairs, and two-word ones the short texts. SHORT[0] / SHORT[1] is `cut` or less, so no pair is torn.
SHORT = (64, 80)
LAYOUT = ((SHORT[0], 1 << 62, 5, 4), (SHORT[0], 1 << 62, 3, 30), (1, SHORT[1], 2, 20))
WIDTH = sum(x[3] for x in LAYOUT)
#: Rows of a bucket from which on the last round tests pairs inside the task, and up to which all its rows meet in one block.
LARGE, SMALL = 48, 256
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_COEF = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def labelled(key: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Another hash of each key and how often it stood in its text before."""
    doc = np.repeat(np.arange(off.size - 1), np.diff(off))
    own = key + mix(doc.astype(np.uint64), 2)
    order = np.argsort(own, kind="stable")
    k = own[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if k.size else np.zeros(0, np.int64)
    occ = np.empty(k.size, np.uint64)
    occ[order] = (np.arange(k.size) - np.repeat(first, np.diff(np.append(first, k.size)))).astype(np.uint64)
    return mix(key + occ * _COEF[1], 4)


def kmers(h: np.ndarray, woff: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled hashes of the `size` words in a row of each text, in text order, and their offsets; a shorter text is one k-mer."""
    n = np.diff(woff)
    end = np.repeat(woff[1:], n)
    at = np.arange(h.size)
    s = np.zeros(h.size, np.uint64)
    for j in range(size):
        part = h[j:] * _COEF[j]
        s[: part.size] += np.where(at[j:] < end[: part.size], part, np.uint64(0))
    ok = (at + size <= end) | (at == np.repeat(woff[:-1], n))
    koff = np.concatenate([[0], np.cumsum(ok)])[woff]
    return labelled(mix(s[ok], 1), koff), koff


def text_key(h: np.ndarray, woff: np.ndarray) -> np.ndarray:
    """A hash of all words of each text in turn."""
    n = np.diff(woff)
    turn = (np.arange(h.size) - np.repeat(woff[:-1], n)).astype(np.uint64)
    whole = np.zeros(n.size, np.uint64)
    if h.size:
        some = np.flatnonzero(n)
        whole[some] = np.add.reduceat(h * (mix(turn, 9) | np.uint64(1)), woff[:-1][some])
    return mix(whole + n.astype(np.uint64), 8)


def histogram(h: np.ndarray, woff: np.ndarray) -> np.ndarray:
    """texts x BINS: words by hash, 255 at most."""
    doc = np.repeat(np.arange(woff.size - 1), np.diff(woff))
    cell = doc * BINS + (mix(h, 6) >> np.uint64(58)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=(woff.size - 1) * BINS), 255).astype(np.uint8).reshape(-1, BINS)


def sketch(lab: np.ndarray, koff: np.ndarray, sketches: int, seed: int = 0) -> np.ndarray:
    """texts x sketches keys: the `TAKEN` k-mers that come first in a random order, in text order."""
    n = np.diff(koff)
    some = np.flatnonzero(n)
    doc = np.repeat(np.arange(some.size), n[some])
    out = np.zeros((n.size, sketches), np.uint64)
    if not some.size:
        return out
    start, width = koff[:-1][some], n[some]
    ext = np.append(lab, np.uint64(0))
    for t in range(sketches):
        m = mix(lab, 100 + seed + t)
        m[m == _MAX] -= np.uint64(1)
        places = np.full((some.size, TAKEN), lab.size, np.int64)
        for j in range(TAKEN):
            hit = np.flatnonzero((m == np.repeat(np.minimum.reduceat(m, start), width)) & (m != _MAX))
            places[doc[hit], j] = hit
            m[hit] = _MAX
        places.sort(1)
        code = np.full(some.size, seed + t + 1, np.uint64)
        for j in range(TAKEN):
            code = mix(code + ext[places[:, j]], 5)
        out[some, t] = code
    return out


def buckets(h: np.ndarray, woff: np.ndarray) -> np.ndarray:
    """texts x WIDTH keys of the buckets of each text, each sketch in its own column; 0: none."""
    n = np.diff(woff)
    out = np.zeros((n.size, WIDTH), np.uint64)
    column = 0
    for low, below, size, sketches in LAYOUT:
        at = np.flatnonzero((n >= low) & (n < below))
        if at.size:
            off = np.concatenate([[0], np.cumsum(n[at])])
            out[at, column : column + sketches] = sketch(*kmers(h[ragged(woff[at], n[at])], off, size), sketches, column)
        column += sketches
    return out


def most_edits(longer, cut: float):
    """Edits that leave a similarity of `cut` to a pair whose longer text has so many words."""
    return np.floor((1 - cut) * longer + 1e-9).astype(np.int64)


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Words to insert, delete or replace to turn `a` into `b`, or most + 1 if that is over `most`.

    Banded alignment: with `most` edits an alignment stays on the diagonals from -x to m - n + x, x = (most - (m - n)) / 2,
    for m >= n words. A column of the band is two numbers whose bits say where the distance rises or falls by one from one
    row to the next; the carry of one addition runs along matches, so a column takes a dozen operations on numbers of that width.
    """
    if a.size < b.size:
        a, b = b, a
    if a.size - b.size > most:
        return most + 1
    same = a[: b.size] == b
    skip = b.size if same.all() else int(same.argmin())
    a, b = a[skip:], b[skip:]
    if b.size:
        same = a[a.size - b.size :][::-1] == b[::-1]
        skip = b.size if same.all() else int(same.argmin())
        a, b = a[: a.size - skip], b[: b.size - skip]
    m, n = a.size, b.size
    if not n or m == 1:
        return m if m <= most else most + 1
    shift = m - n
    x = (most - shift) // 2
    width = shift + 2 * x + 1
    full, goal = (1 << width) - 1, shift + x
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i + x
    up, down, out = full >> x << x, 0, shift
    for j, w in enumerate(b.tolist()):
        match = places.get(w, 0) >> j & full
        level = (((match & up) + up) ^ up) | match | down
        rise, fall = down | ~(level | up), level & up
        if not level >> goal & 1:
            out += 1
            if out > most:
                return most + 1
        level = (level & full) >> 1
        up, down = (fall | ~(level | rise)) & full, level & rise & full
    return out


#: Diagonals of a band that one machine word holds, pairs that are aligned at once, and of a large bucket at first.
WORD, PAIRS, FEW = 60, 8192, 512


def edits_many(texts: list[np.ndarray], ia: np.ndarray, ib: np.ndarray, most: np.ndarray) -> np.ndarray:
    """`edits` of many pairs of texts: those whose band fits a machine word go column by column side by side, the others one by one."""
    size = np.array([t.size for t in texts], np.int64)
    swap = size[ia] < size[ib]
    ia, ib = np.where(swap, ib, ia), np.where(swap, ia, ib)
    shift = size[ia] - size[ib]
    out = most + 1
    x = np.maximum(most - shift, 0) // 2
    width = shift + 2 * x + 1
    able = (shift <= most) & (size[ib] > 0)
    for p in np.flatnonzero((shift <= most) & ((width > WORD) | (size[ib] == 0))).tolist():
        out[p] = edits(texts[ia[p]], texts[ib[p]], int(most[p]))
    todo = np.flatnonzero(able & (width <= WORD))
    todo = todo[np.argsort(-size[ib[todo]], kind="stable")]
    for lo in range(0, todo.size, PAIRS):
        at = todo[lo : lo + PAIRS]
        out[at] = _aligned(texts, ia[at], ib[at], size, x[at], width[at], most[at])
    return out


def _aligned(texts, ia, ib, size, x, width, most) -> np.ndarray:
    """Pairs by falling length of the second text. A column of each band is two 64-bit numbers, as in `edits`."""
    wide, room = int(width.max()), int(x.max())
    use, place = np.unique(np.concatenate([ia, ib]), return_inverse=True)
    a, b = place[: ia.size], place[ia.size :]
    words = np.zeros((use.size, room + int(size[use].max()) + wide), np.uint64)  # 0 is no word
    for r, t in enumerate(use.tolist()):
        words[r, room : room + texts[t].size] = texts[t]
    n, one = size[ib], np.uint64(1)
    bit = one << np.arange(wide, dtype=np.uint64)
    full = (one << width.astype(np.uint64)) - one
    goal = (size[ia] - n + x).astype(np.uint64)
    up, down, out = full >> x.astype(np.uint64) << x.astype(np.uint64), np.zeros(ia.size, np.uint64), size[ia] - n
    start = room - x
    live = np.arange(ia.size)
    for j in range(int(n[0])):
        live = live[(n[live] > j) & (out[live] <= most[live])]
        if not live.size:
            break
        same = words[a[live, None], start[live, None] + j + np.arange(wide)] == words[b[live], room + j][:, None]
        match = np.where(same, bit, np.uint64(0)).sum(1, dtype=np.uint64) & full[live]
        u, d, f = up[live], down[live], full[live]
        level = (((match & u) + u) ^ u) | match | d
        rise, fall = d | ~(level | u), level & u
        out[live] += (level >> goal[live] & one) == 0
        level = (level & f) >> one
        up[live], down[live] = (fall | ~(level | rise)) & f, level & rise & f
    return np.minimum(out, most + 1)


def similarity(a: np.ndarray, b: np.ndarray, cut: float) -> float:
    """1 - edits / words of the longer text; 0 if that is under `cut`."""
    longer = max(a.size, b.size)
    most = int(most_edits(longer, cut))
    d = edits(a, b, most)
    return 1 - d / longer if d <= most else 0.0


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Of sorted labelled words of two texts: how many both have."""
    if a.size > b.size:
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), b.size - 1)
    return int((b[at] == a).sum())


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in slices(batches, "text"):
            _, _, h, woff = words(*text_bytes(b.column(2)), WORD_BYTES)
            keys = buckets(h, woff).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(keys.shape[0] + 1, dtype=np.int32) * WIDTH), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(woff)), pa.array(text_key(h, woff).view(np.int64)), lists, pa.array([x.tobytes() for x in histogram(h, woff)], pa.binary())],
                names=["doc_id", "row_key", "n_words", "k", "buckets", "sig"],
            )

    return mapped(docs, run, "doc_id long, row_key long, n_words long, k long, buckets array<long>, sig binary")


def _keys(column) -> np.ndarray:
    """The rows of `buckets` again."""
    return column.combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)


def _histograms(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least edits between texts with these histograms: an edit adds one word, takes one away, or does both."""
    d = a.astype(np.int16) - b
    gain = np.maximum(d, 0).sum(1, dtype=np.int64)
    return np.maximum(gain, gain - d.sum(1, dtype=np.int64))


def _leads(members: DataFrame, own: DataFrame, cut: float) -> DataFrame:
    """(a, b): each text with one text that it may link to, the closest by histogram of those that come first (by k) in its buckets."""
    met = members.where("k <> lead").select("k", "lead").distinct()
    both = met.join(own.select("k", "n", "sig"), "k").join(own.select(F.col("k").alias("lead"), F.col("n").alias("m"), F.col("sig").alias("other")), "lead")

    def run(batches):
        for b in batches:
            longer = np.maximum(b.column(2).to_numpy(), b.column(3).to_numpy())
            d = _distance(_histograms(b.column(4)), _histograms(b.column(5)))
            ok = pa.array(d <= most_edits(longer, cut))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(d).filter(ok)], names=["a", "b", "d"])

    able = mapped(both.select("k", "lead", "n", "m", "sig", "other"), run, "a long, b long, d long")
    return able.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))


def _dealt(placed: DataFrame) -> DataFrame:
    """Rows (key, k, comp) of buckets with several components, with `rows` of the bucket and the pairs of blocks (bi <= bj) to which a row goes.

    Two rows of the most common component need not meet. The others are dealt to blocks 0, 1, ... and meet all blocks; those
    of the most common one are dealt to the blocks after these and meet the blocks of the others. A small bucket is one block.
    """
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("rows"), F.max("c").alias("most"), F.max_by("comp", F.struct("c", "comp")).alias("main"))
    sizes = sizes.where("most < rows").withColumn("some", F.ceil((F.col("rows") - F.col("most")) / BLOCK).cast("int")).withColumn("rest", F.ceil(F.col("most") / BLOCK).cast("int"))
    spot = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    small = F.col("rows") <= SMALL
    dealt = placed.join(sizes, "key").withColumn("block", F.when(small, 0).when(F.col("comp") == F.col("main"), F.col("some") + spot("rest")).otherwise(spot("some")))
    last = F.when(small, 0).when(F.col("block") < F.col("some"), F.col("some") + F.col("rest") - 1).otherwise(F.col("some") - 1)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select("key", "k", "comp", "rows", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))


class _Bucket:
    """A large bucket whose pairs are tested here. What links is joined at once, so pairs between joined components are not tested."""

    def __init__(self, text: list[bytes], comp: np.ndarray, cut: float):
        self.text, self.cut, self.bags = [np.frombuffer(x, np.uint64) for x in text], cut, {}
        names, self.number = np.unique(comp, return_inverse=True)
        self.root = np.arange(names.size)

    def bag(self, i: int) -> np.ndarray:
        if i not in self.bags:
            self.bags[i] = np.sort(labelled(self.text[i], np.array([0, self.text[i].size])))
        return self.bags[i]

    def top(self, i: int) -> int:
        while self.root[i] != i:
            i = self.root[i]
        return i

    def links(self, ia: np.ndarray, ib: np.ndarray, d: np.ndarray) -> list[tuple[int, int]]:
        """Of pairs with the histogram distances `d` those links that join components, the closest tested first.

        Pairs with too few words in common are not aligned."""
        size = np.array([t.size for t in self.text], np.int64)
        longer = np.maximum(size[ia], size[ib])
        todo, lot, out = np.argsort(d / longer, kind="stable"), FEW, []
        while True:
            todo = todo[self.root[self.number[ia[todo]]] != self.root[self.number[ib[todo]]]]
            if not todo.size:
                return out
            now, todo, lot = todo[:lot], todo[lot:], min(2 * lot, PAIRS)
            common = np.array([common_words(self.bag(i), self.bag(j)) for i, j in zip(ia[now].tolist(), ib[now].tolist(), strict=True)])
            most = most_edits(longer[now], self.cut)
            able = longer[now] - common <= most
            now, most = now[able], most[able]
            for p in now[edits_many(self.text, ia[now], ib[now], most) <= most].tolist():
                x, y = self.top(self.number[ia[p]]), self.top(self.number[ib[p]])
                if x != y:
                    self.root[max(x, y)] = min(x, y)
                    out.append((int(ia[p]), int(ib[p])))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _pairs(groups: DataFrame, cut: float) -> DataFrame:
    """(a, b) of dealt rows (key, bi, bj, block, k, n, sig, comp, buckets, text) of different components.

    All pairs that the histograms allow, each in the first bucket that both texts are in; in large buckets, where rows bring the
    hashes of their words as `text`, they are tested at once, and only links that join components leave the task.
    """

    def flush(rows: pa.Table):
        key, bi, bj, block, k, n, comp = (rows[c].to_numpy() for c in ("key", "bi", "bj", "block", "k", "n", "comp"))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        end = np.append(first[1:], key.size)[group]
        sig = _histograms(rows["sig"])
        # rows stand by block: those of bi meet the rows behind them that are of bj
        many = np.bincount(group, weights=block == bi).astype(np.int64)
        left = np.flatnonzero(block == bi)
        begin = np.where(bi[left] == bj[left], left + 1, (first + many)[group[left]])
        count = np.maximum(end[left] - begin, 0)
        met, words_of = _keys(rows["buckets"]), rows["text"].to_pylist()
        tested = np.array([x is not None for x in words_of], bool)
        out_a, out_b, held = [], [], {}
        lot = np.cumsum(count) // 200_000
        for c in np.unique(lot):
            use = np.flatnonzero((lot == c) & (count > 0))
            ia = np.repeat(left[use], count[use])
            ib = ragged(begin[use], count[use])
            ok = (comp[ia] != comp[ib]) & (np.minimum(n[ia], n[ib]) >= np.maximum(n[ia], n[ib]) - most_edits(np.maximum(n[ia], n[ib]), cut))
            ia, ib = ia[ok], ib[ok]
            d = _distance(sig[ia], sig[ib])
            ok = d <= most_edits(np.maximum(n[ia], n[ib]), cut)
            ia, ib, d = ia[ok], ib[ok], d[ok]
            same = (met[ia] == met[ib]) & (met[ia] != 0)
            ok = met[ia, same.argmax(1)] == key[ia]
            ia, ib, d = ia[ok], ib[ok], d[ok]
            large = tested[ia]
            for g in np.unique(group[ia[large]]).tolist():
                of, lo, hi = large & (group[ia] == g), int(first[g]), int(end[first[g]])
                if g not in held:
                    held[g] = _Bucket(words_of[lo:hi], comp[lo:hi], cut)
                links = np.array(held[g].links(ia[of] - lo, ib[of] - lo, d[of]), np.int64).reshape(-1, 2) + lo
                out_a.append(k[links[:, 0]])
                out_b.append(k[links[:, 1]])
            out_a.append(k[ia[~large]])
            out_b.append(k[ib[~large]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    def run(batches):
        held: list[pa.Table] = []
        count = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            count += b.num_rows
            if count < 20_000:
                continue
            t = pa.concat_tables(held)
            g = [t[c].to_numpy() for c in ("key", "bi", "bj")]
            at = int(np.flatnonzero((g[0] == g[0][-1]) & (g[1] == g[1][-1]) & (g[2] == g[2][-1]))[0])
            if at:
                yield flush(t.slice(0, at))
            held, count = [t.slice(at)], t.num_rows - at
        if held:
            yield flush(pa.concat_tables(held))

    return mapped(groups.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "block", "k"), run, "a long, b long").distinct()


def _word_hashes(texts: DataFrame) -> DataFrame:
    """(k, text): the hashes of the words of each text."""

    def run(batches):
        for b in slices(batches, "text"):
            _, _, h, off = words(*text_bytes(b.column(1)), WORD_BYTES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h[x:y].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)], pa.binary())], names=["k", "text"])

    return mapped(texts.select("k", "text"), run, "k long, text binary")


def _verify(pairs: DataFrame, texts: DataFrame, cut: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach `cut`."""

    def run(batches):
        for b in slices(batches, "ta"):
            _, _, ha, oa = words(*text_bytes(b.column(2)), WORD_BYTES)
            _, _, hb, ob = words(*text_bytes(b.column(3)), WORD_BYTES)
            text = [h[o[i] : o[i + 1]] for h, o in ((ha, oa), (hb, ob)) for i in range(b.num_rows)]
            longer = np.maximum(np.diff(oa), np.diff(ob))
            most, here = most_edits(longer, cut), np.arange(b.num_rows)
            d = edits_many(text, here, here + b.num_rows, most)
            s = np.where(d <= most, 1 - d / np.maximum(longer, 1), 0.0)
            at = np.flatnonzero(s > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(s[at])], names=["a", "b", "similarity"])

    one = pairs.join(texts.select(F.col("k").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("k").alias("b"), F.col("text").alias("tb")), "b")
    return mapped(two.select("a", "b", "ta", "tb"), run, "a long, b long, similarity double")


def _row_key():
    return F.xxhash64("doc_id", "text")


def near_documents(docs: DataFrame, cut: float = 0.8) -> DataFrame:
    """doc_id, row_key, class_id, n_words, kept for every row of (doc_id, text).

    Two different texts link if their words have an edit similarity (`similarity`: one less the words to insert, delete or
    replace as a share of the longer text) of `cut`, at least 0.8. Texts with the same words are copies. A class holds all rows that
    links and copies join; class_id is its least doc_id. A row is kept if it is the first of its class by doc_id (null last) and
    hash of the text; identical rows share that place. A text without words (null, empty) is a class of its own; so its
    class_id is its own doc_id. Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters; words, and
    whole texts for being copies, are told apart by 64-bit hashes.

    Candidates are texts that agree in one sketch: the `TAKEN` k-mers that come first in a random order, in text order. A link
    is found if some sketch of its texts agrees; the README states the measured share. All candidates are decided exactly:
    pairs that the word histograms rule out cannot reach `cut`, the others are aligned, unless links already join their texts.
    This goes in two rounds: each text with the first one of a bucket, then all pairs of different components, in large buckets
    inside the task, the closest first, where what links is joined at once. The first round's links need not be joined to the end.
    """
    if not SHORT[0] / SHORT[1] <= cut <= 1:
        raise ValueError("cut must be from 0.8 to 1")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", _row_key().alias("row_key"), "text")
    done = written(_sketches(rows), "sketches")
    reps = done.where("n_words > 0").groupBy("k").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("rep"), F.first("n_words").alias("n"), F.first("buckets").alias("buckets"), F.first("sig").alias("sig"))
    reps = written(reps, "texts")
    entries = reps.select("k", F.explode("buckets").alias("key")).where("key <> 0")
    shared = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("k").alias("lead")).where("size > 1")
    members = written(entries.join(shared.select("key", "lead"), "key"), "members")
    own = written(reps.join(members.select("k").distinct(), "k").select("k", "n", "sig", "buckets", "rep.doc_id", "rep.row_key"), "candidates")
    texts = written(rows.join(own.select("k", F.col("doc_id").alias("d"), F.col("row_key").alias("r")), (F.col("row_key") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("k", "text").dropDuplicates(["k"]), "texts")
    discard(reps)
    pairs = written(_leads(members, own, cut), "pairs")
    links = stars(written(_verify(pairs, texts, cut).select("a", "b"), "links"), 2)
    comp = own.select("k").join(pointed(links).withColumnRenamed("node", "k"), "k", "left").select("k", F.coalesce("component", "k").alias("comp"))
    dealt = written(_dealt(members.select("key", "k").join(comp, "k")), "dealt")
    groups = dealt.join(own.select("k", "n", "sig", "buckets"), "k")
    big = dealt.where(F.col("rows") > LARGE).select("k").distinct()
    hashes = written(_word_hashes(texts.join(big, "k")), "hashes")
    few, many = groups.where(F.col("rows") <= LARGE).withColumn("text", F.lit(None).cast("binary")), groups.where(F.col("rows") > LARGE).join(hashes, "k")
    discard(pairs)
    pairs = written(_pairs(few.unionByName(many).select("key", "bi", "bj", "block", "k", "n", "sig", "comp", "buckets", "text"), cut), "pairs")
    found = written(_verify(pairs, texts, cut).select("a", "b"), "links")
    for used in (pairs, dealt, hashes, texts):
        discard(used)
    nodes = pointed(stars(links.union(found)))
    discard(members)
    out = done.join(nodes.withColumnRenamed("node", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))
    heads = out.where("n_words > 0").groupBy("component").agg(best.alias("head"))
    out = out.join(heads, (out.component == heads.component) & (out.n_words > 0), "left")
    single = F.col("head").isNull()
    kept = single | (F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.row_key") == F.col("row_key")))
    return out.select("doc_id", "row_key", F.when(single, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), "n_words", kept.alias("kept"))


def one_of_each(docs: DataFrame, cut: float = 0.8) -> DataFrame:
    """The rows of `docs` (all columns) that `near_documents` keeps; of identical (doc_id, text) rows one stays."""
    near = written(near_documents(docs, cut), "near")
    stay = near.where("kept").select(F.col("doc_id").alias("d"), F.col("row_key").alias("k")).distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("key"))
    kept = keyed.join(stay, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("d")), "left_semi")
    if near.groupBy("doc_id", "row_key").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["id", "key"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
