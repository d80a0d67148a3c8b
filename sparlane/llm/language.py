"""Language identification by mixture inference over byte n-grams (operator 10)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import slices, text_bytes
from .shared import mapped, tree_total

BITS = 15
_SPACED = np.full(256, 32, np.uint8)
_SPACED[128:] = np.arange(128, 256)
_SPACED[97:123] = np.arange(97, 123)
_SPACED[65:91] = np.arange(97, 123)
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
#: Added to each n-gram count; EM steps; share of the log of the n-gram count that each further language costs.
ALPHA, STEPS, COST = 0.5, 8, 2.0


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram inside a text, and the text it is in; what is no letter counts as one blank, and trigrams with a blank in the middle are left out."""
    if data.size < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _SPACED[data]
    g = (low[:-2].astype(np.uint32) << 16) | (low[1:-1].astype(np.uint32) << 8) | low[2:]
    ok = low[1:-1] != 32
    ends = off[1:-1]
    for back in (1, 2):
        at = ends - back
        ok[at[(at >= 0) & (at < ok.size)]] = False
    # an end that is also the start of later empty texts marks the same places again
    at = np.flatnonzero(ok)
    return ((g[at] * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64), np.searchsorted(off, at, side="right") - 1


@dataclass
class Languages:
    names: list[str]
    #: log probability of a bucket by language, buckets first
    logs: np.ndarray


def learn(docs: DataFrame) -> Languages:
    """From all rows of (text, lang) with a lang: n-gram counts by language, summed over partitions in a tree.

    A null text is empty. Memory is languages x 2^15 counts; no rows give no languages.
    """

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, "text"):
            bucket, doc = grams(*text_bytes(b.column(0)))
            lang = b.column(1).dictionary_encode()
            code = lang.indices.to_numpy()[doc]
            for k, name in enumerate(lang.dictionary.to_pylist()):
                add = np.bincount(bucket[code == k], minlength=1 << BITS)
                total[name] = total[name] + add if name in total else add
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.astype(np.int64).tobytes() for x in total.values()], pa.binary())], names=["key", "blob"])

    rows = docs.where("lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counts = tree_total(mapped(rows, run, "key string, blob binary"), np.int64)
    names = sorted(counts)
    if not names:
        return Languages([], np.zeros((1 << BITS, 0), np.float32))
    c = np.stack([counts[n] for n in names], 1) + ALPHA
    return Languages(names, np.log(c / c.sum(0)).astype(np.float32))


def _em(p: np.ndarray, count: np.ndarray, first: np.ndarray, width: np.ndarray, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) among the allowed languages, and the log-likelihood up to the scale of p."""
    pi = allowed / allowed.sum(1, keepdims=True)
    for _ in range(steps):
        r = p * np.repeat(pi, width, 0)
        r *= (count / r.sum(1))[:, None]
        pi = np.add.reduceat(r, first, 0)
        pi /= pi.sum(1, keepdims=True)
    s = np.log((p * np.repeat(pi, width, 0)).sum(1))
    return pi, np.add.reduceat(count * s, first)


def infer(model: Languages, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts x languages: proportions, 0 outside the chosen set and everywhere for a text without n-grams.

    EM over all languages gives each text's proportions. Then the language of the least proportion goes, as long as the
    log-likelihood lost is under COST * log(1 + n-grams); each round runs EM anew on the texts that are still open.
    """
    out = np.zeros((off.size - 1, len(model.names)), np.float64)
    bucket, doc = grams(data, off)
    if not bucket.size or not model.names:
        return out
    key, count = np.unique((doc << BITS) | bucket, return_counts=True)
    owner = key >> BITS
    lp = model.logs[key & ((1 << BITS) - 1)]
    top = lp.max(1, keepdims=True)
    p, count = np.exp(lp - top), count.astype(np.float32)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    ids, width = owner[first], np.diff(np.append(first, owner.size))
    n = np.add.reduceat(count, first)
    limit = COST * np.log1p(n)
    allowed = np.ones((ids.size, len(model.names)), np.float32)
    pi, best = _em(p, count, first, width, allowed, STEPS)
    final = pi.astype(np.float64)
    todo = np.arange(ids.size)
    while todo.size and len(model.names) > 1:
        use = allowed[todo].astype(bool)
        least = np.where(use, pi[todo], np.inf).argmin(1)
        less = allowed[todo].copy()
        less[np.arange(todo.size), least] = 0
        w = width[todo]
        f = np.cumsum(w) - w
        rows = np.arange(int(w.sum())) + np.repeat(first[todo] - f, w)
        sub, like = _em(p[rows], count[rows], f, w, less, STEPS)
        drop = (best[todo] - like < limit[todo]) & (less.sum(1) >= 1)
        final[todo] = np.where(drop[:, None], sub, final[todo])
        todo, sub, like, less = todo[drop], sub[drop], like[drop], less[drop]
        pi[todo], best[todo], allowed[todo] = sub, like, less
        todo = todo[allowed[todo].sum(1) > 1]
    out[ids] = final
    return out


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a Unicode letter."""
    seen = np.concatenate([[0], np.cumsum(_ASCII[data])])
    out = seen[off[1:]] > seen[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 1)):
        out[i] = any(ch.isalpha() for ch in data[off[i] : off[i + 1]].tobytes().decode())
    return out


def detect(docs: DataFrame, model: Languages, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, lang_pred, score, languages: the leading language, its proportion, and the chosen set by falling proportion.

    `und` with score 0 and no languages: a null text, one without a letter, or a model that learned none. A text whose
    letters make no trigram counts by the whole model, the first language in order winning. Ties go to the first name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in slices(batches, "text"):
            at = b.schema.get_field_index("text")
            data, off = text_bytes(b.column(at))
            pi = infer(m, data, off)
            known = has_letter(data, off) & bool(m.names)
            lead = pi.argmax(1) if m.names else np.zeros(off.size - 1, int)
            names = np.array([*m.names, "und"], object)
            score = np.where(known, pi.max(1) if m.names else 0.0, 0.0)
            score = np.where(known & (score == 0), 1.0 / max(1, len(m.names)), score)
            chosen = [[m.names[j] for j in np.argsort(-row, kind="stable") if row[j] > 0] if k else [] for row, k in zip(pi, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != at), pa.array(names[np.where(known, lead, -1)], pa.string()), pa.array(score, pa.float64()), pa.array(chosen, pa.list_(pa.string()))], names=[*keep, "lang_pred", "score", "languages"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return mapped(rows, run, f"{schema}, lang_pred string, score double, languages array<string>")


def held_out(mod: int, rest: int):
    """crc32 of doc_id as text, mod `mod`, is `rest`; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod == rest


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows outside the held-out third and predict all rows of (doc_id, text, lang)."""
    rows = docs.select("doc_id", "text", "lang")
    model = learn(rows.where(~held_out(3, 1)))
    return detect(rows.withColumn("held_out", held_out(3, 1)), model, ("doc_id", "held_out"))


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of `docs` (all columns) with a language: a letter in the text, and a language that holds `least` of it or more.

    The model is that of `identify`. A null or empty text goes.
    """
    model = learn(docs.where(~held_out(3, 1)).select("text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in slices(batches, "text"):
            data, off = text_bytes(b.column(b.schema.get_field_index("text")))
            pi = infer(m, data, off)
            top = pi.max(1) if m.names else np.ones(off.size - 1)
            yield b.filter(pa.array(has_letter(data, off) & ((top >= least) | (top == 0))))

    return mapped(docs, run, docs.schema)
