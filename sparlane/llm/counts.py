"""Count-only Viterbi over a unigram vocabulary (operator 9)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Table, hash_runs, slices, text_bytes
from .shared import mapped

_BLANK = np.zeros(256, bool)
_BLANK[32] = True
STORE = 800_000
#: Score of an unknown character below the least piece score, as unigram tokenizers have it.
PENALTY = 10.0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in id order; control and byte pieces included."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Viterbi:
    """Best score and piece count of a word.

    The rules are those of unigram tokenizers with byte fallback: scores add up from the left in double precision; of
    equal scores the piece that begins first stays; a character that is no piece itself may stand for itself at the
    least score less `PENALTY` and counts as many pieces as it has bytes.
    """

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.ac, self.single = ahocorasick.Automaton(), set()
        for piece, score in vocab:
            if piece:
                self.ac.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
        self.ac.make_automaton()
        self.unknown = min(s for _, s in vocab) - PENALTY
        known = {p for p, _ in vocab}
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))

    def run(self, word: str) -> tuple[float, int]:
        n, best, count = len(word), [0.0] * (len(word) + 1), [0] * (len(word) + 1)
        for end in range(1, n + 1):
            best[end] = -math.inf
        if self.single.issuperset(word):
            for end, (size, score) in self.ac.iter(word):  # for each end the longest piece comes first
                s = best[end + 1 - size] + score
                if s > best[end + 1]:
                    best[end + 1], count[end + 1] = s, count[end + 1 - size] + 1
            return best[n], count[n]
        hits: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, hit in self.ac.iter(word):
            hits[end].append(hit)
        for end, ch in enumerate(word):
            if ch not in self.single:
                hits[end].append((1, self.unknown))
            for size, score in hits[end]:
                s = best[end + 1 - size] + score
                if s > best[end + 1]:
                    new = len(ch.encode()) if score is self.unknown and self.bytes else 1
                    best[end + 1], count[end + 1] = s, count[end + 1 - size] + new
        return best[n], count[n]


_state: dict[str, tuple[Viterbi, list]] = {}


def token_counts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, score: pieces of the best segmentation of each whole text, and its score.

    Blanks become U+2581; one is put before a text that is not empty and does not begin with it, and each one begins a
    word. Words are segmented apart; a document's score is the sum over its words in double precision. A null or empty
    text has no tokens and the score 0. Null and repeated doc_ids keep their rows. A worker keeps the results of words it
    has seen (at most `STORE`), so a word costs one run of the automaton in a worker.
    """
    path = model_path or default_path()

    def run(batches):
        if path not in _state:
            _state[path] = (Viterbi(vocabulary(path)), [])
        vit, kept = _state[path]
        if not kept:
            kept[:] = [Table(18), np.zeros(1 << 16), np.zeros(1 << 16, np.int32), 0]
        for b in slices(batches, "text"):
            data, off = text_bytes(b.column(1))
            lead = (data == 32).astype(np.int64)
            mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
            lead[mark] = 3
            begin = lead > 0
            begin[off[:-1][off[:-1] < data.size]] = True
            st = np.flatnonzero(begin)
            en = np.append(st[1:], data.size)
            bare, raw = st + lead[st], data.tobytes()
            key, some = np.full(st.size, 1, np.uint64), bare < en
            key[some] = hash_runs(data, bare[some], en[some])
            if kept[3] > STORE:
                kept[:] = [Table(18), np.zeros(1 << 16), np.zeros(1 << 16, np.int32), 0]
            table, score, count, n = kept
            at = table.find(key)
            if (miss := np.flatnonzero(at < 0)).size:
                keys, first = np.unique(key[miss], return_index=True)
                first = miss[first]
                while n + keys.size > score.size:
                    score, count = np.concatenate([score, np.zeros_like(score)]), np.concatenate([count, np.zeros_like(count)])
                for k, (x, y) in enumerate(zip(bare[first].tolist(), en[first].tolist(), strict=True), n):
                    score[k], count[k] = vit.run("▁" + raw[x:y].decode())
                table.add(keys, np.arange(n, n + keys.size, dtype=np.int32))
                kept[:] = [table, score, count, n + keys.size]
                at[miss] = table.find(key[miss])
            edge = np.searchsorted(st, off)
            total = np.concatenate([[0], np.cumsum(count[at])])
            doc = np.repeat(np.arange(off.size - 1), np.diff(edge))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(edge)), pa.array(total[edge[1:]] - total[edge[:-1]]), pa.array(np.bincount(doc, weights=score[at], minlength=off.size - 1))],
                names=["doc_id", "n_words", "n_tokens", "score"],
            )

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_words long, n_tokens long, score double")
