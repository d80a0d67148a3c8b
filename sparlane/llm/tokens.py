"""Token ids of whole texts by the tokenizers library, with an in-worker store of pieces that came before.

A text is cut before each run of blanks, tabs and line feeds that follows another character, between a letter (ASCII or
U+00C0 to U+027F) and an ASCII sign, and between a line feed alone and an ASCII letter. The byte-level pre-tokenizer never
joins characters over such a cut, so the ids of a text are those of its pieces in turn. A text with any other control or blank
character goes to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from .blocks import Table, hash_runs, ragged, text_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 32]] = True
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN[33:48] = _SIGN[58:65] = _SIGN[91:97] = _SIGN[123:127] = True
_CONTROL, _LEAD = np.zeros(256, bool), np.zeros(256, bool)
_CONTROL[[*range(9), *range(11, 32), 127]] = True
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_LEAD |= _CONTROL
#: The second and third bytes (first, last) of each other blank, by the first one; a character of two bytes has any third.
_WIDE = [
    (0xC2, 0x80, 0xA0, 0, 255), (0xE1, 0x9A, 0x9A, 0x80, 0x80), (0xE1, 0xA0, 0xA0, 0x8E, 0x8E), (0xE2, 0x80, 0x80, 0x80, 0x8A), (0xE2, 0x80, 0x80, 0xA8, 0xA9), (0xE2, 0x80, 0x80, 0xAF, 0xAF),
    (0xE2, 0x81, 0x81, 0x9F, 0x9F), (0xE3, 0x80, 0x80, 0x80, 0x80), (0xEF, 0xBB, 0xBB, 0xBF, 0xBF),
]
#: Bytes of ASCII letters and of the characters U+00C0 to U+027F, all letters but two signs (C3 97 and C3 B7).
_WORD = _LETTER.copy()
_WORD[0x80:0xC0] = _WORD[0xC3:0xCA] = True
#: Pieces that a worker keeps; when it is full, those that came again stay.
STORE = 800_000


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def odd_places(data: np.ndarray) -> np.ndarray:
    """Where control characters other than tab and line feed, and blanks beyond ASCII, begin in UTF-8 bytes."""
    at = np.flatnonzero(_LEAD[data])
    a, b, c = data[at], data[np.minimum(at + 1, data.size - 1)], data[np.minimum(at + 2, data.size - 1)]
    hit = _CONTROL[a]
    for first, b0, b1, c0, c1 in _WIDE:
        hit |= (a == first) & (b >= b0) & (b <= b1) & (c >= c0) & (c <= c1)
    return at[hit]


def are_words(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the pieces that stand in `data` one after the other are letters of `_WORD` only, after a blank or nothing."""
    first = np.cumsum(size) - size
    bad = ~_WORD[data]
    bad[first] &= (data[first] != 32) | (size == 1)
    bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    return np.add.reduceat(bad, first, dtype=np.int64) == 0


class Encoder:
    """`encode(texts)` gives all ids and each text's offsets. Special-token strings in a text are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        line = self.tok.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 and self.tok.encode("a\n b\nc", add_special_tokens=False).ids == [x for t in ("a", "\n", " b", "\n", "c") for x in self.tok.encode(t, add_special_tokens=False).ids] else None
        # words by the same model without the search for pre-tokens, as each is one; ids are told apart by their bytes
        self.words, pre = None, self.tok.pre_tokenizer
        if isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space and self.tok.normalizer is None:
            self.words = Tokenizer(self.tok.model)
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = self.tok.get_vocab(with_added_tokens=False)
            self.bytes = np.zeros(max(vocab.values()) + 1, np.int32)
            self.bytes[list(vocab.values())] = [len(t) for t in vocab]
        self.clear()

    def clear(self) -> None:
        self.table, self.n, self.used = Table(18), 0, 0
        self.start, self.length, self.again, self.arena = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, bool), np.zeros(1 << 19, np.uint32)

    def renew(self) -> None:
        """Only the pieces that came again, unless these are over half of all that may be kept."""
        keys, at = self.table.keys[self.table.keys != 0], self.table.vals[self.table.keys != 0]
        keys, at = keys[self.again[at]], at[self.again[at]]
        n, flat = self.length[at].astype(np.int64), self.arena[ragged(self.start[at], self.length[at].astype(np.int64))]
        self.clear()
        if at.size * 2 <= STORE:
            self._add(keys, flat, n)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in turn, and how many each has. Pieces with one blank at most, before all else, go to the library in lines."""
        n = np.zeros(len(texts), np.int64)
        plain = np.array([self.line is not None and t.isprintable() and " " not in t[1:] for t in texts], bool)
        rest, lines = np.flatnonzero(~plain), np.flatnonzero(plain)
        apart = [e.ids for e in self.tok.encode_batch_fast([texts[i] for i in rest.tolist()], add_special_tokens=False)] if rest.size else []
        n[rest] = [len(x) for x in apart]
        got = np.zeros(0, np.uint32)
        if lines.size:
            got = np.array(self.tok.encode_batch_fast(["\n".join([texts[i] for i in lines.tolist()])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(got == self.line), got.size)
            n[lines] = np.diff(ends, prepend=-1) - 1
            got = got[got != self.line]
        out = np.empty(int(n.sum()), np.uint32)
        at = np.cumsum(n) - n
        out[ragged(at[lines], n[lines])] = got
        out[ragged(at[rest], n[rest])] = [x for e in apart for x in e]
        return out, n

    def _word_ids(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `_ids`, of words that stand in `data` one after the other."""
        line = np.full(data.size + size.size, 10, np.uint8)
        line[np.arange(data.size) + np.repeat(np.arange(size.size), size)] = data
        flat = np.array(self.words.encode_batch_fast([line.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.searchsorted(np.cumsum(self.bytes[flat]), np.cumsum(size)) + 1
        return flat, np.diff(ends, prepend=0)

    def _keep(self, data: np.ndarray, st: np.ndarray, en: np.ndarray, keys: np.ndarray) -> None:
        for i in range(0, st.size, 5000):
            a, size, own = st[i : i + 5000], (en - st)[i : i + 5000], keys[i : i + 5000]
            body = data[ragged(a, size)]
            word = are_words(body, size) & (self.words is not None)
            if word.any():
                self._add(own[word], *self._word_ids(body[np.repeat(word, size)], size[word]))
            if not word.all():
                raw, to = body.tobytes(), np.cumsum(size)
                self._add(own[~word], *self._ids([raw[x:y].decode() for x, y in zip((to - size)[~word].tolist(), to[~word].tolist(), strict=True)]))

    def _add(self, keys: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        while self.used + flat.size > self.arena.size:
            self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
        while self.n + n.size > self.start.size:
            self.start, self.length, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.again))
        self.arena[self.used : self.used + flat.size] = flat
        self.start[self.n : self.n + n.size], self.length[self.n : self.n + n.size] = self.used + np.cumsum(n) - n, n
        self.table.add(keys, np.arange(self.n, self.n + n.size, dtype=np.int32))
        self.n, self.used = self.n + n.size, self.used + flat.size

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        data, off = text_bytes(texts)
        n = len(off) - 1
        odd = np.zeros(n, bool)
        odd[np.searchsorted(off, odd_places(data), side="right") - 1] = True
        whole = {i: self.tok.encode(data[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids for i in np.flatnonzero(odd)}
        blank = _BLANK[data]
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin[1:] |= _SIGN[data[1:]] & _LETTER[data[:-1]]
        if data.size > 2:  # a sign after a letter of two bytes, a letter after one line feed
            pair = np.flatnonzero(_SIGN[data[2:]] & (data[1:-1] >= 0x80))
            lead, trail = data[pair], data[pair + 1]
            begin[pair[(lead >= 0xC3) & (lead < 0xCA) & ((lead != 0xC3) | ((trail != 0x97) & (trail != 0xB7)))] + 2] = True
            pair = np.flatnonzero(data[1:-1] == 10)
            begin[pair[_LETTER[data[pair + 2]] & ~_BLANK[data[pair]]] + 2] = True
        begin[off[:-1][off[:-1] < data.size]] = True
        if whole:
            begin &= ~np.repeat(odd, np.diff(off))
            begin[off[:-1][odd]] = True
        st = np.flatnonzero(begin)
        en = np.append(st[1:], data.size)
        if whole:
            keep = ~odd[np.searchsorted(off, st, side="right") - 1]
            st, en = st[keep], en[keep]
        h = hash_runs(data, st, en)
        if self.n > STORE:
            self.renew()
        at = self.table.find(h)
        self.again[at[at >= 0]] = True
        if (miss := np.flatnonzero(at < 0)).size:
            keys, first = np.unique(h[miss], return_index=True)
            first = miss[first]
            self._keep(data, st[first], en[first], keys)
            at[miss] = self.table.find(h[miss])
        size = self.length[at].astype(np.int64)
        flat = self.arena[ragged(self.start[at], size)]
        edge = np.concatenate([[0], np.cumsum(size)])
        out = edge[np.searchsorted(st, off)]
        if not whole:
            return flat, out
        parts, lengths = [], np.diff(out)
        for i in range(n):
            parts.append(np.array(whole[i], np.uint32) if i in whole else flat[out[i] : out[i + 1]])
            lengths[i] = parts[-1].size
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for this vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
