"""Byte-level text work on Arrow string columns: slices of bounded size, words, 64-bit word hashes, hash tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240607))
#: Random 64-bit numbers by position in the word (mod 64) and byte.
_TABLE = _rng.integers(1, 1 << 63, size=64 * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_c = np.arange(256)
#: Bytes of words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+; every byte of a non-ASCII character belongs to a word.
TOKEN_BYTES = ~((_c == 32) | ((_c >= 9) & (_c <= 13)))
WORD_BYTES = ((_c >= 48) & (_c <= 57)) | ((_c >= 97) & (_c <= 122)) | (_c >= 128)


def text_bytes(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n+1 offsets; a null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not (pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type)):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    bufs = arr.buffers()
    if len(arr) == 0 or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(bufs[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about `size` bytes of text; a longer text comes alone."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
            yield batch.slice(at, min(to, n) - at)
            at = min(to, n)


def spans(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes inside each text."""
    inside = np.take(member, data)
    if not inside.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prev = np.empty_like(inside)
    prev[0], prev[1:] = False, inside[:-1]
    cuts = off[1:-1][off[1:-1] < data.size]
    prev[cuts] = False
    starts = np.flatnonzero(inside & ~prev)
    prev[:-1], prev[-1] = inside[1:], False
    prev[cuts[cuts > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~prev) + 1


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash (never 0) of each run of bytes; the runs may leave gaps but do not overlap."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    length = ends - starts
    body, at = data[starts[0] : ends[-1]], starts - starts[0]
    if 2 * int(length.sum()) < body.size:  # wide gaps: only the runs
        at = np.cumsum(length) - length
        body = data[ragged(starts, length)]
    # bytes between runs go on from the run before and are in no sum
    pos = np.arange(body.size, dtype=np.int32) - np.repeat(at.astype(np.int32), np.diff(at, append=body.size))
    val = np.take(_TABLE, ((pos & 63) << 8) | body)
    if int(length.max()) > 64:
        far = np.flatnonzero(pos >= 64)
        val[far] *= ((pos[far] >> 6) * 2 + 1).astype(np.uint64)
    total = np.zeros(body.size + 1, np.uint64)
    np.cumsum(val, out=total[1:])
    h = total[at + length] - total[at]  # modulo 2^64
    h ^= h >> np.uint64(29)
    h = (h + length.astype(np.uint64)) * _MIX
    h ^= h >> np.uint64(32)
    h[h == 0] = 1
    return h


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased (A-Z) texts: start, end, hash of each word, and n+1 offsets of the texts into them."""
    low = np.take(FOLD, data)
    st, en = spans(low, off, member)
    return st, en, hash_runs(low, st, en), np.searchsorted(st, off)


def mix(h: np.ndarray, by: int) -> np.ndarray:
    """Another hash of each hash."""
    h = (h ^ np.uint64(by * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Table:
    """64-bit keys (not 0) to int32 values; open addressing, all keys of a call at once. The owner bounds its size."""

    def __init__(self, bits: int = 16):
        self.keys, self.vals, self.n = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        mask = self.keys.size - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        k = self.keys[at]
        out = np.where(k == h, self.vals[at], np.int32(-1))
        todo = np.flatnonzero((k != h) & (k != 0))
        while todo.size:
            at[todo] = spot = (at[todo] + 1) & mask
            k, own = self.keys[spot], h[todo]
            hit = k == own
            out[todo[hit]] = self.vals[spot[hit]]
            todo = todo[~hit & (k != 0)]
        return out

    def add(self, h: np.ndarray, v: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        while (self.n + h.size) * 2 > self.keys.size:
            old = self.keys != 0
            k, x = self.keys[old], self.vals[old]
            self.__init__(int(self.keys.size).bit_length())
            self.add(k, x)
        mask = self.keys.size - 1
        at, todo = (h & np.uint64(mask)).astype(np.int64), np.arange(h.size)
        while todo.size:
            free = self.keys[at[todo]] == 0
            tried = todo[free]
            self.keys[at[tried]] = h[tried]
            won = self.keys[at[tried]] == h[tried]
            self.vals[at[tried[won]]] = v[tried[won]]
            todo = np.concatenate([todo[~free], tried[~won]])
            at[todo] = (at[todo] + 1) & mask
        self.n += h.size


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length-1 of every run, one run after the other."""
    if not lengths.size:
        return np.zeros(0, np.int64)
    first = np.zeros(lengths.size, np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    total = int(first[-1] + lengths[-1])
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)
