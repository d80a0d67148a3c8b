"""Fill-in-the-middle texts (operator 13)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import slices, text_bytes
from .shared import mapped

#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
_KINDS = 256


def codepoints(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one UTF-32 array, and the n+1 offsets of the texts into it."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, starts[off] if points.size == starts[-1] else np.concatenate([[0], np.cumsum([len(data[i:j].tobytes().decode("utf-8", "surrogateescape")) for i, j in zip(off[:-1], off[1:], strict=True)])])


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """A class for each code point, so that a unit ends where two neighbours differ.

    `char`: odd and even places, so each code point is a unit. `word`: letters and digits (with all beyond ASCII), white space,
    and the rest. `line`: up to and with a line feed.
    """
    if unit == "char":
        return np.arange(points.size) & 1
    if unit == "line":
        return np.concatenate([[0], np.cumsum(points == 10)[:-1]]) if points.size else np.zeros(0, np.int64)
    if unit != "word":
        raise ValueError(f"unit must be char, word or line, not {unit}")
    kind = np.full(_KINDS, 2, np.uint8)
    kind[48:58] = kind[65:91] = kind[97:123] = kind[128:] = 0
    kind[[9, 10, 11, 12, 13, 32]] = 1
    return kind[np.minimum(points, _KINDS - 1)]


def _text(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def _cut(b: pa.RecordBatch, unit: str, plain_from: int, spm_below: int, keep: tuple[str, ...]) -> pa.RecordBatch:
    column = lambda name: b.column(b.schema.get_field_index(name))
    data, off = text_bytes(column("text"))
    points, at = codepoints(data, off)
    kind = classes(points, unit)
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    edge = np.unique(np.concatenate([edge, at[:-1][at[:-1] < points.size]]))  # unit starts; a text starts a unit
    first = np.searchsorted(edge, at)
    n = np.diff(first)
    h = [column(f"h{i}").to_numpy(zero_copy_only=False) for i in range(1, 5)]
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    stops = np.append(edge, points.size)
    ends = []  # ends of the prefix and of the middle, in code points from the text's start
    for rank in (np.minimum(one, two), np.maximum(one, two)):
        place = stops[np.minimum(first[:-1] + rank, stops.size - 1)]
        ends.append(np.where(rank == n, at[1:], place) - at[:-1])
    p, s, m = (x.encode() for x in MARKS)
    form, out = [], []
    for i in range(n.size):
        raw = data[off[i] : off[i + 1]].tobytes()
        if not raw or h[2][i] % 100 >= plain_from or p in raw or s in raw or m in raw:
            form.append("plain")
            out.append(raw)
            continue
        whole, x, y = points[at[i] : at[i + 1]], ends[0][i], ends[1][i]
        a, mid, z = _text(whole[:x]), _text(whole[x:y]), _text(whole[y:])
        spm = h[3][i] % 100 < spm_below
        form.append("spm" if spm else "psm")
        out.append(s + z + p + a + m + mid if spm else p + a + s + z + m + mid)
    plain = pa.array([f == "plain" for f in form], pa.bool_())
    sizes = [pa.compute.if_else(plain, None, pa.array(x.astype(np.int64))) for x in (ends[0], ends[1] - ends[0])]
    texts = pa.array(out, pa.binary()).cast(pa.string(), safe=False) if out else pa.array([], pa.string())
    return pa.RecordBatch.from_arrays([*map(column, keep), pa.array(n.astype(np.int64)), pa.array(form, pa.string()), *sizes, texts], names=[*keep, "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = "char", fim_rate: int = 90, spm_rate: int = 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns, n, form, prefix_chars, middle_chars and output of every row of (doc_id, text).

    A text is n units (see `classes`); two cuts drawn from sha256 of `seed:doc_id` part it into prefix, middle and suffix. `fim_rate` per
    cent are rearranged, `spm_rate` per cent of these with the suffix first; the others, empty texts and texts with one of
    `MARKS` stay as they are (form plain, sizes null).

    A null text is empty, a null doc_id draws as the empty text does; rows of one doc_id draw alike. Texts of any length are cut whole,
    each alone if it is longer than a piece of 1 MB. No rows give no rows; other columns are left out whatever their names.
    """
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(hexes, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"), *draws)

    def run(batches):
        for b in slices(batches, "text"):
            yield _cut(b, unit, fim_rate, spm_rate, keep)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return mapped(rows, run, f"{schema}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text again, from form and output alone: a rearranged output holds each mark once."""
    p, s, m = MARKS
    after = lambda x, mark: F.substring_index(x, mark, -1)
    before = lambda x, mark: F.substring_index(x, mark, 1)
    psm = F.concat(after(before(output, s), p), after(output, m), after(before(output, m), s))
    spm = F.concat(after(before(output, m), p), after(output, m), after(before(output, p), s))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and sha256 of the output and of the text restored from it."""
    out = fill_in_middle(docs.select("doc_id", "text"))
    back = restored(F.col("form"), F.col("output"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
