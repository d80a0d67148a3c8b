"""Report files of runs: tables as CSV folders, states as small JSON files of the driver."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files


def logger(name: str = "sparlane", level: str = "INFO", path: str | None = None) -> logging.Logger:
    """The engine's logger, on demand also to a file; a second call changes the level and adds no handler twice."""
    log = logging.getLogger(name)
    log.setLevel(level)
    kinds = {getattr(h, "baseFilename", None) for h in log.handlers}
    for h in [logging.FileHandler(path)] if path and os.path.abspath(path) not in kinds else [] if kinds or path else [logging.StreamHandler()]:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
    return log


def _plain(value):
    """Rows, nested ones too, as dictionaries."""
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@dataclass
class Reports:
    """Where a run writes. Without a prefix nothing is written; what would be is still told apart by `names`."""

    prefix: str | None = None
    names: list[str] = field(default_factory=list)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """A CSV folder <prefix>_<name>.csv; gives back the table. Structs are written as JSON text."""
        self.names.append(name)
        if self.prefix:
            files.write_csv(df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, (T.StructType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema]), f"{self.prefix}_{name}.csv")
        return df

    def state(self, name: str, content) -> None:
        """<prefix>_<name>.json, replaced as a whole, so a run that is killed leaves the last whole state."""
        self.names.append(name)
        if self.prefix:
            files.save_json(f"{self.prefix}_{name}.json", _plain(content))

    def statuses(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """A table with a row for each question (few): its state by `key`, rewritten after each row. Gives back the table."""
        done: dict = {}
        for r in rows.collect():
            done[r[key]] = {k: v for k, v in _plain(r).items() if k != key}
            self.state(name, done)
        return rows


def progress(spark: SparkSession, steps: Sequence[Mapping], features: Sequence[str], outputs: Sequence[str], objectives: Sequence[str]) -> DataFrame:
    """(step, <feature>..., <output>..., <objective>..., <objective>_scaled...) of the steps of a search; what a step lacks is null."""
    names = [*features, *outputs, *objectives, *(f"{o}_scaled" for o in objectives)]
    rows = [(i, *(None if s.get(n) is None else float(s[n]) for n in names)) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "step int, " + ", ".join(f"`{n}` double" for n in names))


def save_scaling(path: str, bounds: Mapping[str, tuple[float, float]]) -> None:
    files.save_json(path, {k: {"min": lo, "max": hi} for k, (lo, hi) in bounds.items()})


def load_scaling(path: str) -> dict[str, tuple[float, float]]:
    return {k: (v["min"], v["max"]) for k, v in files.load_json(path).items()}


def save_levels(path: str, levels: Mapping[str, DataFrame]) -> None:
    """Level maps (level, code) by column, each bounded by `prep.levels`."""
    files.save_json(path, {c: [r["level"] for r in m.orderBy("code").collect()] for c, m in levels.items()})


def load_levels(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {c: spark.createDataFrame([(x, i) for i, x in enumerate(values)], "level string, code int") for c, values in files.load_json(path).items()}


def save_missing(path: str, places: DataFrame, most: int = 1_000_000) -> None:
    """Rows with nulls by column as one JSON file; more than `most` places are an error (write the table instead)."""
    rows = places.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} missing values")
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["column"], []).append(r["row"])
    files.save_json(path, {k: sorted(v) for k, v in out.items()})
