"""Operators on streams: expression scoring and windowed measures over events, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as ex


def score(stream: DataFrame, system: Mapping[str, str]) -> DataFrame:
    """Adds outputs of expressions; stateless, so any output mode does."""
    return stream.withColumns({n: ex.column(e) for n, e in system.items()})


def windowed(stream: DataFrame, time: str, value: str, keys: list[str], window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Count, least, greatest and mean by tumbling window and keys; rows later than `late` are dropped."""
    g = stream.withWatermark(time, late).groupBy(F.window(time, window), *keys)
    return g.agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), *keys, "n", "least", "greatest", "mean")


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """A query that applies a batch operator to each micro-batch and writes it under its number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
