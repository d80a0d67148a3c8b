"""Shared-folder tables and connected components for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def mapped(df: DataFrame, f: Callable, schema) -> DataFrame:
    """mapInArrow by a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where all is one machine, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sparlane-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/sparlane-{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session's setting for the jobs that run inside; then it is as before."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    # the table holds all that is read later
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table from `written` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/sparlane-" in path:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stars(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(a, b) long pairs -> pairs (a > b) that reach the same nodes: in the end each node of a component with its least one.

    Alternates large-star and small-star steps; each round is written to the shared folder. `edges` is read twice. Stops when the
    edge set no longer changes, or after `rounds`. Self-loops and repeated pairs are allowed; nulls are not.
    """
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    before, state, done = None, None, 0
    while rounds is None or done < rounds:
        done += 1
        # dealt by node once for each step: least neighbours, their join and the distinct edges all use that
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition("a")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").repartition("a")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.distinct().join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e"))
        nxt = written(small.select("e.*").where("x <> y").distinct().toDF("a", "b"), "edges")
        if before is not None:
            discard(before)
        before = cur = nxt
        if rounds is None:
            now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == state:
                break
            state = now
    return cur


def pointed(pairs: DataFrame) -> DataFrame:
    """(a, b) of `stars` -> (node, component). Of `stars` that stopped early a component is some node that the links reach: nodes of one
    component are linked, but linked nodes may still be in several."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component"))))
    return pairs.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.min("component").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, component): the least node that the links reach, for nodes with a link."""
    return pointed(stars(edges))


def _blobs(kind):
    def run(rows):
        total: dict = {}
        for r in rows:
            x = np.frombuffer(r[1], kind)
            total[r[0]] = total[r[0]] + x if r[0] in total else x
        yield total

    return run


def _merge(a: dict, b: dict) -> dict:
    return a | b | {k: a[k] + b[k] for k in a.keys() & b.keys()}


def tree_total(df: DataFrame, kind) -> dict:
    """Sums arrays of one length by key over (key, blob) rows, in a tree of partitions; only the total reaches the driver."""
    rdd = df.rdd.mapPartitions(_blobs(kind))
    return rdd.treeAggregate({}, _merge, _merge, depth=2 if rdd.getNumPartitions() < 1000 else 3)
