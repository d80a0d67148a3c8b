"""Resampling towards a target distribution, by hashed n-grams and Spark SQL functions alone (operator 11)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

BUCKETS = 10_000
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, _NO_WORD), lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(n))))


def _grams(words: Column, longest: int) -> Column:
    """All runs of 1 to `longest` words, joined by one space."""
    return F.concat(words, *(_runs(words, n) for n in range(2, longest + 1)))


def _with_words(df: DataFrame, *keep: str | Column) -> DataFrame:
    """`keep` and the words of text. They pass through a generator, so that the expressions on them do not each split the text again."""
    return df.select(*keep, F.explode(F.array(_words(F.col("text")))).alias("words"))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.crc32(F.encode(gram, "UTF-8")) % buckets


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for each of the `buckets` buckets: how much more frequent it is in `target` than in `docs`, in thousandths of a natural log.

    Both counts are smoothed by one; counting is one aggregate with a partial sum in each task, so a frequent word is no hot key.
    """
    spark = docs.sparkSession
    features = lambda df: _with_words(df).select(F.explode(_grams(F.col("words"), longest)).alias("gram"))
    both = features(docs).select("gram", F.lit(1).alias("s"), F.lit(0).alias("t")).union(features(target).select("gram", F.lit(0), F.lit(1)))
    counts = written(both.groupBy(_bucket(F.col("gram"), buckets).alias("bucket")).agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = (number("t") + 1) * float(total.s + buckets) / ((number("s") + 1) * float(total.t + buckets))
    return spark.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def weights(docs: DataFrame, gains: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of (doc_id, text): weight is the floored mean gain of its features, 0 without any.

    `gains` is broadcast: it has one row for each bucket. Rows are summed by doc_id and a hash of the text; equal rows come out as often as they
    went in, so that no row number is needed.
    """
    words = _with_words(docs, "doc_id", F.xxhash64("text").alias("key"))
    rows = words.select("doc_id", "key", F.size("words").alias("n_words"), F.posexplode_outer(_grams(F.col("words"), longest)).alias("place", "gram"))
    known = rows.withColumn("bucket", _bucket(F.col("gram"), buckets)).join(F.broadcast(gains), "bucket", "left")
    first = F.coalesce(F.col("place"), F.lit(0)) == 0
    total = known.groupBy("doc_id", "key").agg(F.max("n_words").cast("long").alias("n_words"), F.sum(first.cast("long")).alias("copies"), F.count("gram").alias("all"), F.sum("gain").alias("gain"))
    n, gain = F.expr("all div copies"), F.expr("gain div copies")
    mean = F.when(F.col("all") == 0, F.lit(0).cast("long")).otherwise(F.expr("(g - pmod(g, n)) div n"))
    one = total.select("doc_id", "key", "n_words", "copies", "all", n.alias("n"), gain.alias("g"))
    return one.select("doc_id", "key", "n_words", F.col("n").alias("n_features"), mean.alias("weight"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, per_cent: int = 10, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of `docs`: a draw without replacement in proportion to exp(weight / 1000).

    score is the weight plus Gumbel noise from sha256 of `seed:doc_id`; of the rows with `least_words` words or more, the `per_cent` per cent of
    highest score are drawn and ranked 1, 2, ... (ties: the smaller doc_id, null last); rank is null for the others.

    A null text has no words, a null doc_id has the noise of the empty text, and equal rows have equal scores and ranks next to each other. Texts of
    any length are split whole. Empty `docs` give no rows; an empty `target` makes all gains follow from `docs` alone. Further columns are not read.

    Ranks come from a distributed sort: a row's place in its partition plus the rows of the partitions before it.
    """
    scored = weights(docs, bucket_gains(docs, target, longest, buckets), longest, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)
    table = written(scored.select("doc_id", "key", "copy", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")), "weights")
    able = F.col("n_words") >= least_words
    ordered = table.where(able).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "key", "copy")
    placed = written(ordered.select("doc_id", "n_features", "weight", "score", F.monotonically_increasing_id().alias("id")), "ranks")
    part = F.shiftrightunsigned("id", 33).alias("part")
    sizes = sorted(placed.groupBy(part).count().collect())  # one row for each partition of the sort
    starts, before = [], 0
    for p, n in sizes:
        starts.append((p, before))
        before += n
    offsets = docs.sparkSession.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = placed.withColumn("part", part).join(F.broadcast(offsets), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= per_cent * before // 100, rank).alias("rank"))
    return drawn.unionByName(table.where(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
