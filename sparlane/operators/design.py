"""Designs of experiments as DataFrames. Levels are a mapping of factor to values; two-level designs use least and greatest."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import value_ranks

Levels = Mapping[str, Sequence[float]]


def two_levels(levels: Levels) -> dict[str, list[float]]:
    return {k: [min(v), max(v)] for k, v in levels.items()}


def clean(levels: Levels) -> dict[str, list[float]]:
    return {k: sorted({float(x) for x in v if x is not None}) for k, v in levels.items()}


def full_factorial(spark: SparkSession, levels: Levels) -> DataFrame:
    """Every combination; the rows are made on the executors by one explode for each factor."""
    out = spark.range(1).select()
    for k, v in clean(levels).items():
        out = out.select("*", F.explode(F.array(*map(F.lit, v))).alias(k))
    return out


def _decoded(spark: SparkSession, coded: list[tuple[float, ...]], levels: Levels) -> DataFrame:
    """Rows of codes (-1 low, 0 middle, 1 high, others in proportion) in the factors' own units; the codes are small literals."""
    ends = {k: (min(v), max(v)) for k, v in clean(levels).items()}
    rows = [tuple((lo + hi) / 2 + c * (hi - lo) / 2 for c, (lo, hi) in zip(r, ends.values(), strict=True)) for r in coded]
    return spark.createDataFrame(rows, ", ".join(f"`{k}` double" for k in ends))


#: Products tried for one number of base factors; a search that goes on longer is an error, not a larger fraction.
TRIES = 2_000_000


def generators(factors: int, resolution: int, most: int = 16) -> tuple[int, list[tuple[int, ...]]]:
    """Base factors, and for each other factor the set of base factors whose product it is: the smallest fraction of the resolution.

    The resolution is the length of the shortest word of the whole defining group: every product of generators is tested.
    """
    for base in range(1, factors + 1):
        words = sorted((sum(1 << i for i in w) for n in range(resolution - 1, base + 1) for w in itertools.combinations(range(base), n)), key=lambda w: (w.bit_count(), w))
        tries = 0

        def extend(chosen: list[int], group: list[int], start: int, base=base, words=words) -> list[int] | None:
            nonlocal tries
            if len(chosen) == factors - base:
                return chosen
            for i in range(start, len(words)):
                tries += 1
                if tries > TRIES:
                    raise ValueError(f"{factors} factors at resolution {resolution}: no answer on {base} base factors after {TRIES} tries")
                new = [g ^ words[i] ^ 1 << base + len(chosen) for g in group]
                if all(g.bit_count() >= resolution for g in new) and (out := extend([*chosen, words[i]], group + new, i + 1)) is not None:
                    return out
            return None

        if (got := extend([], [0], 0)) is not None:
            return base, [tuple(i for i in range(base) if w >> i & 1) for w in got]
        if base >= most:
            break
    raise ValueError(f"no fraction of {factors} factors with resolution {resolution} was found")


def fractional_factorial(spark: SparkSession, levels: Levels, resolution: int = 3) -> DataFrame:
    """A two-level fraction of at least the given resolution: base factors in full, each other factor a product of them (`generators`)."""
    base, words = generators(len(levels), resolution)
    coded = []
    for r in itertools.product((-1, 1), repeat=base):
        r = r[::-1]
        coded.append((*r, *(math.prod(r[i] for i in w) for w in words)))
    return _decoded(spark, coded, levels)


#: First rows of the cyclic designs; fixed values of the method. Other sizes that are powers of two come from Sylvester's construction.
_CYCLES = {12: "++-+++---+-", 20: "++--++++-+-+----++-", 24: "+++++-+-++--++--+-+----"}


def plackett_burman(spark: SparkSession, levels: Levels) -> DataFrame:
    k = len(levels)
    n = 4 * (k // 4 + 1)
    while n & (n - 1) and n not in _CYCLES:
        n += 4
    if n in _CYCLES:
        c = [1 if x == "+" else -1 for x in _CYCLES[n]]
        rows = [tuple(c[(j - i) % (n - 1)] for j in range(k)) for i in range(n - 1)] + [(-1,) * k]
    else:
        rows = [tuple(-1 if bin(i & j).count("1") % 2 else 1 for j in range(1, k + 1)) for i in range(n)]
    return _decoded(spark, rows, levels)


def sukharev(spark: SparkSession, levels: Levels, points: int) -> DataFrame:
    """Centers of a grid with as many cells a side as give `points` or fewer in all."""
    side = max(1, int(round(points ** (1 / len(levels)), 9)))
    return full_factorial(spark, {k: [min(v) + (max(v) - min(v)) * (i + 0.5) / side for i in range(side)] for k, v in clean(levels).items()})


def box_behnken(spark: SparkSession, levels: Levels, centers: int = 1) -> DataFrame:
    k = len(levels)
    rows = []
    for i, j in itertools.combinations(range(k), 2):
        for a, b in itertools.product((-1, 1), repeat=2):
            r = [0] * k
            r[i], r[j] = a, b
            rows.append(tuple(r))
    return _decoded(spark, rows + [(0,) * k] * centers, levels)


def central_composite(spark: SparkSession, levels: Levels, center: tuple[int, int] = (4, 4), alpha: str = "o", face: str = "ccc") -> DataFrame:
    """Corners, axial points and centers. alpha: r rotatable, o orthogonal; face: ccc circumscribed, cci inscribed, ccf faced."""
    k = len(levels)
    nc, na = 2**k, 2 * k
    if alpha == "r":
        a = nc**0.25
    else:
        a = math.sqrt(k * (1 + center[1] / na) / (1 + center[0] / nc))
    if face == "ccf":
        a = 1.0
    inner = 1 / a if face == "cci" else 1.0
    rows = [tuple(x * inner for x in r) for r in itertools.product((-1, 1), repeat=k)] + [(0.0,) * k] * center[0]
    for i in range(k):
        for s in (-1, 1):
            r = [0.0] * k
            r[i] = s * a * inner
            rows.append(tuple(r))
    return _decoded(spark, rows + [(0.0,) * k] * center[1], levels)


def _between(levels: Levels, unit: Mapping[str, Column]) -> list[Column]:
    return [(F.lit(float(min(v))) + unit[k] * F.lit(float(max(v)) - float(min(v)))).alias(k) for k, v in clean(levels).items()]


def uniform_random(spark: SparkSession, levels: Levels, n: int, seed: int = 17) -> DataFrame:
    return spark.range(n).select(*_between(levels, {k: F.rand(seed + i) for i, k in enumerate(levels)}))


def halton(spark: SparkSession, levels: Levels, n: int, skip: int = 1) -> DataFrame:
    """Halton points from number `skip` on: radical inverses of the row's number in the first primes."""
    primes = [p for p in range(2, 2000) if all(p % d for d in range(2, math.isqrt(p) + 1))]

    def inverse(base: int) -> Column:
        digits = math.ceil(math.log(max(2, n + skip), base)) + 1
        at = F.col("id")
        return sum((F.pmod(F.floor(at / F.lit(base**i)), F.lit(base)) * F.lit(1.0 / base ** (i + 1)) for i in range(1, digits)), F.pmod(at, F.lit(base)) * F.lit(1.0 / base))

    return spark.range(skip, n + skip).select(*_between(levels, {k: inverse(primes[i]) for i, k in enumerate(levels)}))


def latin_hypercube(spark: SparkSession, levels: Levels, n: int, seed: int = 17, jitter: bool = True) -> DataFrame:
    """n points, one in each of n strata of every factor: the stratum is the rank of a hash of the row's number."""
    out = spark.range(n)
    for i in range(len(levels)):
        ids = spark.range(n).select(F.col("id").alias("_id"), F.xxhash64("id", F.lit(seed * 1009 + i)).alias("_h"))
        ranks = value_ranks(ids, "_h").select(F.col("v").alias("_v"), (F.col("dense") - 1).alias(f"_r{i}"))
        out = out.withColumn("_v", F.xxhash64("id", F.lit(seed * 1009 + i))).join(ranks, "_v").drop("_v")
    units = {k: (F.col(f"_r{i}") + (F.rand(seed + i) if jitter else F.lit(0.5))) / F.lit(float(n)) for i, k in enumerate(levels)}
    return out.select(*_between(levels, units))


def _least_distance(df: DataFrame, levels: Levels) -> float:
    names = list(levels)
    ids = df.withColumn("_i", F.monotonically_increasing_id())
    scale = {k: (max(v) - min(v)) or 1.0 for k, v in clean(levels).items()}
    d = reduce(lambda a, b: a + b, [F.pow((F.col(f"a.`{k}`") - F.col(f"b.`{k}`")) / scale[k], F.lit(2)) for k in names])
    return ids.alias("a").join(ids.alias("b"), F.col("a._i") < F.col("b._i")).agg(F.min(d)).first()[0] or 0.0


def space_filling(spark: SparkSession, levels: Levels, n: int, tries: int = 5, seed: int = 17) -> DataFrame:
    """Of several Latin hypercubes the one whose nearest points are farthest apart. For designs of some thousands of points at most."""
    designs = [latin_hypercube(spark, levels, n, seed + 101 * t) for t in range(tries)]
    return max(designs, key=lambda d: _least_distance(d, levels))


def random_kmeans(spark: SparkSession, levels: Levels, n: int, seed: int = 17, factor: int = 20) -> DataFrame:
    """Centers of n clusters of uniform random points."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    pts = VectorAssembler(inputCols=list(levels), outputCol="_v").transform(uniform_random(spark, levels, n * factor, seed))
    m = KMeans(k=n, seed=seed, featuresCol="_v", maxIter=20).fit(pts)
    return spark.createDataFrame([tuple(map(float, c)) for c in m.clusterCenters()], ", ".join(f"`{k}` double" for k in levels))


def maximin(spark: SparkSession, levels: Levels, n: int, seed: int = 17, factor: int = 20) -> DataFrame:
    """n of the Halton points chosen in turn, each the farthest from those before. A driver loop over n * factor small rows."""
    import numpy as np

    pts = np.array([tuple(r) for r in halton(spark, levels, n * factor, seed).collect()])
    span = np.maximum(np.ptp(pts, axis=0), 1e-300)
    unit = (pts - pts.min(0)) / span
    chosen, far = [0], ((unit - unit[0]) ** 2).sum(1)
    for _ in range(n - 1):
        i = int(far.argmax())
        chosen.append(i)
        far = np.minimum(far, ((unit - unit[i]) ** 2).sum(1))
    return spark.createDataFrame([tuple(map(float, pts[i])) for i in chosen], ", ".join(f"`{k}` double" for k in levels))


DESIGNS = {f.__name__: f for f in (full_factorial, fractional_factorial, plackett_burman, sukharev, box_behnken, central_composite, latin_hypercube, space_filling, random_kmeans, maximin, halton, uniform_random)}
