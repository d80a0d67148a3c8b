"""Readers and writers: labelled tables, level tables, domain files, traces, JSON side files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = ("", ".csv", ".csv.gz", ".csv.bz2", ".gz", ".bz2", ".parquet")


def resolve(path: str) -> str:
    """The path itself, or with the first known suffix that exists; a path with a scheme is taken as it is."""
    if "://" in path:
        return path
    return next((path + s for s in SUFFIXES if os.path.exists(path + s)), path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, nulls: str = "NA") -> DataFrame:
    """CSV with a header (plain, gz or bz2) or Parquet; NaN becomes null. Types are inferred where no schema is given.

    A row with more or fewer values than the header has is an error.
    """
    path = resolve(path)
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        r = spark.read.option("header", True).option("nullValue", nulls).option("mode", "FAILFAST").option("enforceSchema", False)
        df = r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers; arrays are joined by `~~`."""
    flat = [F.array_join(F.col(f"`{f.name}`").cast("array<string>"), "~~").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def read_levels(df: DataFrame) -> dict[str, list[float]]:
    """Levels of a design by column: distinct values in ascending order, nulls left out. Columns are few and short."""
    row = df.agg(*[F.sort_array(F.collect_set(F.col(f"`{c}`").cast("double"))).alias(c) for c in df.columns]).first()
    return row.asDict()


def parse_domain(text: str) -> dict[str, tuple | list]:
    """`NAME -- [a, b]` (an interval, empty sides unbounded) or `NAME -- {a, b}` (a list), one for each line; exact fractions."""
    out: dict[str, tuple | list] = {}
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if not line:
            continue
        m = re.fullmatch(r"(\S+)\s*--\s*([\[{])(.*)[\]}]", line)
        if not m:
            raise ValueError(f"no domain: {line!r}")
        values = [Fraction(x.strip()) if x.strip() not in ("", "-inf", "inf") else None for x in m[3].split(",")]
        if m[2] == "[" and len(values) != 2:
            raise ValueError(f"an interval has two ends: {line!r}")
        out[m[1]] = tuple(values) if m[2] == "[" else values
    return out


def rational(column):
    """A string `p/q` or a decimal as a double; null if it is neither or q is 0."""
    parts = F.split(column, "/")
    return F.when(F.size(parts) == 2, F.try_divide(parts[0].cast("double"), parts[1].cast("double"))).otherwise(column.try_cast("double"))


def denormalise(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Columns in [0, 1] back in their own ranges."""
    return df.withColumns({c: F.lit(lo) + (F.lit(hi) - F.lit(lo)) * F.col(f"`{c}`") for c, (lo, hi) in bounds.items()})


def trace_records(spark: SparkSession, path: str, kinds: Iterable[str] = ("r", "a", "b", "u")) -> DataFrame:
    """(line, kind, fields, record) of a ragged comma-separated trace. `record` counts the `r` lines up to a line.

    Lines are numbered by their place in the file, so one file is read in one task, as its order means something.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "text")).where("text <> ''")
    cut = lines.select("line", F.split("text", ",").alias("f")).select("line", F.col("f")[0].alias("kind"), F.slice("f", 2, 1000).alias("fields"))
    return cut.where(F.col("kind").isin(*kinds)).selectExpr("line", "kind", "fields", "count_if(kind = 'r') OVER (ORDER BY line ROWS UNBOUNDED PRECEDING) AS record")


def anonymised(df: DataFrame, keep: Iterable[str] = (), digits: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Columns renamed to x0, x1, ... but for `keep`, doubles rounded; with the new names of the old."""
    keep = set(keep)
    new = {c: f"x{i}" for i, c in enumerate(c for c in df.columns if c not in keep)}
    out = df.withColumnsRenamed(new)
    if digits is not None:
        out = out.withColumns({f.name: F.round(f.name, digits) for f in out.schema if isinstance(f.dataType, T.DoubleType)})
    return out, new


def _place(path: str):
    """The file system of a path as Spark sees it, and the path in it; None without a session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None, None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def save_json(path: str, content) -> None:
    """A small side file: bounds, levels, features, status. It is replaced as a whole, where Spark's own tables are: in whatever store the path names."""
    text = json.dumps(content, indent=1, sort_keys=True, default=float)
    fs, at = _place(path)
    if fs is None:
        with open(path, "w") as f:
            f.write(text)
        return
    new = at.suffix(".new")
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(at, False)
    if not fs.rename(new, at):
        raise OSError(f"{path} cannot be replaced")


def load_json(path: str):
    spark = SparkSession.getActiveSession()
    if spark is None:
        with open(path) as f:
            return json.load(f)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def there(path: str) -> bool:
    """Whether a file or folder exists in the store that the path names."""
    fs, at = _place(path)
    return os.path.exists(path) if fs is None else fs.exists(at)


def options(defaults: Mapping, saved: Mapping | None = None, given: Mapping | None = None) -> dict:
    """Run options: given ones before saved ones before defaults; unknown names are errors."""
    out = dict(defaults)
    for layer in (saved or {}, given or {}):
        if unknown := set(layer) - set(defaults):
            raise ValueError(f"unknown options: {sorted(unknown)}")
        out |= {k: v for k, v in layer.items() if v is not None}
    return out


def output_prefix(folder: str | None, data: str | None, run: str | None = None) -> str:
    """Where the reports of a run begin: folder, run name and the data's own name."""
    base = re.sub(r"\.(csv|parquet|gz|bz2)", "", os.path.basename(data.rstrip("/"))) if data else ""
    return os.path.join(folder or ".", "_".join(x for x in (run, base) if x))
