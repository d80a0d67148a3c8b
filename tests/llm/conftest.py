import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

COPY = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew a strange potion under the pale autumn moon tonight. "
#: Columns whose names the operators use inside.
CLASH = ["k", "key", "h", "c", "uid", "rid", "grp", "kind", "blob", "tag", "doc", "shard", "length", "offset", "rest", "row_key", "n", "held_out", "score"]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, blank, very long and repeated rows, ties, odd characters, and columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, COPY * 3, "en"), (2, COPY * 3, "en"), (3, None, None), (4, "", "en"), (5, "   \n\t ", "de"), (None, "a text without an id " + COPY, None),
        (6, long, "en"), (7, "é", "fr"), (8, "12 34 !!", None), (9, COPY * 3 + " and one more sentence here", "en"), (9, "second row of nine", "de"), (1, COPY * 3, "en"),
        (10, "\x1c odd   blanks　here \U0001f600 <|endoftext|>", "fr"), (11, "x", None), (12, "ΑΒΓ ναι", "el"), (-5, "tiny text", "en"),
    ]
    df = spark.createDataFrame([Row(doc_id=a, text=b, lang=c, source="s", n_chars=None if b is None else len(b)) for a, b, c in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in CLASH}).repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
