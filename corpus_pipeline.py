"""The corpus pipeline: from `documents` to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a DataFrame; all but the last
return the columns of documents. `run` writes each result as Parquet and reads it again. In all stages a null text is empty, a null
doc_id is a document of its own, an empty table gives no rows, and further columns are carried along under whatever name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparlane.llm.decontaminate import decontaminate
from sparlane.llm.language import accepted
from sparlane.llm.near import one_of_each
from sparlane.llm.packing import pack_documents
from sparlane.llm.repeats import without_repeats
from sparlane.llm.shared import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language: with a letter, and one language that holds half of the text or more.

    Null, empty and letterless texts go. A null lang is not learned from. Of languages with one likelihood the first name leads.
    Very long texts are read whole; repeated rows all stay or all go.
    """
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least doc_id (null last), then the least hash of the text.

    Words with an edit similarity of 0.8 or more link two texts, of whatever length. Of repeated rows one stays. A text without
    words is a group of its own.
    """
    return one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a document with a smaller doc_id also has; n_chars becomes the new length.

    All documents stay, an emptied one with an empty text, as does a null one. Null doc_ids count as greatest; rows of one doc_id
    take nothing from each other. A character that a cut would split stays whole.
    """
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window: ten words of an item in a row, or all words of a shorter one.

    Null and empty texts hold none and stay. Null test texts are left out; repeated rows all stay or all go.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with the end id. Repeated rows are packed each; pieces of one length keep the order of doc_id.
    """
    return pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: No SQL expresses the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
