"""The queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .counts import token_counts
from .decontaminate import report
from .extract import main_text
from .importance import resampled
from .language import identify
from .middle import digest as middle_digest
from .near import near_documents
from .packing import pack_documents
from .quality import quality
from .recurrent import language_model
from .repair import token_file
from .repeats import digest
from .vectors import near_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_recurrent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(_table(spark, sf_dir, "documents"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_deep_shallow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(_table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file(_table(spark, sf_dir, "documents"))


def op6_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(_table(spark, sf_dir, "documents")).drop("row_key")


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_host_suffix_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_recurrent_scoring, op2_cross_polytope, op3_suffix_array_decontamination, op4_deep_shallow_dedup, op5_token_output, op6_factorisation_machine, op7_order_minhash, op8_sum_of_squares_packing, op9_token_counts, op10_language_id, op11_importance_resampling, op12_host_suffix_extraction, op13_fill_in_middle)
}
ORACLE_SQL: dict[str, str] = {
    "op2_cross_polytope": oracle.NEAR_VECTORS,
    "op3_suffix_array_decontamination": oracle.DECONTAMINATION,
    "op4_deep_shallow_dedup": oracle.REPEATS,
    "op11_importance_resampling": oracle.RESAMPLING,
    "op13_fill_in_middle": oracle.FILL_IN_MIDDLE,
}
