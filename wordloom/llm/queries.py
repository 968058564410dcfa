"""Queries over the given tables, one for each operator of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.decontaminate import contamination_digest
from wordloom.llm.interpolated import lm_digest
from wordloom.llm.language import language_digest
from wordloom.llm.lattice_dedup import vector_links
from wordloom.llm.licenses import license_digest
from wordloom.llm.minhash import near_duplicates
from wordloom.llm.mixing import mixing_digest
from wordloom.llm.oracle import ORACLE
from wordloom.llm.pii import pii_digest
from wordloom.llm.quality import quality_digest
from wordloom.llm.sharding import sharding_digest
from wordloom.llm.spelling import spelling_digest
from wordloom.llm.suffix_dedup import suffix_digest
from wordloom.llm.vector_codes import codes_digest

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination_digest(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii_digest(table(spark, folder, "documents"))


def op5_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_digest(table(spark, folder, "documents"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing_digest(table(spark, folder, "documents"))


def op7_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return vector_links(table(spark, folder, "embeddings"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding_digest(table(spark, folder, "documents"))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_digest(table(spark, folder, "documents"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes_digest(table(spark, folder, "embeddings"))


def op12_language(spark: SparkSession, folder: str) -> DataFrame:
    return language_digest(table(spark, folder, "documents"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_digest(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_pii": op4_pii,
    "op5_suffixes": op5_suffixes,
    "op6_mixing": op6_mixing,
    "op7_lattice": op7_lattice,
    "op8_sharding": op8_sharding,
    "op9_licenses": op9_licenses,
    "op10_quality": op10_quality,
    "op11_vector_codes": op11_vector_codes,
    "op12_language": op12_language,
    "op13_spelling": op13_spelling,
}
