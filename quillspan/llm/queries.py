"""The corpus operators applied to the tables of a folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import chat, credentials, decontam, extract, language, lines, mixing, periodic, pii, quality, repair, simhash, sketch
from quillspan.llm.oracle import ORACLE_SQL as ORACLE_SQL
from quillspan.sources.reading import table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.lines_query(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.privacy_query(_table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_query(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.pages_query(_table(spark, sf_dir, "pages"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_query(_table(spark, sf_dir, "conversations"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_query(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_query(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_query(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.runs_query(_table(spark, sf_dir, "documents"))


def op12_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.secrets_query(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_query(_table(spark, sf_dir, "conversations"))


OPERATORS = (op1_line_dedup, op2_pii, op3_fingerprints, op4_html_extraction, op5_chat_formatting, op6_source_mixing, op7_quality, op8_language, op9_simhash, op10_decontamination, op11_periodic_runs, op12_credentials, op13_conversation_repair)
QUERIES = {f.__name__: f for f in OPERATORS}
