"""Registered queries of this subpackage and, where SQL expresses them, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import decontaminate as q4
from inkwell.llm import html as q8
from inkwell.llm import jaccard as q6
from inkwell.llm import language as q2
from inkwell.llm import lines as q3
from inkwell.llm import packing as q10
from inkwell.llm import quality as q1
from inkwell.llm import secrets as q9
from inkwell.llm import substrings as q5
from inkwell.llm import toxicity as q7
from inkwell.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q1.quality(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q2.evaluate_query(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q3.digest_query(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q4.digest_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q5.digest_query(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q6.jaccard_components(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q7.evaluate_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q8.extraction(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q9.digest_query(table(spark, sf_dir, "documents"))


#: A public byte-level vocabulary of 50,256 tokens; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q10.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_line_dedup, op4_decontamination, op5_substring_dedup, op6_ngram_jaccard_join, op7_toxicity, op8_html_extraction, op9_secret_scan, op10_best_fit_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": q1.oracle(), "op3_line_dedup": q3.oracle(), "op4_decontamination": q4.oracle(), "op5_substring_dedup": q5.oracle(), "op6_ngram_jaccard_join": q6.oracle()}
