"""Stages that apply the operators to the documents table, each keeping its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, jaccard, language, lines, packing
from inkwell.llm.common import fold, fresh, table

#: Documents whose most likely language scores below this are rejected.
LEAST_SCORE = 0.35
#: Near duplicates of a stage: five-word shingles, a similarity of 0.8 or more.
WIDTH, PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; ``und`` and doubtful ones go."""
    model = language.train(docs.where(fold("doc_id", 4) != 2))
    names = docs.columns
    out = language.identify(docs, model, carry=tuple(c for c in names if c != "doc_id"))
    return out.where((F.col(fresh("lang_pred", names)) != "und") & (F.col(fresh("score", names)) >= LEAST_SCORE)).select(*names)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in their first document only; documents that lose every word go."""
    out = lines.line_dedup(docs)
    dropped = F.col(fresh("n_dropped", docs.columns)) > 0
    emptied = dropped & (F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) == 0)
    n_chars = F.when(dropped, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.where(~emptied).withColumn("n_chars", n_chars).select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the smallest id.

    Of several rows of one id the first in order of text stays; rows without an id all stay.
    """
    found = jaccard.jaccard_components(docs, width=WIDTH, percent=PERCENT)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    known = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *(c for c in docs.columns if c not in ("doc_id", "text"))))
    nth = fresh("nth", docs.columns)
    return known.withColumn(nth, first).where(F.col(nth) == 1).select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of ten words, or a whole shorter item, with the benchmark go."""
    names = docs.columns
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=tuple(c for c in names if c != "doc_id"))
    return out.where(F.size(fresh("spans", names)) == 0).select(*names)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of the permitted lengths."""
    from inkwell.llm.queries import VOCABULARY

    return packing.pack_documents(docs, VOCABULARY)
