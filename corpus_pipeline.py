"""A training-data pipeline over the documents table, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import pipeline
from inkwell.llm.common import materialize, scratch, spent, table

STAGES = [
    ("language_id", pipeline.language_stage),
    ("line_dedup", pipeline.line_stage),
    ("ngram_jaccard_join", pipeline.jaccard_stage),
    ("decontamination", pipeline.decontamination_stage),
    ("best_fit_packing", pipeline.packing_stage),
]

#: SQL expresses neither the network of the first stage nor the packing of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again, and what its stage wrote besides is deleted."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        last = i == len(STAGES) - 1
        with scratch() as tables:
            out = stage(spark, docs, sf_dir)
            docs = out if last else materialize(out)
        if not last:
            spent(*(t for t in tables if t is not docs))
    return docs
