"""Classes of I/O errors as a table joined to failed operations."""

from __future__ import annotations

import errno

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.retry import FATAL_CODES, FATAL_KINDS, TRANSIENT_CODES, TRANSIENT_KINDS


def classes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(by kind, by code of the operating system): class and variant of each known error."""
    kinds = [(k, fate, v) for fate, table in (("fatal", FATAL_KINDS), ("transient", TRANSIENT_KINDS)) for k, v in table.items()]
    codes = {getattr(errno, c): (fate, v) for fate, table in (("transient", TRANSIENT_CODES), ("fatal", FATAL_CODES)) for c, v in table.items() if hasattr(errno, c)}
    return (
        spark.createDataFrame(kinds, "kind string, class string, variant string"),
        spark.createDataFrame([(c, *x) for c, x in codes.items()], "code int, class string, variant string"),
    )


def categorized(failed: DataFrame, kind: str, code: str) -> DataFrame:
    """Adds class (fatal or transient) and variant. The kind decides before the code; what is unknown is
    transient. The lookups are a few fixed rows, hence broadcast."""
    kinds, codes = classes(failed.sparkSession)
    by_kind = kinds.select(F.col("kind").alias("_kind"), F.struct("class", "variant").alias("_first"))
    by_code = codes.select(F.col("code").alias("_code"), F.struct("class", "variant").alias("_second"))
    other = F.struct(F.lit("transient").alias("class"), F.when(F.col(code).isNotNull(), "Other").otherwise("IoError").alias("variant"))
    found = F.coalesce("_first", "_second", other)
    joined = failed.join(F.broadcast(by_kind), F.col(kind) == F.col("_kind"), "left").join(F.broadcast(by_code), F.col(code) == F.col("_code"), "left")
    return joined.select(*failed.columns, found["class"].alias("class"), found["variant"].alias("variant"))
