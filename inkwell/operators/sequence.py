"""Running values over one global order without gathering the table in one task.

Rows are ranged by the order key and written, so that partitions are fixed; windows run inside
each partition, and what is carried across partition borders comes from one summary row for
each partition. Only those summaries, as many as partitions, meet in one window and are broadcast.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import shared_dir

PART = "_part"


def fixed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """Rows in ranges of the order key, with the range's number; fixed only once written."""
    return df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id())


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """Rows in ranges of the order key, with the range's number, written."""
    return fixed(in_ranges(df, *order))


def local_window(*order: str):
    return Window.partitionBy(PART).orderBy(*order)


def _carried(parts: DataFrame, carried: dict[str, Column]) -> DataFrame:
    return parts.select(PART, *(c.alias(n) for n, c in carried.items()))


def running_sum(df: DataFrame, value: str, out: str, *order: str) -> DataFrame:
    """Sum of ``value`` over all rows before each row in the order (zero for the first); ``df`` is ranged."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = _carried(df.groupBy(PART).agg(F.sum(value).alias("s")), {"_carry": F.coalesce(F.sum("s").over(before), F.lit(0))})
    w = local_window(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(F.broadcast(sums), PART).withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)) + F.col("_carry")).drop("_carry")


def previous(df: DataFrame, value: str, out: str, order: str) -> DataFrame:
    """``value`` of the row before each row in the order, null for the first; ``df`` is ranged."""
    last = _carried(df.groupBy(PART).agg(F.max_by(value, order).alias("v")), {"_carry": F.lag("v").over(Window.orderBy(PART))})
    w = local_window(order)
    # The carried value is for the first row of a range only: elsewhere a null is the value itself.
    before = F.when(F.row_number().over(w) == 1, F.col("_carry")).otherwise(F.lag(value).over(w))
    return df.join(F.broadcast(last), PART).withColumn(out, before).drop("_carry")


def running_max(df: DataFrame, value: str, out: str, *order: str) -> DataFrame:
    """Largest ``value`` so far in the order, this row included; ``df`` is ranged."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    tops = _carried(df.groupBy(PART).agg(F.max(value).alias("v")), {"_carry": F.max("v").over(before)})
    w = local_window(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(F.broadcast(tops), PART).withColumn(out, F.greatest(F.max(value).over(w), F.col("_carry"))).drop("_carry")
