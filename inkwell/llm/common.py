"""Helpers shared by the training-data operators: loading, shared storage, Arrow buffers."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: With this setting Spark deletes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, rows are fixed, and the
    shuffle files behind them are freed at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # planned anew, under the setting
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    for held in _held:
        held.append(out)
    return out


_held: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """A list of all tables written meanwhile."""
    _held.append(tables := [])
    try:
        yield tables
    finally:
        _held[:] = [x for x in _held if x is not tables]


def spent(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote and that nothing will read again."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def id_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that no other column can clash."""
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))


def fresh(name: str, taken) -> str:
    """``name``, with as many underscores after it as it takes to differ from all columns in ``taken``."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def fold(key: str, n: int):
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(F.col(key).cast("string")) % F.lit(n)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64, bytes) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows of about ``most`` bytes; a longer row is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def sampled(df: DataFrame, key: str, most: int, label: str | None = None, seed: int = 17) -> DataFrame:
    """About ``most`` rows of each label by a hash of the id, never more than twice that in expectation.

    The share is fixed from a count of all labelled rows, so the sample's size does not grow
    with the input and no ordering or per-task top list is needed.
    """
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30))
    if label is None:
        n = df.count()
        return df.where(h < F.lit(int(min(1.0, most / max(n, 1)) * (1 << 30)) + 1))
    counts = df.groupBy(label).count().collect()
    rule = F.lit(False)
    for row in counts:
        share = int(min(1.0, most / row["count"]) * (1 << 30)) + 1
        rule = rule | ((F.col(label) == F.lit(row[label])) & (h < F.lit(share)))
    return df.where(rule)
