"""Error correction over tables of content: parity, detection, correction, damage classes.

Detection recomputes parity for whole batches with table gathers; chunks that differ are decoded
together, a batch in each step. Everything runs where the rows lie, in one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import rs


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary column without nulls."""
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def _cut(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, chunk number, start, length) of all chunks."""
    k = rs.data_size(n)
    size = np.diff(offsets)
    count = -(-size // k)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][row] + nth * k
    return row, nth, start, np.minimum(k, size[row] - nth * k)


def parity(df: DataFrame, key: str, content: str, n: int = 4) -> DataFrame:
    """key, chunk_no, chunk_len and parity of every chunk of content."""

    def run(batches):
        for b in batches:
            offsets, data = _bytes(b.column(content))
            row, nth, start, size = _cut(offsets, n)
            p = rs.parity_of_chunks(data, start, size, n)
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(pa.array(row)), pa.array(nth, pa.int32()), pa.array(size, pa.int32()), pa.array([x.tobytes() for x in p], pa.binary())],
                [key, "chunk_no", "chunk_len", "parity"],
            )

    return df.select(F.col(key).cast("long").alias(key), F.col(content).cast("binary").alias(content)).mapInArrow(run, f"`{key}` long, chunk_no int, chunk_len int, parity binary")


def with_parity(df: DataFrame, key: str, content: str, n: int = 4) -> DataFrame:
    """Adds ``parity``: of all chunks of content, one after another."""

    def run(batches):
        for b in batches:
            offsets, data = _bytes(b.column(content))
            row, _, start, size = _cut(offsets, n)
            p = rs.parity_of_chunks(data, start, size, n)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(content), pa.array([p[ends[i] : ends[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], [key, content, "parity"])

    return df.select(F.col(key).cast("long").alias(key), F.col(content).cast("binary").alias(content)).mapInArrow(run, f"`{key}` long, `{content}` binary, parity binary")


def plant(content: Column, errors: Column, n: int = 4) -> Column:
    """Content with the first ``errors`` bytes of every chunk inverted; for tests of repair."""
    k = rs.data_size(n)
    raw = F.hex(content)

    def damaged(i: Column) -> Column:
        chunk = F.substring(raw, i * (2 * k) + 1, F.lit(2 * k))
        m = F.least(errors, (F.length(chunk) / 2).cast("int"))
        flipped = F.translate(F.substring(chunk, F.lit(1), m * 2), "0123456789ABCDEF", "FEDCBA9876543210")
        return F.concat(flipped, F.substring(chunk, m * 2 + 1, F.lit(2 * k)))

    count = F.ceil(F.length(raw) / (2 * k)).cast("int")
    whole = F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(0), count - 1), damaged), "")).otherwise(F.lit(""))
    return F.unhex(whole)


def _mended(b: pa.RecordBatch, content: str, parity_col: str, n: int):
    """(offsets, bytes after repair, row, chunk number, start, length, errors, dirty) of a batch's chunks."""
    offsets, data = _bytes(b.column(content))
    poff, pdata = _bytes(b.column(parity_col))
    row, nth, start, size = _cut(offsets, n)
    at = poff[:-1][row] + nth * n
    have = pdata[at[:, None] + np.arange(n)] if len(at) else np.empty((0, n), np.uint8)
    data = data.copy()
    errors, dirty = rs.correct_chunks(data, start, size, have)
    return offsets, data, row, nth, start, size, errors, dirty


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary array over one buffer."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _three(df: DataFrame, key: str, content: str, parity_col: str) -> list[Column]:
    return [F.col(key).cast("long").alias(key), F.col(content).cast("binary").alias(content), F.col(parity_col).cast("binary").alias(parity_col)]


def correct(df: DataFrame, key: str, content: str, parity_col: str = "parity", n: int = 4) -> DataFrame:
    """key, chunk_no, chunk_start, chunk_len, dirty, errors (corrected bytes, -1 beyond repair) and data after repair."""

    def run(batches):
        for b in batches:
            offsets, data, row, nth, start, size, errors, dirty = _mended(b, content, parity_col, n)
            chunks = _binary(np.append(start, offsets[-1]), data)  # chunks follow each other without gaps
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(pa.array(row)), pa.array(nth, pa.int32()), pa.array(start - offsets[:-1][row], pa.int64()), pa.array(size, pa.int32()), pa.array(dirty), pa.array(errors), chunks],
                [key, "chunk_no", "chunk_start", "chunk_len", "dirty", "errors", "data"],
            )

    return df.select(*_three(df, key, content, parity_col)).mapInArrow(run, f"`{key}` long, chunk_no int, chunk_start long, chunk_len int, dirty boolean, errors int, data binary")


def repaired(df: DataFrame, key: str, content: str, parity_col: str = "parity", n: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, carried columns, whole content after repair, errors (bytes corrected) and damaged (chunks beyond repair) of every row."""

    def run(batches):
        for b in batches:
            offsets, data, row, _, _, _, errors, _ = _mended(b, content, parity_col, n)
            count = lambda w: pa.array(np.bincount(row, w, b.num_rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(key), *(b.column(c) for c in carry), _binary(offsets, data), count(np.maximum(errors, 0)), count(errors < 0)], [key, *carry, content, "errors", "damaged"]
            )

    src = df.select(*_three(df, key, content, parity_col), *carry)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.select(*carry).schema)
    return src.mapInArrow(run, f"`{key}` long, {kinds}`{content}` binary, errors long, damaged long")


def two_phase(df: DataFrame, key: str, content: str, digest: str, n: int = 4) -> DataFrame:
    """Hash first, codewords only where it differs, and hash again after repair: a decoder beyond its
    radius may find a wrong codeword, so a repair counts only if the hash agrees.

    key, first_ok, errors, damaged (chunks beyond repair) and repaired_ok, in one pass over the rows.
    """
    same = lambda c: F.sha2(c, 256) == F.col(digest)
    # Rows that agree go through with no content, hence no chunks to check.
    first = df.select(key, "parity", digest, F.col(content).cast("binary").alias(content)).withColumn("first_ok", F.coalesce(same(F.col(content)), F.lit(False)))
    fixed = repaired(first.withColumn(content, F.when(~F.col("first_ok"), F.col(content))), key, content, n=n, carry=(digest, "first_ok"))
    again = F.col("first_ok") | F.coalesce(same(F.col(content)), F.lit(False))
    return fixed.select(key, "first_ok", "errors", "damaged", again.alias("repaired_ok"))
