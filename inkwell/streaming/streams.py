"""Streams: following growing journals, appending continuously, block assignment across batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.scan import enable


def tail(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of the components of closed blocks, as journals under ``path`` grow."""
    return enable(spark).readStream.format("journal").options(**options).load(path)


def append(rows: DataFrame, path: str, checkpoint: str, **options: str):
    """Starts a query that appends the writer's rows; each epoch is published once, on commit.

    Every block must lie in one micro-batch; rows are dealt to tasks by block.
    """
    enable(rows.sparkSession)
    return rows.repartition("block_no").writeStream.format("journal").options(path=path, checkpointLocation=checkpoint, **options).outputMode("append").trigger(availableNow=True).start()


ASSIGNED = "journal long, seq long, kind string, block_no long, comp_no int"
OPS = ["content", "atomic"]
#: Rows in a frame of the result.
ROWS = 1 << 16


def _assigned(ops: np.ndarray, block: int, comps: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(block_no and comp_no of each operation in order, next state); ops: places in OPS, -1 for a close, whose numbers mean nothing."""
    content = ops == 0
    after = np.concatenate([[comps >= 0], content[:-1]])  # whether a best-effort block is open before the row
    begins = (ops == 1) | (content & ~after)
    number = np.cumsum(begins) + (block if comps >= 0 else block - 1)
    at = np.arange(len(ops))
    first = np.maximum.accumulate(np.where(begins, at, -1))
    # Before the first block that begins here, content goes on in the open one.
    comp = np.where(first >= 0, at - first, at + comps + 1)
    if content[-1]:
        return number, comp, int(number[-1]), int(comp[-1])
    return number, comp, int(number[-1]) + 1, -1


def assign_blocks_stream(ops: DataFrame) -> DataFrame:
    """Tail state across micro-batches for each journal: (journal, seq, op) to block_no and comp_no.

    State of a journal: next block number, components of the open block (-1: none is open).
    A task holds some tens of bytes for each of a journal's rows in a micro-batch, which it sorts.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        block, comps = state.get if state.exists else (0, -1)
        seqs, codes = [], []
        for f in frames:
            seqs.append(f.seq.to_numpy(np.int64))
            codes.append(pd.Categorical(f.op, categories=OPS).codes.astype(np.int8))
        seq, code = np.concatenate(seqs), np.concatenate(codes)
        del seqs, codes
        order = np.argsort(seq, kind="stable")
        seq, code = seq[order], code[order]
        del order
        for i in range(0, len(seq), ROWS):
            part = code[i : i + ROWS]
            number, comp, block, comps = _assigned(part, block, comps)
            on = part >= 0
            yield pd.DataFrame({"journal": key[0], "seq": seq[i : i + ROWS][on], "kind": np.where(part[on] == 1, "A", "B"), "block_no": number[on], "comp_no": comp[on].astype(np.int32)})
        state.update((block, comps))

    return ops.groupBy("journal").applyInPandasWithState(step, ASSIGNED, "block long, comps int", "append", "NoTimeout")


def ts_violations(df: DataFrame, ts: str, order: str) -> DataFrame:
    """Rows whose time is before that of the row before them in the order."""
    from inkwell.operators.sequence import previous, ranged

    checked = previous(ranged(df, order), ts, "prev_ts", order)
    return checked.where(F.col(ts) < F.col("prev_ts")).drop("_part")
