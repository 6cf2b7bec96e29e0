"""Integrity reports and tail recovery plans as queries over parsed blocks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.journal import _layout, _open, _Options, recover_file, recovered, segments


def integrity_summary(blocks: DataFrame) -> DataFrame:
    """One row for each file: counts and sums over its closed blocks, and where the check stopped."""
    closed = F.col("state") == "Closed"
    tail = F.col("state").isin("OpenABlock", "OpenBBlock", "IncompleteStartHeader")
    return blocks.groupBy("file").agg(
        F.count_if(closed).alias("num_blocks"),
        F.coalesce(F.sum(F.when(closed, F.col("data_contents"))), F.lit(0)).alias("data_contents"),
        F.coalesce(F.sum(F.when(closed, F.col("data_size_on_disk"))), F.lit(0)).alias("data_size_on_disk"),
        F.coalesce(F.sum(F.when(closed, F.col("errors_corrected"))), F.lit(0)).alias("errors_corrected"),
        F.coalesce(F.max(F.when(tail, F.col("state_at"))), F.max("block_end"), F.lit(11)).alias("file_len_checked"),
        F.coalesce(F.sum(F.when(tail, F.col("data_size_on_disk"))), F.lit(0)).alias("open_tail_bytes"),
        F.max_by("state", "mn_start").alias("last_state"),
    )


def integrity_errors(blocks: DataFrame) -> DataFrame:
    """Blocks whose damage ends a check: file, where, and which component."""
    fatal = F.col("state").isin("InvalidBlockStructure", "ProbablyNotStartHeader", "DataCorruption")
    what = F.when(F.col("state") == "InvalidBlockStructure", "InvalidBlockStructure").otherwise("Corruption")
    part = F.when(F.col("state") == "ProbablyNotStartHeader", "StartHeader").otherwise(F.col("component_tag"))
    return blocks.where(fatal).select("file", what.alias("error"), F.col("state_at").alias("error_at"), part.alias("component"))


def tail_recovery(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """The plan for each file: lengths before and after, steps, corrected bytes, segments; nothing is changed."""
    files = [f for p in paths for f in segments(p)]
    df = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, min(len(files), 4096)))

    o = _Options({**options, "path": paths[0] if paths else ""})  # takes registered hashes and stores along

    def run(batches):
        for b in batches:
            for f in b.column("file").to_pylist():
                r = recover_file(f, o)
                yield pa.RecordBatch.from_pylist(
                    [{"file": f, "original_len": r["original_len"], "recovered_len": r["recovered_len"], "has_blocks": r["has_blocks"], "errors_corrected": r["errors_corrected"],
                      "ops": [{"offset": a, "state": s} for a, s in r["ops"]], "n_segments": len(r["segments"])}],
                    pa.schema([("file", pa.string()), ("original_len", pa.int64()), ("recovered_len", pa.int64()), ("has_blocks", pa.bool_()), ("errors_corrected", pa.int64()),
                               ("ops", pa.list_(pa.struct([("offset", pa.int64()), ("state", pa.string())]))), ("n_segments", pa.int64())]),
                )

    return df.mapInArrow(run, "file string, original_len long, recovered_len long, has_blocks boolean, errors_corrected long, ops array<struct<offset:bigint,state:string>>, n_segments long")


def tail_recovery_at(cuts: DataFrame, path: str, **options: str) -> DataFrame:
    """The plan for one file as if it ended at each of ``cut``; where ``cuts`` has a column ``flips`` (array of places),
    as if these bytes were inverted. The file is read in place and not changed."""
    kinds = pa.schema([("cut", pa.int64()), ("recovered_len", pa.int64()), ("has_blocks", pa.bool_()), ("errors_corrected", pa.int64()), ("n_segments", pa.int64())])

    o = _Options({**options, "path": path})

    def run(batches):
        with _open(path, o) as f:
            layout = _layout(f, o)
            for b in batches:
                out = []
                for n, flips in zip(b.column("cut").to_pylist(), b.column("flips").to_pylist(), strict=True):
                    r = recovered(f, layout, o, n, flips=dict.fromkeys(flips or (), 0xFF))
                    out.append({"cut": n, "recovered_len": r["recovered_len"], "has_blocks": r["has_blocks"], "errors_corrected": r["errors_corrected"], "n_segments": len(r["segments"])})  # tails are not kept
                yield pa.RecordBatch.from_pylist(out, kinds)

    flips = F.col("flips") if "flips" in cuts.columns else F.lit(None)
    # In order, so that a task's reads go through the file once.
    return cuts.select(F.col("cut").cast("long").alias("cut"), flips.cast("array<long>").alias("flips")).sortWithinPartitions("cut").mapInArrow(run, "cut long, recovered_len long, has_blocks boolean, errors_corrected long, n_segments long")
