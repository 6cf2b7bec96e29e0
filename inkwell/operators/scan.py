"""Writing and scanning journals: the time-range query and its bounds."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.layout import assign_blocks
from inkwell.session import enable
from inkwell.sources.format import FILE_HEADER
from inkwell.sources.journal import BORDER, INPUT, OWN, Written, manifest, publish, segments
from inkwell.sources.store import local


def frames(assigned: DataFrame, level: int | None = None) -> DataFrame:
    """Assigned operations as the writer's rows: a block opens at its first time and ends at its last."""
    from pyspark.sql import Window

    w = Window.partitionBy("block_no")
    return assigned.select(
        "block_no", "kind", "comp_no", F.min("ts").over(w).alias("block_ts"), F.max("ts").over(w).alias("end_ts"),
        F.coalesce("content_ts", "ts").alias("ts"), F.col("calc_ecc").alias("ecc"),
        F.coalesce("comp_level", F.lit(level).cast("int")).cast("int").alias("level"), F.col("payload").cast("binary").alias("payload"),
    )


def write_frames(rows: DataFrame, path: str, **options: str) -> None:
    """Whole blocks, ranged by number, as one segment for each task."""
    enable(rows.sparkSession)
    names = [x.split()[0] for x in INPUT.split(", ")]
    ordered = rows.select(*names).repartitionByRange("block_no").sortWithinPartitions("block_no", "comp_no")
    ordered.write.format("journal").options(**options).mode("append").save(path)


def write_operations(ops: DataFrame, path: str, level: int | None = None, **options: str) -> None:
    """Operations (seq, op, ts, content_ts, calc_ecc, comp_level, payload, len) to a journal table."""
    write_frames(frames(assign_blocks(ops), level), path, **options)


def read(spark: SparkSession, path: str, view: str = "components", **options: str) -> DataFrame:
    return enable(spark).read.format("journal").options(view=view, **options).load(path)


#: Bytes of a piece of a file that one task writes at once, a multiple of any page.
PIECE = 4 << 20


def as_one_file(spark: SparkSession, path: str, target: str, flips: DataFrame | None = None, size: int | None = None, piece: int = PIECE) -> str:
    """The segments of a table as the only segment of a new table ``target``; the file's path. Local or mounted folders only.

    The bytes of a block do not depend on where it lies, so the file is the first file's header and
    the blocks of all. Tasks copy pieces of it to their places. The manifest has the borders of the
    table's. ``flips`` (places ``at``): bytes that are inverted in the copy; ``size``: where it is
    cut. Its manifest is that of the whole file all the same, as if the damage came afterwards.
    """
    path, target = local(path), local(target)
    known = manifest(path)
    files = [f for f in segments(path) if known[os.path.basename(f)]["bytes"] > FILE_HEADER]
    if not files:
        publish(target, [], "batch-one")
        return ""
    facts = {"bytes": FILE_HEADER, "blocks": 0, "low": None, "high": None, "cuts": []}
    parts = [(0, files[0], 0)]  # (place in the new file, source, place there)
    last = FILE_HEADER
    for f in files:
        one, at = known[os.path.basename(f)], facts["bytes"]
        parts.append((at, f, FILE_HEADER))
        for a, n in [(FILE_HEADER, 0), *one["cuts"]]:
            here = at + a - FILE_HEADER
            if here - last >= BORDER // 2:
                facts["cuts"].append((here, facts["blocks"] + n))
                last = here
        facts["bytes"], facts["blocks"] = at + one["bytes"] - FILE_HEADER, facts["blocks"] + one["blocks"]
        for k, pick in (("low", min), ("high", max)):
            have = [x for x in (facts[k], one[k]) if x is not None]
            facts[k] = pick(have) if have else None
    whole = facts["bytes"] if size is None else size
    name = f"{OWN}{0:020d}-{uuid.uuid4().hex}.journal"
    out = f"{target}/{name}"
    os.makedirs(target, exist_ok=True)
    with open(out, "wb") as f:
        f.truncate(whole)
    tasks = max(1, min(-(-whole // piece), 4 * spark.sparkContext.defaultParallelism))
    todo = spark.range(0, -(-whole // piece), 1, tasks).select(F.col("id").alias("piece"), F.lit(None).cast("long").alias("at"))
    if flips is not None:
        at = F.col("at").cast("long")
        todo = todo.union(flips.select((at / piece).cast("long").alias("piece"), at.alias("at"))).repartition(tasks, "piece").sortWithinPartitions("piece")

    def run(batches):
        import bisect

        import numpy as np
        import pyarrow as pa

        starts = [p for p, _, _ in parts]

        def read(low: int, high: int) -> np.ndarray:
            data = bytearray()
            while low < high:
                i = bisect.bisect_right(starts, low) - 1
                stop = min(high, starts[i + 1] if i + 1 < len(starts) else high)
                with open(parts[i][1], "rb") as f:
                    f.seek(parts[i][2] + low - starts[i])
                    got = f.read(stop - low)
                if len(got) != stop - low:
                    raise OSError(f"{parts[i][1]} is shorter than its manifest says")
                data += got
                low = stop
            return np.frombuffer(data, np.uint8)

        def write(new, low: int, data: np.ndarray) -> int:
            new.seek(low)
            new.write(data.tobytes())
            return len(data)

        n, now, data = 0, None, None
        with open(out, "r+b") as new:
            for b in batches:
                k, at = b.column("piece").to_numpy(zero_copy_only=False), b.column("at")
                flip, where = at.is_valid().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy(zero_copy_only=False)
                for p in np.unique(k).tolist():
                    if p != now:
                        n += 0 if now is None else write(new, now * piece, data)
                        now, data = p, read(p * piece, min(whole, (p + 1) * piece))
                    mine = where[flip & (k == p)] - p * piece
                    data[mine[mine < len(data)]] ^= 0xFF
            n += 0 if now is None else write(new, now * piece, data)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    written = todo.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    if written != whole:
        raise OSError(f"{written} bytes of {whole} written to {out}")
    publish(target, [Written(name, facts)], "batch-one")
    return out


def in_range(df: DataFrame, low: int | None = None, high: int | None = None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """Rows with a time within the bounds, each included, excluded or absent. Empty ranges give no rows."""
    c = F.col("ts")
    if low is not None:
        df = df.where(c > low if low_open else c >= low)
    if high is not None:
        df = df.where(c < high if high_open else c <= high)
    return df
