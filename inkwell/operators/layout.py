"""Block assignment, frame layout and header bytes as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.sequence import PART, fixed, in_ranges, local_window, ranged, running_sum
from inkwell.sources.format import Layout


def ecc_len(length: Column, n: int = 4) -> Column:
    """Parity bytes of content of this many bytes."""
    return (F.ceil(length / F.lit(255 - n)) * n).cast("long")


def message_len(total: Column, n: int = 4) -> Column:
    """Content bytes, from content and parity together."""
    return (total - F.ceil(total / F.lit(255)) * n).cast("long")


def assign_blocks(ops: DataFrame, order: str = "seq") -> DataFrame:
    """Operations (op atomic, content or close) to blocks: adds block_no, comp_no and kind.

    An atomic write is a block of its own and closes an open one; content goes on in the open
    block; a close ends it. Close rows belong to no block and are left out.
    """
    w = local_window(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    local = (
        in_ranges(ops.withColumn("_alone", F.col("op") != "content").withColumn("_row", (F.col("op") != "close").cast("int")), order)
        .withColumn("_n", F.row_number().over(w))
        .withColumn("_after", F.lag("_alone").over(w))
        # Whether the first row of a range begins a block depends on the range before: it is left open here.
        .withColumn("_begin", F.when((F.col("_n") > 1) & (F.col("_alone") | F.col("_after")), F.col("_row")).otherwise(F.lit(0)))
        .withColumn("_pos", F.sum("_row").over(so_far) - F.col("_row"))
        .withColumn("_begins", F.sum("_begin").over(so_far))
        .withColumn("_start", F.max(F.when(F.col("_begin") == 1, F.col("_pos"))).over(so_far))
    )
    local = fixed(local.drop("_after", "_begin"))
    # One row for each range carries all four values over its border.
    facts = local.groupBy(PART).agg(
        F.max_by("_alone", "_n").alias("last"), F.min_by(F.struct("_alone", "_row"), "_n").alias("head"),
        F.max("_begins").alias("begins"), F.sum("_row").alias("rows"), F.max("_start").alias("start"),
    )
    by = Window.orderBy(PART)
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    after = F.lag("last").over(by)
    opens = F.when(F.col("head._alone") | F.coalesce(after, F.lit(True)), F.col("head._row")).otherwise(F.lit(0))
    facts = facts.withColumn("_opens", opens).withColumn("_rows", F.coalesce(F.sum("rows").over(past), F.lit(0)))
    begun = F.coalesce(F.col("start") + F.col("_rows"), F.when(F.col("_opens") == 1, F.col("_rows")))
    facts = facts.withColumn("_begun", begun).select(
        PART, "_opens", "_rows", F.coalesce(F.sum(F.col("begins") + F.col("_opens")).over(past), F.lit(0)).alias("_blocks"), F.max("_begun").over(past).alias("_held")
    )
    start = F.coalesce(F.col("_start") + F.col("_rows"), F.when(F.col("_opens") == 1, F.col("_rows")), F.col("_held"))
    return local.join(F.broadcast(facts), PART).where("op <> 'close'").select(
        *ops.columns,
        (F.col("_blocks") + F.col("_opens") + F.col("_begins") - 1).cast("long").alias("block_no"),
        (F.col("_rows") + F.col("_pos") - start).cast("int").alias("comp_no"),
        F.when(F.col("op") == "atomic", "A").otherwise("B").alias("kind"),
    )


def stored_len(n: int = 4) -> Column:
    """Bytes of a component's content with parity."""
    return F.col("len") + F.when(F.col("calc_ecc"), ecc_len(F.col("len"), n)).otherwise(F.lit(0))


def block_summary(assigned: DataFrame, n: int = 4) -> DataFrame:
    """block_no, kind, start_ts, end_ts, n_components, content_bytes, block_bytes (magic number included)."""
    lay = Layout(n)
    fixed = lay.mn + lay.header + lay.end
    per = F.when(F.col("kind") == "B", lay.header).otherwise(0) + stored_len(n)
    return assigned.groupBy("block_no").agg(
        F.max("kind").alias("kind"), F.min_by("ts", "comp_no").alias("start_ts"), F.max_by("ts", "comp_no").alias("end_ts"),
        F.count("*").alias("n_components"), F.sum("len").cast("long").alias("content_bytes"),
        (F.sum(per) + fixed).cast("long").alias("block_bytes"),
    )


def frame_layout(blocks: DataFrame, n: int = 4) -> DataFrame:
    """Adds mn_start, block_start and block_end to block summaries, in order of block_no."""
    lay = Layout(n)
    df = running_sum(ranged(blocks, "block_no"), "block_bytes", "_at", "block_no")
    at = F.col("_at") + 11
    return df.select(*blocks.columns, at.cast("long").alias("mn_start"), (at + lay.mn).cast("long").alias("block_start"), (at + F.col("block_bytes")).cast("long").alias("block_end"))


def tag_columns(tag: Column) -> dict[str, Column]:
    """kind, has_ecc, is_comp and legal from a tag byte."""
    bits = tag.bitwiseAND(F.lit(0x0C))
    legal = tag.isin(0x00, 0x08, 0x04, 0x0C, 0x20, 0x40, 0x48, 0x44, 0x4C, 0x60)
    kind = F.element_at(F.array(*(F.lit(k) for k in ("A", "B", "content", "end"))), F.shiftright(tag, 5).bitwiseAND(3) + 1)
    return {
        "kind": F.when(legal, kind),
        "has_ecc": legal & (bits.bitwiseAND(8) != 0),
        "is_comp": legal & (bits.bitwiseAND(4) != 0),
        "legal": legal,
    }


def header_pack(tag: Column, ts: Column, length: Column) -> Column:
    """The 13 raw bytes of a header: tag, big-endian time, little-endian length."""
    big = F.lpad(F.hex(ts), 16, "0")
    four = F.lpad(F.hex(length), 8, "0")
    little = F.concat(*(F.substring(four, i, 2) for i in (7, 5, 3, 1)))
    return F.unhex(F.concat(F.lpad(F.hex(tag), 2, "0"), big, little))


__all__ = ["PART", "assign_blocks", "block_summary", "ecc_len", "frame_layout", "header_pack", "message_len", "stored_len", "tag_columns"]
