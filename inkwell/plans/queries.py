"""Registered queries over journals made from the given tables, and their SQL.

``events`` become one journal: time in microseconds, payload ``props``; errors are atomic
writes, all else goes to best-effort blocks. ``documents`` and ``pages`` become atomic blocks
with parity or compression, ``conversations`` one best-effort block for each conversation.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.retry import FATAL_CODES, RetryConfig, TRANSIENT_CODES
from inkwell.operators import ecc, errors, integrity, layout, scan

from inkwell.operators.sequence import fixed
from inkwell.session import shared_dir
from inkwell.sources.format import ECC_LENGTHS, Layout
from inkwell.sources.journal import local
from inkwell.streaming import streams

LOW, HIGH = "2024-01-10 00:00:00", "2024-02-10 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.lit(None).cast("long").alias("content_ts"),
        F.when(F.col("event_type") == "error", "atomic").otherwise("content").alias("op"), F.lit(False).alias("calc_ecc"),
        F.lit(None).cast("int").alias("comp_level"), F.col("props").cast("binary").alias("payload"), F.octet_length("props").cast("long").alias("len"),
    )


def assigned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.assign_blocks(event_ops(spark, sf_dir))


def atomic_rows(df: DataFrame, key: str, payload: str, has_ecc: bool, level: int | None) -> DataFrame:
    ts = F.col(key).cast("long")
    return df.select(
        ts.alias("block_no"), F.lit("A").alias("kind"), F.lit(0).alias("comp_no"), ts.alias("block_ts"), ts.alias("end_ts"), ts.alias("ts"),
        F.lit(has_ecc).alias("ecc"), F.lit(level).cast("int").alias("level"), F.col(payload).cast("binary").alias("payload"),
    )


def _conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    t = F.col("turn").cast("long")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("block_no"), F.lit("B").alias("kind"), t.cast("int").alias("comp_no"), F.min(t).over(w).alias("block_ts"),
        F.max(t).over(w).alias("end_ts"), t.alias("ts"), F.lit(True).alias("ecc"), F.lit(None).cast("int").alias("level"), F.col("text").cast("binary").alias("payload"),
    )


MAKERS = {
    "events": lambda s, d: scan.frames(assigned_events(s, d)),
    "documents": lambda s, d: atomic_rows(table(s, d, "documents"), "doc_id", "text", True, None),
    "pages": lambda s, d: atomic_rows(table(s, d, "pages"), "page_id", "html", False, 3),
    "conversations": _conversation_rows,
}


def journal(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Path of the journal made from a table, written once for each session folder and input."""
    tag = hashlib.sha256(f"{spark.sparkContext.applicationId}|{sf_dir}".encode()).hexdigest()[:16]
    path = f"{local(shared_dir(spark))}/journals/{tag}/{name}"
    if not os.path.isdir(f"{path}/_manifest"):
        scan.write_frames(MAKERS[name](spark, sf_dir), path)
    return path


# Scans


def _micros(text: str) -> int:
    import datetime as dt

    return int(dt.datetime.fromisoformat(text + "+00:00").timestamp()) * 1_000_000


def content_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan.read(spark, journal(spark, sf_dir, "events"))
    return scan.in_range(df, _micros(LOW), _micros(HIGH)).select("ts", "block_kind", F.decode("payload", "UTF-8").alias("props"))


def range_bound_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within all nine kinds of bounds, the bounds being two events' own times."""
    df = scan.read(spark, journal(spark, sf_dir, "events"), payload="false").select("ts")
    a, b = table(spark, sf_dir, "events").where("event_id in (100, 700)").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.min("t"), F.max("t")).first()
    sides = (("included", False), ("excluded", True), ("unbounded", None))
    tests = []
    for ln, lo in sides:
        for hn, ho in sides:
            low = F.lit(True) if lo is None else (F.col("ts") > a if lo else F.col("ts") >= a)
            high = F.lit(True) if ho is None else (F.col("ts") < b if ho else F.col("ts") <= b)
            tests.append((ln, hn, F.count_if(low & high)))
    one = df.agg(*(c.alias(f"c{i}") for i, (_, _, c) in enumerate(tests)))
    rows = F.array(*(F.struct(F.lit(ln).alias("lower"), F.lit(hn).alias("upper"), F.col(f"c{i}").alias("n")) for i, (ln, hn, _) in enumerate(tests)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def _single_file(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The events' journal as one file."""
    source = journal(spark, sf_dir, "events")
    path = f"{local(source)}-{name}"
    if not os.path.isdir(f"{path}/_manifest"):
        scan.as_one_file(spark, source, path)
    return path


def scan_from_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components from the block of number 50 on, found in the block index."""
    path = _single_file(spark, sf_dir, "one")
    hint = scan.read(spark, path, "blocks").where("block_no = 50").select("block_start").first()
    df = scan.read(spark, path, payload="false", startHint=str(hint[0]))
    return df.agg(F.count("*").alias("n"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.sum("data_len").cast("long").alias("bytes"))


def open_tail_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal cut inside its last best-effort block of three components or more: whole components stay."""
    path = _single_file(spark, sf_dir, "one")
    blocks = scan.read(spark, path, "blocks")
    last = blocks.where("kind = 'B' and n_components >= 3").agg(F.max_by("block_no", "mn_start")).first()[0]
    cut = scan.read(spark, path, payload="false").where(f"block_no = {last} and comp_no = 2").select("data_start").first()[0]
    target = f"{path}-cut-{uuid.uuid4().hex}"
    scan.as_one_file(spark, path, target, size=cut)
    return scan.read(spark, target, payload="false").groupBy("state").agg(F.count("*").alias("n"), F.max("ts").alias("max_ts"))


def content_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of every page after decompression."""
    df = scan.read(spark, journal(spark, sf_dir, "pages"))
    return df.select(F.col("ts").alias("page_id"), F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("sha"))


def file_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First bytes of every segment, checked."""
    df = scan.read(spark, journal(spark, sf_dir, "documents"), "config").select(F.col("head").alias("h"))
    good = F.col("h") == F.unhex(F.lit(Layout(4).file_header().hex()))
    return df.agg(F.every(good).alias("matches"), F.max(F.conv(F.hex(F.substring("h", 11, 1)), 16, 10).cast("int")).alias("ecc_len"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan.read(spark, journal(spark, sf_dir, "conversations"))
    return df.select(F.col("comp_no").cast("long").alias("comp_no"), "ts", "ecc", F.col("data_len"), F.sha2("payload", 256).alias("sha"))


def journal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan.read(spark, journal(spark, sf_dir, "events"))
    return df.select("ts", F.decode("payload", "UTF-8").alias("props"))


def journal_roundtrip_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan.read(spark, journal(spark, sf_dir, "documents"))
    return df.select(F.col("ts").alias("doc_id"), F.sha2("payload", 256).alias("sha"), "ecc", "block_kind")


def magic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of magic numbers in texts in which some are planted, by position of the first (-1: none)."""
    lay = Layout(4)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit(lay.magic.hex())), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8")).alias("content"))

    def run(batches):
        import pyarrow as pa

        from inkwell.sources.parser import Journal

        for b in batches:
            found = [Journal(x, lay).magics(0, len(x)) for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array([int(x[0]) if len(x) else -1 for x in found], pa.int64())], ["doc_id", "n_found", "first_at"])

    return docs.mapInArrow(run, "doc_id long, n_found long, first_at long")


# Layout and reports


def block_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned_events(spark, sf_dir).select(F.col("seq").alias("event_id"), "block_no", F.col("comp_no").cast("long").alias("comp_no"), "kind")


def block_assign_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block assignment with explicit closes: errors are atomic, signups close, all else is content."""
    kind = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "close").alias("c"))
    ops = event_ops(spark, sf_dir).join(kind, "seq").withColumn("op", F.coalesce("c", "op")).drop("c")
    return layout.assign_blocks(ops).select(F.col("seq").alias("event_id"), "block_no", F.col("comp_no").cast("long").alias("comp_no"), "kind")


def _event_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.frame_layout(layout.block_summary(assigned_events(spark, sf_dir)))


def frame_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_layout(spark, sf_dir).select("block_no", "kind", "mn_start", "block_start", "block_end", "n_components")


def block_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block index of a written file: must agree with the computed layout."""
    return scan.read(spark, _single_file(spark, sf_dir, "one"), "blocks").select("block_no", "block_start", "start_ts")


def block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.block_summary(assigned_events(spark, sf_dir)).select("block_no", "kind", "start_ts", "end_ts", "n_components", "content_bytes")


def block_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of atomic blocks as they are stored in the events' journal, and as computed from its bytes."""
    b = scan.read(spark, journal(spark, sf_dir, "events"), "blocks").where("kind = 'A'")
    return b.select("start_ts", F.lower(F.hex("stored_hash")).alias("stored"), F.lower(F.hex("computed_hash")).alias("computed"))


def block_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = scan.read(spark, journal(spark, sf_dir, "events"), "blocks")
    return b.groupBy("kind", "state").agg(F.count("*").alias("n"), F.sum("n_components").cast("long").alias("n_components"), F.every(F.col("stored_hash") == F.col("computed_hash")).alias("hashes_agree"))


def integrity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = integrity.integrity_summary(scan.read(spark, _single_file(spark, sf_dir, "one"), "blocks"))
    return s.select("num_blocks", F.col("data_contents").cast("long"), F.col("data_size_on_disk").cast("long"), F.col("errors_corrected").cast("long"), "file_len_checked")


def integrity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clean journal has none; one with a start header overwritten has one Corruption and stops nothing else."""
    path = _single_file(spark, sf_dir, "one")
    at = scan.read(spark, path, "blocks").where("block_no = 20").select("block_start").first()[0]
    target = f"{path}-bad-{uuid.uuid4().hex}"
    with open(scan.as_one_file(spark, path, target), "r+b") as f:
        f.seek(at)
        f.write(b"\xff" * 8)
    return integrity.integrity_errors(scan.read(spark, target, "blocks")).select("error", "error_at", "component")


def tail_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered lengths of the whole journal cut once inside every block, and at every byte of the last one."""
    path = _single_file(spark, sf_dir, "one")
    source = [f for f in os.listdir(path) if f.endswith(".journal")][0]
    size = F.col("block_end") - F.col("mn_start")
    blocks = scan.read(spark, path, "blocks").select("block_no", "mn_start", "block_end")
    last = blocks.orderBy(F.desc("mn_start")).limit(1)
    inside = blocks.select((F.col("mn_start") + 1 + F.col("block_no") * STRIDE % size).alias("cut"))
    tail = last.select(F.explode(F.sequence(F.col("mn_start") + 1, F.col("block_end"))).alias("cut"))
    cuts = inside.union(tail).distinct().repartition(spark.sparkContext.defaultParallelism * 4)
    return integrity.tail_recovery_at(cuts, f"{path}/{source}").select("cut", "recovered_len", "has_blocks")


def _first_parts(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a file with the place and length of their first component's content."""
    first = scan.read(spark, path, payload="false").where("comp_no = 0").select("block_no", "data_start", "data_len")
    return scan.read(spark, path, "blocks").select("block_no", "kind", "mn_start", "block_start", "block_end").join(first, "block_no")


def recovery_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal cut at the end of every block, the last block damaged: in turn its start header beyond
    repair, a byte of its content, two bytes of its hash."""
    path = _single_file(spark, sf_dir, "one")
    source = [f for f in os.listdir(path) if f.endswith(".journal")][0]
    b, turn = _first_parts(spark, path), F.col("block_no") % 3
    at = lambda c, *n: F.array(*(F.col(c) + i for i in n))
    content = F.when(F.col("data_len") > 0, at("data_start", 0)).otherwise(F.array().cast("array<long>"))
    flips = F.when(turn == 0, at("block_start", 0, 1, 2)).when(turn == 1, content).otherwise(at("block_end", -24, -20))
    cuts = b.select(F.col("block_end").alias("cut"), flips.alias("flips")).repartition(spark.sparkContext.defaultParallelism * 4)
    return integrity.tail_recovery_at(cuts, f"{path}/{source}")


def _damaged_events(spark: SparkSession, sf_dir: str) -> str:
    """The events' journal as one file, damaged block by block in turn: not at all, one byte of the start
    header, one byte of content, two bytes of the magic number, one byte of the hash."""
    path = _single_file(spark, sf_dir, "one")
    target = f"{path}-worn"
    if not os.path.isdir(f"{target}/_manifest"):
        b, turn = _first_parts(spark, path), F.col("block_no") % 5
        at = lambda c, *n: F.array(*(F.col(c) + i for i in n))
        places = F.when(turn == 1, at("block_start", 3)).when((turn == 2) & (F.col("data_len") > 0), at("data_start", 0)).when(turn == 3, at("mn_start", 1, 9)).when(turn == 4, at("block_end", -22))
        scan.as_one_file(spark, path, target, flips=b.select(F.explode(places).alias("at")))
    return target


def integrity_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of a damaged journal: state, bytes corrected, segments reported."""
    path = _damaged_events(spark, sf_dir)
    s = scan.read(spark, path, "segments").groupBy("block_no").agg(F.count("*").alias("n_segments"))
    b = scan.read(spark, path, "blocks").select("block_no", "kind", "state", "errors_corrected")
    return b.join(s, "block_no", "left").select("block_no", "kind", "state", "errors_corrected", F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"))


def damaged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content whose hash disagrees and that has no parity: atomic blocks alone, best-effort blocks as a whole."""
    return scan.read(spark, _damaged_events(spark, sf_dir), "segments").select("block_no", "kind", "data_start", "data_len")


def integrity_summary_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = integrity.integrity_summary(scan.read(spark, _damaged_events(spark, sf_dir), "blocks"))
    return s.select("num_blocks", F.col("data_contents").cast("long"), F.col("errors_corrected").cast("long"), "file_len_checked")


#: Places of the cuts inside blocks move on by this from block to block.
STRIDE = 37


# Error correction


def ecc_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text").cast("long")
    d = table(spark, sf_dir, "documents").select("doc_id", n.alias("n_bytes"), layout.ecc_len(n).alias("n_ecc"))
    return d.select("*", layout.message_len(F.col("n_bytes") + F.col("n_ecc")).alias("n_message"))


def ecc_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ecc.parity(table(spark, sf_dir, "documents"), "doc_id", "text")
    return p.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.lower(F.hex("parity")).alias("parity"))


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with parity, of which the first doc_id % 4 bytes of each chunk are inverted; three are beyond repair."""
    p = ecc.with_parity(table(spark, sf_dir, "documents"), "doc_id", "text")
    return p.select("doc_id", "parity", F.sha2("text", 256).alias("sha"), ecc.plant(F.col("text"), (F.col("doc_id") % 4).cast("int")).alias("text"))


def ecc_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ecc.correct(_planted(spark, sf_dir), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count_if("dirty").alias("n_dirty"))


def ecc_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents after repair: bytes corrected (0 where content did not come back, which three bad bytes in a chunk rule out) and content."""
    r = ecc.repaired(_planted(spark, sf_dir), "doc_id", "text", carry=("sha",)).where(F.octet_length("text") > 0)
    back = F.sha2("text", 256) == F.col("sha")
    return r.select("doc_id", back.alias("restored"), F.when(back, F.col("errors")).otherwise(0).cast("long").alias("errors"), F.when(back, F.col("sha")).alias("sha"))


def two_phase_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ecc.two_phase(_planted(spark, sf_dir), "doc_id", "text", "sha")
    return t.select("doc_id", "first_ok", "repaired_ok")


def _damaged_documents(spark: SparkSession, sf_dir: str) -> str:
    """Documents' blocks written with parity, then three bytes of the first chunk of every tenth one zeroed in place."""
    path = f"{journal(spark, sf_dir, 'documents')}-damaged"
    if not os.path.isdir(f"{path}/_done"):
        scan.write_frames(MAKERS["documents"](spark, sf_dir), path)
        for r in scan.read(spark, path, payload="false").where("ts % 10 = 0 and data_len >= 64").select("file", "data_start").toLocalIterator():
            with open(local(r.file), "r+b") as f:
                f.seek(r.data_start)
                old = f.read(3)
                f.seek(r.data_start)
                f.write(bytes(x ^ 0xFF for x in old))
        os.makedirs(f"{path}/_done")
    return path


def corrupt_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _damaged_documents(spark, sf_dir)
    s = scan.read(spark, path, "segments")
    b = scan.read(spark, path, "blocks").select("file", "block_no", "start_ts")
    return s.join(b, ["file", "block_no"]).select(F.col("start_ts").alias("doc_id"), "kind", "data_len", (F.col("chunk_start") - F.col("data_start")).alias("chunk_at"))


def corruption_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrupt_segments(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.sum("data_len").cast("long").alias("bytes"))


def ecc_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, Layout(n).magic[8:].hex()) for n in ECC_LENGTHS], "ecc_len int, parity string")


def tag_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.range(256).select(F.col("id").cast("int").alias("tag"))
    return t.select("tag", *(c.alias(n) for n, c in layout.tag_columns(F.col("tag")).items()))


def header_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = event_ops(spark, sf_dir)
    return a.select(F.col("seq").alias("event_id"), F.lower(F.hex(layout.header_pack(F.lit(64), F.col("ts"), F.col("len")))).alias("raw"))


def compress_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan.read(spark, journal(spark, sf_dir, "pages"), payload="false")
    return df.select(F.col("ts").alias("page_id"), "compressed", "data_len", "orig_len")


# Retry, order, streams


def io_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed operations, one for each known error and for unknown ones, joined to the classes of errors."""
    import errno

    names = [*FATAL_CODES, *(c for c in TRANSIENT_CODES if c != "EWOULDBLOCK"), "EPIPE"]
    failed = [("Other", getattr(errno, n), n) for n in names] + [(k, None, k) for k in ("PermissionDenied", "NotFound", "Interrupted", "WouldBlock")]
    return errors.categorized(spark.createDataFrame(failed, "kind string, os_error int, name string"), "kind", "os_error").select("name", "class", "variant")


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = RetryConfig(max_attempts=10)
    n = F.sequence(F.lit(1), F.lit(c.max_attempts - 1))
    return spark.range(1).select(F.explode(n).alias("attempt")).select("attempt", F.least(F.lit(c.initial_ms) * F.pow(F.lit(c.factor), F.col("attempt") - 1), F.lit(c.cap_ms)).cast("long").alias("delay_ms"))


def ts_monotonic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' dates against the order of their keys: violations of a rising time."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    return streams.ts_violations(o, "ts", "o_orderkey").select("o_orderkey", "ts", "prev_ts")


def ts_monotonic_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where open orders have no date: a row after one without a date violates nothing."""
    date = F.when(F.col("o_orderstatus") != "O", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", date.alias("ts"))
    return streams.ts_violations(o, "ts", "o_orderkey").select("o_orderkey", "ts", "prev_ts")


def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal that grows between two runs of one stream: all components, each once."""
    base = f"{local(shared_dir(spark))}/streams/{uuid.uuid4().hex}"
    rows = fixed(MAKERS["events"](spark, sf_dir))
    half = rows.agg(F.max("block_no")).first()[0] // 2
    for part in (rows.where(F.col("block_no") <= half), rows.where(F.col("block_no") > half)):
        scan.write_frames(part, f"{base}/in")
        q = streams.tail(spark, f"{base}/in").select("ts", F.decode("payload", "UTF-8").alias("props")).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations appended by a stream, read back."""
    base = f"{local(shared_dir(spark))}/streams/{uuid.uuid4().hex}"
    MAKERS["conversations"](spark, sf_dir).write.parquet(f"{base}/in")
    src = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    streams.append(src, f"{base}/out", f"{base}/check").awaitTermination()
    return scan.read(spark, f"{base}/out").select("ts", F.sha2("payload", 256).alias("sha"), "ecc")


def stream_block_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block assignment of four journals across micro-batches."""
    base = f"{local(shared_dir(spark))}/streams/{uuid.uuid4().hex}"
    op = F.when(F.col("event_type") == "error", "atomic").otherwise("content")
    ops = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("journal"), F.col("event_id").alias("seq"), op.alias("op"))
    third = ops.agg(F.max("seq")).first()[0] // 3
    schema = ops.schema
    for i in range(3):
        last = F.lit(True) if i == 2 else F.col("seq") < third * (i + 1)
        ops.where((F.col("seq") >= third * i) & last).write.mode("append").parquet(f"{base}/in")
        src = spark.readStream.schema(schema).parquet(f"{base}/in")
        q = streams.assign_blocks_stream(src).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("journal", "seq", "kind", "block_no", F.col("comp_no").cast("long").alias("comp_no"))


QUERIES = (
    content_range_scan, range_bound_matrix, scan_from_hint, open_tail_scan, content_bytes, file_config, components, journal_roundtrip,
    journal_roundtrip_atomic, magic_scan, block_assign, block_assign_close, frame_layout, block_times, block_summary, block_hash, block_states, integrity_summary,
    integrity_errors, integrity_damaged, integrity_summary_damaged, damaged_segments, recovery_damaged, tail_recovery, ecc_len, ecc_parity, ecc_verify, ecc_correct, two_phase_repair, corrupt_segments, corruption_class,
    ecc_constants, tag_decode, header_pack, compress_decision, io_error_class, backoff_schedule, ts_monotonic_check, ts_monotonic_nulls, stream_tail, stream_append,
    stream_block_assign,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}



