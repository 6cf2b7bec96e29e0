"""The data source, operators over tables, recovery actions and retries."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions import codecs, rs
from inkwell.functions.retry import FatalError, RetryConfig, RetryingFile, TransientError, categorized, classify, retry_call, retrying, standard
from inkwell.functions.rs import ecc_size
from inkwell.operators import ecc, errors, integrity, layout, scan
from inkwell.operators.sequence import previous, ranged, running_max, running_sum
from inkwell.sources import journal, store
from inkwell.sources.format import ConfigMismatch
from inkwell.sources.journal import apply_recovery, check_file, manifest, segments
from inkwell.sources.parser import Journal
from inkwell.streaming import streams
from tests.golden import LAYOUT, TS, golden

OPS = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("content_ts", T.LongType()),
    T.StructField("calc_ecc", T.BooleanType()), T.StructField("comp_level", T.IntegerType()), T.StructField("payload", T.BinaryType()), T.StructField("len", T.LongType()),
])


def reference_blocks(ops):
    """Tail state machine in plain Python."""
    out, block, comps = [], -1, None
    for op in ops:
        if op == "content":
            if comps is None:
                block, comps = block + 1, 0
            out.append((block, comps, "B"))
            comps += 1
            continue
        comps = None
        if op == "atomic":
            block += 1
            out.append((block, 0, "A"))
    return out


def make_ops(spark, kinds, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i, k in enumerate(kinds):
        data = bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 30, 251, 252, 600]))) if rnd.random() < 0.7 else b"ab" * 400
        rows.append((i, k, 1000 + i, None, rnd.random() < 0.5, rnd.choice([None, 3]), data, len(data)))
    return spark.createDataFrame(rows, OPS), rows


@pytest.mark.parametrize("seed", range(3))
def test_blocks_and_round_trip(spark, tmp_path, seed):
    rnd = random.Random(seed)
    kinds = rnd.choices(["content", "atomic", "close"], [6, 2, 1], k=60)
    ops, rows = make_ops(spark, kinds, seed)
    got = layout.assign_blocks(ops).orderBy("seq").select("block_no", "comp_no", "kind").collect()
    assert [tuple(r) for r in got] == reference_blocks(kinds)
    path = str(tmp_path / "j")
    scan.write_operations(ops, path)
    back = {r.ts: bytes(r.payload) for r in scan.read(spark, path).collect()}
    assert back == {r[2]: r[6] for r in rows if r[1] != "close"}
    assert scan.read(spark, path, "blocks").where("state <> 'Closed' or stored_hash <> computed_hash").count() == 0


def test_range_scan_prunes_and_is_exact(spark, tmp_path):
    ops, rows = make_ops(spark, ["content", "atomic"] * 30)
    path = str(tmp_path / "j")
    scan.write_operations(ops.repartition(4), path)
    times = sorted(r[2] for r in rows)
    df = scan.read(spark, path, payload="false")
    for low, high, lo, ho in [(1010, 1020, False, False), (1010, 1020, True, True), (None, 1005, False, False), (1050, None, True, False), (9, 8, False, False), (None, None, False, False)]:
        want = [t for t in times if (low is None or (t > low if lo else t >= low)) and (high is None or (t < high if ho else t <= high))]
        assert sorted(r.ts for r in scan.in_range(df, low, high, lo, ho).select("ts").collect()) == want
    assert sum(m["blocks"] for m in manifest(path).values()) == scan.read(spark, path, "blocks").count()


def test_fixture_through_the_source(spark, tmp_path):
    f = str(tmp_path / "g.journal")
    with open(f, "wb") as h:
        h.write(golden())
    rows = scan.read(spark, f, hash="sha256").orderBy("start_pos").collect()
    assert [bytes(r.payload) for r in rows] == [b"Some content"] * 3 + [b"Atomic content"] * 2
    assert all(r.ts == TS for r in rows)
    assert scan.read(spark, f, startHint="184").count() == 2
    with open(f, "r+b") as h:
        h.truncate(120)
    assert scan.read(spark, f).count() == 2
    assert scan.read(spark, f, includeOpenTail="false").count() == 0
    (plan,) = integrity.tail_recovery(spark, [f]).collect()
    assert (plan.original_len, plan.recovered_len) == (120, 102 + 41)
    assert apply_recovery(f)["recovered_len"] == os.path.getsize(f) == 143
    assert check_file(f)["num_blocks"] == 1


def test_damage_does_not_hide_later_blocks(spark, tmp_path):
    ops, rows = make_ops(spark, ["atomic"] * 12)
    path = str(tmp_path / "j")
    scan.write_operations(ops.coalesce(1), path)
    (first, *_) = segments(path)
    third = scan.read(spark, first, "blocks").orderBy("mn_start").collect()[2]
    with open(first, "r+b") as h:
        h.seek(third.block_start)
        h.write(b"\xff" * 9)
    states = [r.state for r in scan.read(spark, first, "blocks").orderBy("mn_start").collect()]
    assert states.count("Closed") == scan.read(spark, first, "blocks", resync="true").where("state='Closed'").count() >= 1
    assert states[2] in ("ProbablyNotStartHeader", "DataCorruption")
    assert integrity.integrity_errors(scan.read(spark, first, "blocks")).count() == 1


def test_wrong_config(spark, tmp_path):
    f = str(tmp_path / "x.journal")
    with open(f, "wb") as h:
        h.write(b"nonsense and more")
    with pytest.raises(ConfigMismatch):
        check_file(f)


def test_large_files_are_split_at_block_borders(spark, tmp_path):
    ops, rows = make_ops(spark, ["atomic", "content", "content"] * 40)
    path = str(tmp_path / "j")
    scan.write_frames(scan.frames(layout.assign_blocks(ops)).coalesce(1), path)
    a = scan.read(spark, path).orderBy("ts").select("ts", "payload").collect()
    b = scan.read(spark, path, splitBytes="3000").orderBy("ts").select("ts", "payload").collect()
    assert a == b and len(a) == 120


def test_published_cuts_and_damage(spark, tmp_path):
    ops, _ = make_ops(spark, ["atomic"] * 60)
    path = str(tmp_path / "j")
    scan.enable(spark)
    scan.frames(layout.assign_blocks(ops)).coalesce(1).sortWithinPartitions("block_no").write.format("journal").option("splitBytes", "4000").mode("append").save(path)
    (facts,) = manifest(path).values()
    assert len(facts["cuts"]) > 2 and facts["blocks"] == 60
    blocks = scan.read(spark, path, "blocks").orderBy("mn_start").collect()
    assert [b.block_no for b in blocks] == list(range(60))
    with open(segments(path)[0], "r+b") as h:
        h.seek(blocks[10].block_start)
        h.write(b"\xff" * 9)
    assert scan.read(spark, path, "blocks").where("state = 'Closed'").count() == 59


def test_tails_of_large_files(spark, tmp_path):
    """Blocks before and after the first window of recovery, and one larger than it, cut at many places."""
    ops, _ = make_ops(spark, ["atomic", "content", "content", "close", "content"] * 4)
    big = F.when(F.col("seq").isin(5, 16), F.expr("cast(repeat('x', 2500000) as binary)")).otherwise(F.col("payload"))
    ops = ops.withColumn("payload", big).withColumn("len", F.octet_length("payload").cast("long")).withColumn("comp_level", F.lit(None).cast("int"))
    path = str(tmp_path / "j")
    scan.enable(spark)
    scan.frames(layout.assign_blocks(ops)).coalesce(1).sortWithinPartitions("block_no", "comp_no").write.format("journal").mode("append").save(path)
    source = [f"{path}/{f}" for f in os.listdir(path) if f.endswith(".journal")][0]
    blocks = scan.read(spark, path, "blocks", payload="false").orderBy("mn_start").collect()
    assert blocks[-1].block_end == os.path.getsize(source) > 5_000_000
    cuts = sorted({b.mn_start + 1 + i * (b.block_end - b.mn_start - 1) // 3 for b in blocks for i in range(4)})
    got = {r.cut: r for r in integrity.tail_recovery_at(spark.createDataFrame([(c,) for c in cuts], "cut long"), source).collect()}
    with open(source, "rb") as f:
        data = f.read()
    for c in cuts:
        want = Journal(data[11:c], LAYOUT, 11, "sha256").recover()
        assert (got[c].recovered_len, got[c].has_blocks) == (want["recovered_len"], want["has_blocks"]), c
    assert all(got[b.block_end].recovered_len == b.block_end for b in blocks)


def _one_segment(spark, path, kinds, **options):
    ops, _ = make_ops(spark, kinds)
    scan.enable(spark)
    scan.frames(layout.assign_blocks(ops)).coalesce(1).sortWithinPartitions("block_no", "comp_no").write.format("journal").options(**options).mode("append").save(path)
    return segments(path)[0]


def _planned(path, **options):
    return journal.JournalReader(journal._Options({"path": path, **options})).partitions()


def test_one_file_is_assembled_from_segments_in_pieces(spark, tmp_path):
    """Bytes as one task writes them, with borders of segments; bytes inverted and the end cut off on the way."""
    ops, _ = make_ops(spark, ["atomic", "content", "content"] * 60)
    rows = scan.frames(layout.assign_blocks(ops))
    many, one, copy, bad = (str(tmp_path / x) for x in ("many", "one", "copy", "bad"))
    scan.enable(spark)
    rows.repartitionByRange(5, "block_no").sortWithinPartitions("block_no", "comp_no").write.format("journal").option("splitBytes", "4000").mode("append").save(many)
    assert len(segments(many)) > 1
    rows.coalesce(1).sortWithinPartitions("block_no", "comp_no").write.format("journal").mode("append").save(one)
    (want,) = (open(f, "rb").read() for f in segments(one))
    made = scan.as_one_file(spark, many, copy, piece=1000)
    assert segments(copy) == [made] and open(made, "rb").read() == want
    (was,), (facts,) = manifest(one).values(), manifest(copy).values()
    assert {k: v for k, v in facts.items() if k != "cuts"} == {k: v for k, v in was.items() if k != "cuts"}
    places = [0, 999, 1000, 1001, 4321, len(want) - 60]
    made = scan.as_one_file(spark, many, bad, flips=spark.createDataFrame([(p,) for p in [*places, len(want) - 1]], "at long"), size=len(want) - 7, piece=1000)
    got = open(made, "rb").read()
    assert len(got) == len(want) - 7 and [i for i, (a, b) in enumerate(zip(got, want)) if a != b] == places and all(got[p] == want[p] ^ 0xFF for p in places)


def test_queries_of_one_file_do_not_gather_it_in_a_task(spark):
    """The only file, its damaged copy and the streams' input come from many tasks: none sorts or joins the whole table."""
    import inspect

    from inkwell.plans import queries

    assert "coalesce(1)" not in inspect.getsource(queries)


def test_published_files_are_planned_without_a_walk(spark, tmp_path, monkeypatch):
    """Also if they were cut since or grew, and from a hint on, which takes a walk to the next border only."""
    path = str(tmp_path / "j")
    file = _one_segment(spark, path, ["atomic"] * 200, splitBytes="2000")
    size, blocks = os.path.getsize(file), scan.read(spark, path, "blocks").orderBy("mn_start").collect()
    steps = []
    walk = journal.light_walk
    monkeypatch.setattr(journal, "light_walk", lambda *a: (steps.append(x) or x for x in walk(*a)))
    whole = _planned(path, view="blocks", splitBytes="2000")
    hinted = _planned(path, view="blocks", splitBytes="2000", startHint=str(blocks[50].block_start))
    assert len(steps) < 30 and hinted[0].start == blocks[50].mn_start and hinted[0].first_block == 0
    assert [(r.start, r.first_block) for r in hinted[1:]] == [(r.start, r.first_block - 50) for r in whole if r.start > blocks[50].mn_start]
    steps.clear()
    with open(file, "r+b") as f:
        f.truncate(size - 5)
    cut = _planned(path, view="blocks", splitBytes="2000")
    assert len(steps) < 60 and [(r.start, r.first_block) for r in cut] == [(r.start, r.first_block) for r in whole] and cut[-1].end == size - 5
    offset = journal.JournalStreamReader(journal._Options({"path": path})).latestOffset()
    assert offset[file][1] == 199 and offset[file][0] == blocks[198].block_end
    with open(file, "r+b") as f:
        data = f.read()
        f.truncate(0)
        f.seek(0)
        f.write(data[: blocks[198].block_end] + data[blocks[3].mn_start : blocks[3].block_end] * 40)
    grown = scan.read(spark, path, "blocks", splitBytes="2000").orderBy("mn_start").collect()
    assert [b.block_no for b in grown] == list(range(199 + 40)) and {b.state for b in grown} == {"Closed"}


def test_streams_take_published_files_in_their_ranges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "j")
    file = _one_segment(spark, path, ["atomic"] * 100, splitBytes="2000")
    steps = []
    walk = journal.light_walk
    monkeypatch.setattr(journal, "light_walk", lambda *a: (steps.append(x) or x for x in walk(*a)))
    reader = journal.JournalStreamReader(journal._Options({"path": path}))
    end = reader.latestOffset()
    assert not steps and end == {file: [os.path.getsize(file), 100]}
    parts = reader.partitions({}, end)
    assert len(parts) > 3 and [(r.start, r.end, r.first_block) for r in parts] == [(r.start, r.end, r.first_block) for r in _planned(path)]
    assert reader.partitions(end, end) == []


def test_damage_leaves_ranges_and_batches_small(spark, tmp_path, monkeypatch):
    """A file of another writer, damaged near its start: the walk goes on behind it, and no task holds the rest."""
    path = str(tmp_path / "j")
    file = _one_segment(spark, path, ["atomic", "content", "content"] * 200)
    other = str(tmp_path / "other.journal")
    data = bytearray(open(file, "rb").read())
    at = [b.block_start for b in scan.read(spark, path, "blocks").orderBy("mn_start").collect()]
    for i in (2, 150, 151):
        data[at[i] : at[i] + 8] = b"\xff" * 8
    data[at[80] + 30 : at[80] + 34] = b"\xff" * 4
    open(other, "wb").write(data)
    parts = _planned(other, view="blocks", splitBytes="4000")
    assert len(parts) > 5 and max(p.end - p.start for p in parts) < 8000
    sizes = []
    read = journal.RetryingFile.read
    monkeypatch.setattr(journal.RetryingFile, "read", lambda self, size=-1: sizes.append(size) or read(self, size))
    monkeypatch.setattr(journal, "ROWS", 16)
    rows = []
    for whole in (parts, [journal.Range(other, 11, len(data), 0)]):
        o = journal._Options({"path": other, "view": "blocks", "splitBytes": "4000"})
        batches = [b for p in whole for b in journal.read_range(p, o)]
        assert max(b.num_rows for b in batches) <= 16
        rows.append([r for b in batches for r in b.to_pylist()])
    assert min(sizes) > 0 and max(sizes) < 8000
    want = list(Journal(bytes(data[11:]), LAYOUT, 11).walk(resync=True))
    for got in rows:
        assert [(r["block_no"], r["mn_start"], r["state"], r["state_at"], r["block_end"], r["n_components"]) for r in got] == [(i, b.mn_start, b.state, b.at, b.block_end, len(b.components)) for i, b in enumerate(want)]
    assert sum(b.state != "Closed" for b in want) >= 3


def test_stream_assignment_of_parts_is_that_of_rows():
    from inkwell.streaming.streams import _assigned

    rnd = random.Random(3)
    for most in (1, 2, 3, 50):
        block, comps, state = 0, -1, (0, -1)
        for _ in range(60):
            ops = [rnd.choice((0, 0, 1, -1)) for _ in range(rnd.randint(1, most))]
            number, comp, *state = _assigned(np.array(ops, np.int8), *state)
            for i, op in enumerate(ops):
                if op == 0:
                    comps += 1
                    assert (number[i], comp[i]) == (block, comps)
                    continue
                if comps >= 0:
                    block, comps = block + 1, -1
                if op == 1:
                    assert (number[i], comp[i]) == (block, 0)
                    block += 1
            assert tuple(state) == (block, comps)


def test_running_values(spark):
    df = ranged(spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).repartition(5), "k")
    s = running_sum(df, "v", "s", "k").orderBy("k").collect()
    assert [r.s for r in s] == [sum(i % 7 for i in range(k)) for k in range(100)]
    assert [r.p for r in previous(df, "v", "p", "k").orderBy("k").collect()] == [None] + [i % 7 for i in range(99)]
    assert [r.m for r in running_max(df, "v", "m", "k").orderBy("k").collect()] == [min(k, 6) for k in range(100)]


def test_repair_of_columns(spark):
    rows = [(i, os.urandom(n)) for i, n in enumerate([0, 1, 250, 251, 252, 502, 900])]
    df = spark.createDataFrame(rows, "k long, c binary")
    p = ecc.with_parity(df, "k", "c")
    assert all(len(r.parity) == ecc_size(len(r.c), 4) for r in p.collect())
    bad = p.select("k", "parity", ecc.plant(F.col("c"), F.lit(2)).alias("c"))
    fixed = ecc.correct(bad, "k", "c").orderBy("k", "chunk_no").collect()
    assert {r.k: b"".join(bytes(x.data) for x in fixed if x.k == r.k) for r in fixed} == {k: c for k, c in rows if c}
    t = ecc.two_phase(bad.join(df.select("k", F.sha2("c", 256).alias("h")), "k"), "k", "c", "h").collect()
    assert all(r.repaired_ok for r in t) and sum(r.first_ok for r in t) == 1


def test_previous_keeps_nulls(spark):
    """Nulls at the start, inside and at the borders of ranges."""
    values = [None, 3, None, None, 5, 1, None, 7, 2, None] * 5
    df = ranged(spark.createDataFrame(list(enumerate(values)), "k long, v long").repartition(5), "k")
    assert [r.p for r in previous(df, "v", "p", "k").orderBy("k").collect()] == [None, *values[:-1]]


@pytest.mark.parametrize("kinds", [["close"] * 9, ["content"] * 9, ["atomic"] * 5 + ["close"] * 5 + ["content"] * 5, ["close", "content"] * 8])
def test_block_assignment_over_range_borders(spark, kinds):
    ops, _ = make_ops(spark, kinds)
    got = layout.assign_blocks(ops.repartition(6)).orderBy("seq").select("block_no", "comp_no", "kind").collect()
    assert [tuple(r) for r in got] == reference_blocks(kinds)


def test_commit_cut_off_before_its_manifest_shows_nothing_twice(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "j")
    o = journal._Options({"path": path})
    rows = [T.Row(block_no=i, kind="A", comp_no=0, block_ts=i, end_ts=i, ts=i, ecc=False, level=None, payload=b"x") for i in range(3)]
    write = lambda: [journal.write_segment(iter(rows), path, o)]

    def dies(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(journal.json, "dumps", dies)
        journal.publish(path, write(), "epoch-000000000007")
    assert segments(path) == [] and scan.read(spark, path).count() == 0
    for _ in range(2):  # the retry, and a retry of a commit that was whole
        journal.publish(path, write(), "epoch-000000000007")
        assert sorted(r.ts for r in scan.read(spark, path).select("ts").collect()) == [0, 1, 2]
    with open(f"{path}/other.bin", "wb") as f:
        f.write(golden())
    assert scan.read(spark, path).count() == 8
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(store.Files, "delete", dies)
        journal.publish(path, write(), "batch-1", overwrite=True)
    assert scan.read(spark, path).count() == 3  # the old files are still there, but replaced


def test_segments_without_a_manifest_are_vacuumed(spark, tmp_path):
    path = str(tmp_path / "j")
    ops, _ = make_ops(spark, ["atomic"] * 5)
    scan.write_operations(ops, path)
    with open(f"{path}/segment-lost.journal", "wb") as f:
        f.write(golden())
    assert scan.read(spark, path).count() == 5
    with pytest.raises(ValueError):
        journal.vacuum(path)
    assert journal.vacuum(path, others_running=False) == 1 and scan.read(spark, path).count() == 5
    ops.createOrReplaceTempView("ops")
    scan.frames(layout.assign_blocks(ops.where("seq < 2"))).write.format("journal").mode("overwrite").save(path)
    assert scan.read(spark, path).count() == 2 and len(segments(path)) <= 2


def test_journals_in_other_file_systems(spark, tmp_path):
    """A scheme that only pyarrow opens: written, scanned, streamed, checked and recovered."""
    top = str(tmp_path / "far")
    os.makedirs(top)

    def far(uri):
        from pyarrow.fs import LocalFileSystem, SubTreeFileSystem

        return SubTreeFileSystem(top, LocalFileSystem()), uri.split("://", 1)[1]

    store.register_store("far", far)
    ops, rows = make_ops(spark, ["atomic", "content", "content", "close"] * 5)
    scan.write_operations(ops, "far://table/j")
    want = {r[2]: r[6] for r in rows if r[1] != "close"}
    assert {r.ts: bytes(r.payload) for r in scan.read(spark, "far://table/j").collect()} == want
    assert scan.read(spark, "far://table/j", splitBytes="2000").where("ts >= 1005 and ts < 1009").count() == 3
    assert scan.read(spark, "far://table/j", "config").select("head").distinct().count() == 1
    q = streams.tail(spark, "far://table/j").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(want)
    with open(f"{top}/one", "wb") as h:
        h.write(golden()[:120])
    (plan,) = integrity.tail_recovery(spark, ["far://one"]).collect()
    assert (plan.original_len, plan.recovered_len) == (120, 143)
    assert apply_recovery("far://one")["recovered_len"] == os.path.getsize(f"{top}/one") == 143
    assert check_file("far://one")["num_blocks"] == 1


def test_registered_hash_and_codec_reach_the_workers(spark, tmp_path):
    from tests.blake3 import Blake3

    codecs.register_hash("blake3-test", Blake3)
    codecs.register_codec("turned", lambda level, data: data[: len(data) // 2], lambda data, size: data * 2)
    scan.enable(spark)
    f = str(tmp_path / "g.journal")
    with open(f, "wb") as h:
        h.write(golden())
    b = scan.read(spark, f, "blocks", hash="blake3-test").collect()
    assert len(b) == 3 and all(x.stored_hash == x.computed_hash for x in b)
    ops, _ = make_ops(spark, ["atomic", "content"] * 4)
    ops = ops.withColumn("payload", F.lit(b"ab" * 400)).withColumn("len", F.lit(800).cast("long")).withColumn("comp_level", F.lit(1))
    scan.write_operations(ops, str(tmp_path / "c"), hash="blake3-test", codec="turned")
    got = scan.read(spark, str(tmp_path / "c"), hash="blake3-test", codec="turned").collect()
    assert len(got) == 8 and all(bytes(r.payload) == b"ab" * 400 and r.data_len == 404 for r in got)


def test_retries_of_reads_and_writes(tmp_path):
    f = str(tmp_path / "x")

    class Flaky:
        """Every second read or write fails after it has moved the position."""

        def __init__(self, path, mode):
            self.inner, self.calls = open(path, mode), 0  # noqa: SIM115

        def __getattr__(self, name):
            real = getattr(self.inner, name)

            def call(*a):
                self.calls += name in ("read", "write")
                if name in ("read", "write") and self.calls % 2:
                    real(*(x[: len(x) // 2] if name == "write" else 3 for x in a))
                    raise InterruptedError(4, name)
                return real(*a)

            return call

    config = RetryConfig(initial_ms=0)
    with RetryingFile(f, "w+b", config, Flaky) as h:
        for part in (b"hello ", b"wide ", b"world"):
            h.write(part)
        h.seek(6)
        assert h.read(4) == b"wide" and h.tell() == 10
    with RetryingFile(f, "rb", config) as h:
        assert h.read() == b"hello wide world"
    with pytest.raises(FatalError):
        RetryingFile(str(tmp_path / "none"))


def test_compression_is_kept_only_where_it_saves(spark, tmp_path):
    """The stored form of every page against the codec applied by hand."""
    import zstandard

    pages = [(i, x) for i, x in enumerate([b"", b"ab", b"ab" * 9, b"ab" * 900, os.urandom(300), b"<p>text</p>" * 30 + os.urandom(20)])]
    df = spark.createDataFrame([(i, "A", 0, i, i, i, False, 3, x) for i, x in pages], "block_no long, kind string, comp_no int, block_ts long, end_ts long, ts long, ecc boolean, level int, payload binary")
    scan.write_frames(df, str(tmp_path / "p"))
    got = {r.ts: r for r in scan.read(spark, str(tmp_path / "p")).collect()}
    for i, x in pages:
        size = len(zstandard.ZstdCompressor(level=3).compress(x)) + 4
        want = (True, size, len(x)) if size < len(x) else (False, len(x), None)
        assert (got[i].compressed, got[i].data_len, got[i].orig_len) == want and bytes(got[i].payload) == x


@pytest.mark.parametrize("n", [2, 4, 6, 8, 16, 32])
def test_many_codewords_at_once_decode_as_one_by_one(n):
    rnd = random.Random(n)
    parts, parity, want = [], [], []
    for _ in range(150):
        data = bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 256 - n)))
        word = bytearray(data + rs.encode(data, n))
        for i in rnd.sample(range(len(word)), min(rnd.randrange(n // 2 + 3), len(word))):
            word[i] ^= rnd.randrange(1, 256)
        parts.append(bytes(word[: len(data)]))
        parity.append(bytes(word[len(data) :]))
        try:
            want.append(rs.correct(parts[-1], parity[-1]))
        except rs.TooManyErrors:
            want.append((parts[-1], parity[-1], -1))
    size = np.array([len(p) for p in parts])
    at, data = np.cumsum(size) - size, np.frombuffer(b"".join(parts), np.uint8).copy()
    have = np.frombuffer(b"".join(parity), np.uint8).reshape(-1, n).copy()
    errors, _ = rs.correct_chunks(data, at, size, have)
    assert [(data[a : a + m].tobytes(), p.tobytes(), int(e)) for a, m, p, e in zip(at, size, have, errors, strict=True)] == want


def test_retry():
    assert RetryConfig().delays() == [50, 100, 200, 400]
    assert RetryConfig(max_attempts=10).delays()[-1] == 5000
    with pytest.raises(ValueError):
        RetryConfig(max_attempts=0)
    calls = []

    @retrying(RetryConfig(max_attempts=3, initial_ms=0))
    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise InterruptedError(4, "x")
        return "ok"

    assert flaky() == "ok" and len(calls) == 3
    with pytest.raises(FatalError):
        retry_call(lambda: open("/does/not/exist"))
    with pytest.raises(TransientError):
        retry_call(lambda: (_ for _ in ()).throw(BlockingIOError(11, "x")), RetryConfig(max_attempts=2, initial_ms=0))
    for cause, kind in ((FileNotFoundError(2, "x"), FileNotFoundError), (OSError(30, "x"), PermissionError), (OSError(28, "x"), OSError), (OSError(11, "x"), BlockingIOError), (OSError(35, "x"), BlockingIOError), (OSError(4, "x"), InterruptedError)):
        assert type(standard(categorized(cause))) is kind
    assert classify("Other", 28) == ("fatal", "NoSpace") and classify("Other", 9999) == ("transient", "Other")


def test_error_classes_as_a_join(spark):
    import errno as codes_of

    rows = [(k, c) for k in ("PermissionDenied", "NotFound", "Interrupted", "WouldBlock", "Other", None) for c in (None, 9999, *codes_of.errorcode)]
    got = errors.categorized(spark.createDataFrame(rows, "kind string, os_error int"), "kind", "os_error").collect()
    assert {(r.kind, r.os_error): (r["class"], r.variant) for r in got} == {(k, c): classify(k, c) for k, c in rows} and len(got) == len(rows)


def test_layout_matches_bytes(spark, tmp_path):
    ops, _ = make_ops(spark, ["atomic", "content", "content", "close", "content"] * 6)
    ops = ops.withColumn("comp_level", F.lit(None).cast("int"))
    assigned = layout.assign_blocks(ops)
    want = [(r.mn_start, r.block_end) for r in layout.frame_layout(layout.block_summary(assigned)).orderBy("block_no").collect()]
    path = str(tmp_path / "j")
    scan.enable(spark)
    scan.frames(assigned).coalesce(1).sortWithinPartitions("block_no", "comp_no").write.format("journal").mode("append").save(path)
    got = [(r.mn_start, r.block_end) for r in scan.read(spark, path, "blocks").orderBy("mn_start").collect()]
    assert got == want and LAYOUT.end == 41


def test_entry_queries_have_names_and_sql():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 36


def test_tails_at_many_cuts_open_the_file_once_a_task(spark, tmp_path, monkeypatch):
    """Cuts in any order; each task opens the file once and reads on through it."""
    path = str(tmp_path / "j")
    file = _one_segment(spark, path, ["atomic", "content", "content"] * 40)
    blocks = scan.read(spark, path, "blocks").orderBy("mn_start").collect()
    cuts = [b.block_end - i for b in blocks for i in (0, 7)]
    random.Random(1).shuffle(cuts)
    data = open(file, "rb").read()
    run = integrity.tail_recovery_at(spark.createDataFrame([(c,) for c in cuts], "cut long").coalesce(1), file)
    rows = run.collect()
    assert [r.cut for r in rows] == sorted(cuts)
    for r in rows:
        want = Journal(data[11 : r.cut], LAYOUT, 11, "sha256").recover()
        assert (r.recovered_len, r.has_blocks) == (want["recovered_len"], want["has_blocks"])


def test_writer_turns_few_rows_at_a_time_into_objects():
    import gc

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"block_no": list(range(5000)), "payload": [b"x" * 9] * 5000})
    rows = journal.rows_of(iter([batch]))
    assert next(rows).block_no == 0
    assert sum(type(x).__name__ == "Frame" for x in gc.get_objects()) < 600
    assert [r.block_no for r in rows] == list(range(1, 5000))
