"""The ``journal`` data source: batch and streaming reader and writer over directories of segments.

A table is a directory of segment files, each a whole journal, in order of name; single files
and files of other writers are read as well. Directories lie wherever ``store`` reaches. The writer
puts whole blocks into a segment for each task, under a name of its own, and publishes them on
commit by one manifest, written last, with a line for each
segment (bytes, blocks, range of times), by which later scans skip segments. Manifests alone say
which segments are seen: what a task or commit that was cut off left behind is not, nor is what a
later overwrite names as replaced; ``vacuum`` deletes it. Files of other writers have no manifest line; they are read
whole, or cut at block borders found by a walk over headers if they are large.

Python data sources have no column pruning, hence the option ``payload=false``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from inkwell.functions import codecs
from inkwell.functions.retry import FileSystemError, RetryConfig, RetryingFile
from inkwell.sources.format import ECC_FLAG, FILE_HEADER, HASH, HEADER, TAGS, Layout, read_config, signed
from inkwell.sources.parser import Beyond, Block, Journal
from inkwell.sources.store import at, local

SCHEMAS = {
    "components": "file string, block_no long, block_kind string, block_start long, comp_no int, ts long, ts_raw binary, start_pos long, data_start long, data_len long, ecc boolean, compressed boolean, orig_len long, payload binary, state string",
    "blocks": "file string, block_no long, kind string, mn_start long, block_start long, start_ts long, end_ts long, block_end long, n_components int, errors_corrected long, stored_hash binary, computed_hash binary, state string, state_at long, component_tag string, data_contents long, data_size_on_disk long",
    "segments": "file string, block_no long, kind string, data_start long, data_len long, chunk_start long, chunk_ecc_start long, ecc_start long",
    "chunks": "file string, block_no long, comp_no int, chunk_no int, data binary, parity binary",
    "config": "file string, head binary",
}
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
INPUT = "block_no long, kind string, comp_no int, block_ts long, end_ts long, ts long, ecc boolean, level int, payload binary"


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, ARROW[t]) for n, t in (x.split() for x in ddl.split(", "))])


OWN = "segment-"


def _manifests(path: str) -> dict[str, dict]:
    """Manifests in force by name: those that no other one names as replaced."""
    store, top = at(f"{path}/_manifest")
    out = {}
    for name in store.names(top):
        if name.endswith(".json"):
            try:
                with RetryingFile(f"{top}/{name}", opener=store.open) as f:
                    out[name] = json.loads(f.read())
            except FileSystemError as e:
                if e.variant != "FileNotFound":  # else replaced and deleted in the meantime
                    raise
    gone = {x for m in out.values() for x in m["replaced"]}
    return {name: m for name, m in out.items() if name not in gone}


def manifest(path: str) -> dict[str, dict]:
    """Published facts of segments by file name."""
    return {k: v for m in _manifests(path).values() for k, v in m["segments"].items()}


def segments(path: str) -> list[str]:
    """Visible segment files in order: published ones and those of other writers. A single file is its own only segment."""
    store, inside = at(path)
    if store.is_file(inside):
        return [path if store.remote else inside]
    held = _manifests(path)
    known = {k for m in held.values() for k in m["segments"]}
    gone = {x for m in held.values() for x in m["replaced"]}
    other = (f for f in store.names(inside) if not f.startswith(("_", ".", OWN)) and f not in gone)
    top = (path if store.remote else inside).rstrip("/")
    return [f"{top}/{f}" for f in sorted({*known, *other})]


def vacuum(path: str, others_running: bool = True) -> int:
    """Deletes segments that no manifest names; how many. Only while no write is running."""
    if others_running:
        raise ValueError("segments of running writes have no manifest yet: say that there are none")
    store, inside = at(path)
    known = manifest(path)
    lost = [f for f in store.names(inside) if f.startswith(OWN) and f not in known]
    for f in lost:
        store.delete(f"{inside}/{f}")
    return len(lost)


def size_of(path: str) -> int:
    store, inside = at(path)
    return store.size(inside)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    first_block: int

    def __post_init__(self):
        super().__init__(None)


#: Bytes of a file that a walk over headers reads at once.
AHEAD = 1 << 12


def light_walk(handle, layout: Layout, pos: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(magic number's place, block end, smallest and largest time) of closed blocks, from headers alone.

    Stops before the first block that does not close cleanly.
    """
    size, magic = layout.mn + layout.header, layout.magic
    base, held = pos, b""

    def fetch(at: int, n: int) -> bytes:
        nonlocal base, held
        if at < base or at + n > base + len(held):
            handle.seek(at)
            base, held = at, handle.read(AHEAD)
        return held[at - base : at - base + n]

    def head(at: int) -> tuple[bytes, int]:
        return Journal(fetch(at, layout.header), layout, at).word(at, HEADER, True, "Header")

    while pos + size <= end:
        mn = fetch(pos, layout.mn)
        if mn != magic and Journal(mn, layout, pos).magic_at(pos) is None:
            return
        try:
            at = pos + layout.mn
            h, _ = head(at)
            kind, low, high = TAGS.get(h[0]), signed(h[1:9]), signed(h[1:9])
            at += layout.header
            if kind == "B":
                low = high = None
                while True:
                    h, _ = head(at)
                    k = TAGS.get(h[0])
                    if k != "content":
                        break
                    n = int.from_bytes(h[9:13], "little")
                    at += layout.header + (layout.ecc(n) if h[0] & ECC_FLAG else 0) + n
                    t = signed(h[1:9])
                    low, high = (t, t) if low is None else (min(low, t), max(high, t))
            elif kind == "A":
                n = int.from_bytes(h[9:13], "little")
                at += (layout.ecc(n) if h[0] & ECC_FLAG else 0) + n
                h, _ = head(at)
                k = TAGS.get(h[0])
            else:
                return
        except Exception:  # noqa: BLE001  damage or the end of the file: the careful parser takes over
            return
        if k != "end" or at + layout.end > end:
            return
        yield pos, at + layout.end, low, high
        pos = at + layout.end


class _Options:
    def __init__(self, options: dict[str, str], added: dict | None = None):
        self.added = added or codecs.ADDED
        low = {k.lower(): v for k, v in options.items()}
        flag = lambda k, d: str(low.get(k, d)).lower() == "true"
        self.path = low.get("path", "")
        self.view = low.get("view", "components")
        self.ecc_len = int(low["ecclen"]) if "ecclen" in low else None
        self.hash_name, self.codec = low.get("hash", "sha256"), low.get("codec", "zstd")
        self.open_tail, self.payload = flag("includeopentail", True), flag("payload", True)
        self.repair, self.resync = flag("repair", self.view != "components"), flag("resync", True)
        self.hint = int(low["starthint"]) if "starthint" in low else None
        self.split = int(low.get("splitbytes", 32 << 20))
        self.level = int(low["level"]) if "level" in low else None
        self.tries = RetryConfig(max_attempts=int(low.get("maxattempts", 5)))

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        codecs.adopt(self.added)


def _open(path: str, o: _Options, mode: str = "rb") -> RetryingFile:
    store, inside = at(path)
    return RetryingFile(inside, mode, o.tries, store.open)


def _layout(handle, o: _Options) -> Layout:
    handle.seek(0)
    return read_config(handle.read(FILE_HEADER), o.ecc_len)


def _row(o: _Options, file: str, no: int, b: Block, j: Journal, out: list[dict]) -> None:
    if o.view == "blocks":
        size = sum(c.data_len for c in b.components)
        whole = sum(c.orig_len if c.orig_len is not None else c.data_len for c in b.components)
        out.append(
            {"file": file, "block_no": no, "kind": b.kind, "mn_start": b.mn_start, "block_start": b.block_start,
             "start_ts": signed(b.start_ts) if b.start_ts else None, "end_ts": signed(b.end_ts) if b.end_ts else None,
             "block_end": b.block_end, "n_components": len(b.components), "errors_corrected": b.errors,
             "stored_hash": b.stored_hash, "computed_hash": b.computed_hash, "state": b.state, "state_at": b.at,
             "component_tag": b.component_tag, "data_contents": whole, "data_size_on_disk": size}
        )
    elif o.view == "segments":
        out += [{"file": file, "block_no": no, "kind": s.kind, "data_start": s.data_start, "data_len": s.data_len, "chunk_start": s.chunk_start, "chunk_ecc_start": s.chunk_ecc_start, "ecc_start": s.ecc_start} for s in b.segments]
    elif b.state == "Closed" or b.state == "OpenBBlock" and o.open_tail:
        for i, c in enumerate(b.components):
            if o.view == "chunks":
                if c.ecc:
                    n, k = j.layout.ecc_len, 255 - j.layout.ecc_len
                    ecc = c.data_start - j.layout.ecc(c.data_len)
                    for m in range(-(-c.data_len // k)):
                        out.append({"file": file, "block_no": no, "comp_no": i, "chunk_no": m, "data": j.raw(c.data_start + m * k, min(k, c.data_len - m * k)), "parity": j.raw(ecc + m * n, n)})
                continue
            data = codecs.restored(j.raw(c.data_start, c.data_len), c.orig_len, o.codec) if o.payload else None
            out.append(
                {"file": file, "block_no": no, "block_kind": b.kind, "block_start": b.block_start, "comp_no": i, "ts": signed(c.ts_raw),
                 "ts_raw": c.ts_raw, "start_pos": c.start_pos, "data_start": c.data_start, "data_len": c.data_len, "ecc": c.ecc,
                 "compressed": c.compressed, "orig_len": c.orig_len, "payload": data, "state": b.state}
            )


def closes(handle, layout: Layout, pos: int, end: int) -> bool:
    """Whether a block that closes begins at pos, from its headers and hash alone: what ``Journal.block`` finds without its content."""
    for _, stop, _, _ in light_walk(handle, layout, pos, end):
        handle.seek(stop - layout.hash)
        j = Journal(handle.read(layout.hash), layout, stop - layout.hash)
        try:
            j.word(j.base, HASH, True, "Hash")
        except Beyond:
            return False
        return True
    return False


def next_closing(handle, layout: Layout, pos: int, end: int, window: int) -> int | None:
    """The first place from pos on at which a block closes, looked for in windows of the file."""
    while pos + layout.mn <= end:
        handle.seek(pos)
        j = Journal(handle.read(min(window + layout.mn, end - pos)), layout, pos)
        for at in j.magics(pos, j.end).tolist():
            if closes(handle, layout, at, end):
                return at
        pos = j.end - layout.mn + 1
    return None


#: States of a block that goes on behind the bytes at hand.
UNENDED = ("OpenABlock", "OpenBBlock", "IncompleteStartHeader")


def damaged_block(handle, layout: Layout, pos: int, end: int, o: _Options, window: int) -> tuple[Block | None, Journal]:
    """The block at pos, at which the walk over headers stopped, and its bytes: read in windows that grow until its end does not matter."""
    while True:
        handle.seek(pos)
        j = Journal(handle.read(min(window, end - pos)), layout, pos, o.hash_name)
        errors = j.magic_at(pos)
        b = None if errors is None else j.block(pos, o.repair, o.repair)
        if j.end >= end or (b is not None and b.state not in UNENDED) or (b is None and len(j.data) >= layout.mn):
            if b is not None:
                b.errors += errors if o.repair else 0
            return b, j
        window *= 4


#: Rows in a batch, which is all that a task holds beside the bytes of a chunk.
ROWS = 4096


def read_range(part: Range, o: _Options, low: int | None = None, high: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of the blocks in a range; with bounds on times, blocks outside are passed over by their headers.

    A chunk of the range, or one block if that is larger, and a batch of rows are held, no more; behind damage as well.
    """
    schema = arrow_schema(SCHEMAS[o.view])
    with _open(part.file, o) as f:
        if o.view == "config":
            yield pa.RecordBatch.from_pylist([{"file": part.file, "head": f.read(FILE_HEADER)}], schema)
            return
        layout = _layout(f, o)
        rows: list[dict] = []
        chunk = max(1, o.split // 32)
        held = 0
        no = part.first_block

        def add(block: Block, j: Journal) -> Iterator[pa.RecordBatch]:
            nonlocal held, no, rows
            _row(o, part.file, no, block, j, rows)
            no += 1
            held += sum(max(c.data_len, c.orig_len or 0) for c in block.components)
            if len(rows) >= ROWS or held >= chunk and rows:
                for i in range(0, len(rows), ROWS):
                    yield pa.RecordBatch.from_pylist(rows[i : i + ROWS], schema)
                rows, held = [], 0

        def parse(a: int, b: int) -> Iterator[pa.RecordBatch]:
            f.seek(a)
            j = Journal(f.read(b - a), layout, a, o.hash_name)
            for block in j.walk(headers=o.repair, content=o.repair, resync=o.resync):
                yield from add(block, j)

        pos: int | None = part.start
        window = chunk
        # Where all blocks are read and repaired their own bytes say where they end.
        while o.repair and low is None and high is None and pos is not None and pos < part.end:
            f.seek(pos)
            j, start = Journal(f.read(min(window, part.end - pos)), layout, pos, o.hash_name), pos
            while pos is not None and pos < j.end:
                errors = j.magic_at(pos)
                block = None if errors is None else j.block(pos)
                if j.end < part.end and (j.end - pos < layout.mn if block is None else block.state in UNENDED):
                    break  # it goes on behind the window
                if block is not None:
                    block.errors += errors
                    yield from add(block, j)
                if block is not None and block.state == "Closed":
                    pos = block.block_end
                else:
                    pos = next_closing(f, layout, pos + 1, part.end, chunk) if o.resync else None
            window = window * 4 if pos == start else chunk
        while pos is not None and pos < part.end:
            batch = pos
            for mn, end, t0, t1 in light_walk(f, layout, pos, part.end):
                out = (low is not None or high is not None) and (t0 is None or (low is not None and t1 < low) or (high is not None and t0 > high))
                if out or end - batch > chunk:
                    if mn > batch:
                        yield from parse(batch, mn)
                    batch = end if out else mn
                    no += int(out)
                pos = end
            if pos > batch:
                yield from parse(batch, pos)
            if pos >= part.end:
                break
            # Damage at which the walk over headers stopped, or the end of the file.
            block, j = damaged_block(f, layout, pos, part.end, o, chunk)
            if block is not None:
                yield from add(block, j)
                if block.state == "Closed":
                    pos = block.block_end
                    continue
            pos = next_closing(f, layout, pos + 1, part.end, chunk) if o.resync else None
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _borders(facts: dict | None) -> list[tuple[int, int]]:
    """(place, block number) where ranges of a published file may begin."""
    return [(FILE_HEADER, 0), *map(tuple, facts["cuts"]), (facts["bytes"], facts["blocks"])] if facts else []


def _ranges(file: str, borders: list[tuple[int, int]]) -> list[Range]:
    return [Range(file, a, b, no) for (a, no), (b, _) in zip(borders, borders[1:], strict=False)]


def _walk(handle, layout: Layout, pos: int | None, end: int, o: _Options) -> Iterator[tuple[int, int]]:
    """(place, number of blocks before it) where blocks end, or begin again behind damage if the reader goes on there."""
    no = 0
    while True:
        for _, pos, _, _ in light_walk(handle, layout, pos, end):
            no += 1
            yield pos, no
        if pos >= end or not o.resync:
            return
        handle.seek(pos)
        no += Journal(handle.read(layout.mn), layout, pos).magic_at(pos) is not None
        pos = next_closing(handle, layout, pos + 1, end, max(1, o.split // 32))
        if pos is None:
            return
        yield pos, no


class JournalReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.o = options
        self.low = self.high = None

    def partitions(self) -> list[Range]:
        out = []
        known = manifest(self.o.path)
        for file in segments(self.o.path):
            if self.o.view == "config":
                out.append(Range(file, 0, FILE_HEADER, 0))
                continue
            size = size_of(file)
            facts = known.get(file.rsplit("/", 1)[-1])
            if facts and facts["bytes"] == size and self.o.hint is None:
                out += self._cut(file, facts)
                continue
            with _open(file, self.o) as f:
                layout = _layout(f, self.o)
                start = FILE_HEADER if self.o.hint is None else self.o.hint - layout.mn
                # The file may have been cut or have grown since it was published: borders count where blocks still begin.
                same = facts is not None and facts["bytes"] == size
                held = [c for c in _borders(facts) if start <= c[0] < size and (same or closes(f, layout, c[0], size))]
                out += self._found(f, file, layout, start, size, held)
        return out

    def _found(self, f, file: str, layout: Layout, start: int, size: int, borders: list[tuple[int, int]], first: int = 0) -> list[Range]:
        """Ranges of a file from ``start`` on, the block number ``first``: from a walk over headers, and from the first published border that it meets on as published."""
        out, at, no = [], start, first
        for pos, n in chain([(start, 0)], _walk(f, layout, start, size, self.o)) if size - start > self.o.split else ():
            if borders and pos == borders[0][0]:
                known = [(a, first + n + b - borders[0][1]) for a, b in borders]
                out += [Range(file, at, pos, no)] if pos > at else []
                return out + _ranges(file, known) + self._found(f, file, layout, known[-1][0], size, [], known[-1][1])
            if borders and pos > borders[0][0]:  # not where blocks of this walk begin
                borders = []
            if pos - at >= self.o.split:
                out.append(Range(file, at, pos, no))
                at, no = pos, first + n
        return [*out, Range(file, at, size, no)] if at < size else out

    def _cut(self, file: str, facts: dict) -> list[Range]:
        """Ranges of a published segment, from its manifest line alone: none if its times lie outside the bounds."""
        if self.o.view == "components" and facts["low"] is not None:
            if (self.low is not None and facts["high"] < self.low) or (self.high is not None and facts["low"] > self.high):
                return []
        return _ranges(file, _borders(facts))

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # none at all where every segment is pruned, or there is no segment
            yield from read_range(partition, self.o, self.low, self.high)


class PushingReader(JournalReader):
    """Takes bounds on ``ts``, which skip segments and blocks; Spark applies them again to rows."""

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("ts",) and self.o.view == "components":
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = f.value if self.low is None else max(self.low, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = f.value if self.high is None else min(self.high, f.value)
            yield f


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    facts: dict | None


#: Bytes between published borders, at which ranges begin, at most (and a block).
BORDER = 8 << 20


def write_segment(rows: Iterator, path: str, o: _Options) -> Written:
    """All rows of a task, whole blocks in order, as one segment, which nobody sees before its manifest."""
    rows = iter(rows)
    head = next(rows, None)
    if head is None:
        return Written(None, None)
    layout = Layout(o.ecc_len or 4)
    store, inside = at(path)
    store.folder(inside)
    name = f"{OWN}{head.block_no:020d}-{uuid.uuid4().hex}.journal"
    facts = {"bytes": 0, "blocks": 0, "low": None, "high": None, "cuts": []}
    cut = FILE_HEADER
    key, hasher, end_ts = None, None, 0
    with _open(f"{path}/{name}", o, "wb") as f:
        f.write(layout.file_header())

        def close() -> None:
            nonlocal hasher
            if hasher is not None:
                f.write(layout.close(end_ts, hasher.digest()))
                hasher = None

        for r in chain([head], rows):
            data = bytes(r.payload) if r.payload is not None else b""
            level = r.level if r.level is not None else o.level
            if r.block_no != key:
                close()
                if f.tell() - cut >= min(o.split, BORDER):  # a later scan may begin here
                    cut = f.tell()
                    facts["cuts"].append((cut, facts["blocks"]))
                key, facts["blocks"] = r.block_no, facts["blocks"] + 1
                f.write(layout.magic)
                if r.kind == "B":
                    f.write(layout.pack(0x20, r.block_ts))
                    hasher = codecs.HASHES[o.hash_name]()
            end_ts = r.end_ts if r.end_ts is not None else r.block_ts
            if r.kind == "A":
                f.write(layout.a_block(r.block_ts, end_ts, data, bool(r.ecc), level, o.hash_name, o.codec))
            elif r.comp_no is not None:
                c = layout.component(r.ts, data, bool(r.ecc), level, o.codec)
                hasher.update(c)
                f.write(c)
            if r.kind == "A" or r.comp_no is not None:
                t = r.block_ts if r.kind == "A" else r.ts
                facts["low"] = t if facts["low"] is None else min(facts["low"], t)
                facts["high"] = t if facts["high"] is None else max(facts["high"], t)
        close()
        facts["bytes"] = f.tell()
    return Written(name, facts)


def publish(path: str, messages: list[Written | None], name: str, overwrite: bool = False) -> None:
    """Writes the manifest that makes all segments visible at once.

    A manifest of this name that exists was published before: the segments are dropped. After a
    commit that was cut off before its manifest, its segments are never seen, and the next commit
    of the same name publishes its own. An overwrite's manifest names those it replaces, so a
    reader sees either all of the old segments or all of the new ones.
    """
    store, inside = at(path)
    target = f"{inside}/_manifest/{name}.json"
    store.folder(f"{inside}/_manifest")
    if store.is_file(target):
        discard(path, messages)
        return
    old, files = [], []
    if overwrite:
        files = [f.rsplit("/", 1)[-1] for f in segments(path)]
        old = [*_manifests(path), *(f for f in files if not f.startswith(OWN))]
    done = {m.name: m.facts for m in messages if m is not None and m.name}
    part = f"{inside}/_manifest/{name}.part-{uuid.uuid4().hex}"
    with RetryingFile(part, "wb", opener=store.open) as f:
        f.write(json.dumps({"segments": done, "replaced": old}).encode())
    store.move(part, target)
    for file in files:
        store.delete(f"{inside}/{file}")
    for x in old:
        store.delete(f"{inside}/_manifest/{x}")


def discard(path: str, messages: list[Written | None]) -> None:
    store, inside = at(path)
    for m in messages:
        if m is not None and m.name:
            store.delete(f"{inside}/{m.name}")


def rows_of(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator:
    """Rows of batches, of which only a few at a time are Python objects."""
    for b in batches:
        kind = namedtuple("Frame", b.schema.names)
        for i in range(0, b.num_rows, most):
            yield from map(kind, *(c.to_pylist() for c in b.slice(i, most).columns))


class JournalWriter(DataSourceArrowWriter):
    def __init__(self, options: _Options, overwrite: bool):
        self.o, self.overwrite = options, overwrite

    def write(self, iterator) -> Written:
        return write_segment(rows_of(iterator), self.o.path, self.o)

    def commit(self, messages) -> None:
        publish(self.o.path, messages, f"batch-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}", self.overwrite)

    def abort(self, messages) -> None:
        discard(self.o.path, messages)


class JournalStreamWriter(DataSourceStreamWriter):
    def __init__(self, options: _Options):
        self.o = options

    def write(self, iterator) -> Written:
        # Rows of a micro-batch come in any order within a task; a block is never split over tasks.
        rows = sorted(iterator, key=lambda r: (r.block_no, -1 if r.comp_no is None else r.comp_no))
        return write_segment(iter(rows), self.o.path, self.o)

    def commit(self, messages, batchId) -> None:
        publish(self.o.path, messages, f"epoch-{batchId:012d}")

    def abort(self, messages, batchId) -> None:
        discard(self.o.path, messages)


class JournalStreamReader(DataSourceStreamReader):
    """Follows growing journals; an offset is the end of the last closed block of each file."""

    def __init__(self, options: _Options):
        self.o = options

    def initialOffset(self) -> dict:
        return {}

    def _walk(self, file: str, start: int):
        with _open(file, self.o) as f:
            if size_of(file) < FILE_HEADER:
                return start, 0
            layout, end, n = _layout(f, self.o), start, 0
            for _, end, _, _ in light_walk(f, layout, start, size_of(file)):
                n += 1
            return end, n

    def latestOffset(self) -> dict:
        out = dict(getattr(self, "seen", {}))
        known = manifest(self.o.path)
        for file in segments(self.o.path):
            end, no = out.get(file, (FILE_HEADER, 0))
            facts = known.get(file.rsplit("/", 1)[-1])
            if facts and end < facts["bytes"] == size_of(file):  # published: all of its blocks are closed
                end, no = facts["bytes"], facts["blocks"]
            if not facts or end < size_of(file):
                end, n = self._walk(file, end)
                no += n
            out[file] = [end, no]
        self.seen = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        known = manifest(self.o.path)
        for file, (stop, no) in end.items():
            first = tuple(start.get(file, (FILE_HEADER, 0)))
            if stop > first[0]:
                facts = known.get(file.rsplit("/", 1)[-1])
                inside = [c for c in _borders(facts) if first[0] < c[0] < stop] if facts and facts["bytes"] == size_of(file) else []
                out += _ranges(file, [first, *inside, (stop, no)])
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from read_range(partition, self.o)

    def commit(self, end: dict) -> None:
        pass


class JournalDataSource(DataSource):
    #: Hashes and codecs of the session that registered the source.
    added: dict | None = None

    def _parsed(self) -> _Options:
        if self.added:
            codecs.adopt(self.added)
        return _Options(self.options, self.added)

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return SCHEMAS[self._parsed().view]

    def reader(self, schema) -> JournalReader:
        from pyspark.sql import SparkSession

        session = SparkSession.getActiveSession()
        push = self.options.get("pushdown") or (session.conf.get("spark.sql.python.filterPushdown.enabled", "false") if session else "false")
        return (PushingReader if str(push).lower() == "true" else JournalReader)(self._parsed())

    def writer(self, schema, overwrite: bool) -> JournalWriter:
        return JournalWriter(self._parsed(), overwrite)

    def streamReader(self, schema) -> JournalStreamReader:
        return JournalStreamReader(self._parsed())

    def streamWriter(self, schema, overwrite: bool) -> JournalStreamWriter:
        return JournalStreamWriter(self._parsed())


def source() -> type[JournalDataSource]:
    """The source as a class of its own that carries what is registered by now to every process it is sent to."""
    return type("JournalDataSource", (JournalDataSource,), {"added": {k: dict(v) for k, v in codecs.ADDED.items()}, "__module__": "__main__"})


def recover_file(path: str, o: _Options, now: int = 0, size: int | None = None) -> dict:
    """The tail that recovery would leave, read backwards in windows that grow until a block closes;
    with ``size``, as if the file ended there."""
    with _open(path, o) as f:
        return recovered(f, _layout(f, o), o, size_of(path) if size is None else size, now)


def recovered(f, layout: Layout, o: _Options, size: int, now: int = 0, flips: dict[int, int] | None = None) -> dict:
    """The same of an open file; with ``flips``, as if the bytes at these places were XORed."""
    window = 1 << 13
    while True:
        base = max(FILE_HEADER, size - window)
        f.seek(base)
        j = Journal(f.read(size - base), layout, base, o.hash_name)
        for at, bits in (flips or {}).items():
            if base <= at < size:
                j.data[at - base] ^= bits
        out = j.recover(now)
        if out["has_blocks"] or base == FILE_HEADER:
            return out | {"tail_from": base, "tail": bytes(j.data)}
        window *= 4


def apply_recovery(path: str, options: dict[str, str] | None = None, now: int | None = None) -> dict:
    """Truncates or closes the tail of one file as planned: the explicit action beside the pure plan.

    Local files are changed in place; elsewhere a whole new file takes the old one's place.
    """
    o = _Options({**(options or {}), "path": path})
    plan = recover_file(path, o, codecs.now_micros() if now is None else now)
    keep = plan["recovered_len"] if plan["has_blocks"] else min(plan["recovered_len"], FILE_HEADER)
    store, inside = at(path)
    if store.remote:
        part = f"{inside}.part-{uuid.uuid4().hex}"
        with _open(path, o) as old, RetryingFile(part, "wb", o.tries, store.open) as new:
            left = min(plan["tail_from"], keep)
            while left:
                block = old.read(min(left, 1 << 20))
                new.write(block)
                left -= len(block)
            new.write(plan["tail"][: max(0, keep - plan["tail_from"])])
        store.move(part, inside)
    else:
        with _open(path, o, "r+b") as f:
            f.seek(plan["tail_from"])
            f.write(plan["tail"])
            f.truncate(keep)
    return {k: v for k, v in plan.items() if k != "tail"}


def check_file(path: str, **options) -> dict:
    """Integrity report of one file; raises on a config mismatch only."""
    o = _Options({**options, "path": path})
    with _open(path, o) as f:
        layout = _layout(f, o)
        f.seek(FILE_HEADER)
        return Journal(f.read(), layout, FILE_HEADER, o.hash_name).integrity()
