"""Key exchange between chunks of documents and shards of keys.

Documents are written once as chunks of about ``CHUNK_BYTES`` of text (whole rows, compressed
Arrow). Each chunk sends one entry for each *distinct* key it holds to the key's shard; the
shard sees all chunks' entries, decides, and replies to chunks. A key that a third of all
documents hold is one entry for each chunk, so no shard and no chunk grows with a hot key's
documents.

Entries travel as packed arrays: the chunks of a task share one row for each shard (entries say
which chunk they are of), and a shard's replies to them are one row, so rows are as many as blocks
of an ordinary shuffle. There are as many shards as shuffle partitions, or more where these would
hold the keys of more than ``SHARD_BYTES`` of text. Replies and chunks meet in a stream sorted
by task: a worker holds the replies to one task and one chunk at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import materialize, utf8

CHUNK_BYTES = 2 << 20
#: Chunks of a task; with these and 20 bits for rows, 27 bits are left for tasks.
CHUNK_BITS = 16
SHARD_BYTES = 128 << 20
#: Entries that a task gathers before it deals them to shards.
FLUSH_BYTES = 16 << 20
CHUNKS = "task int, chunk long, rows long, bytes long, blob binary"

Arrays = dict[str, np.ndarray]
Kinds = dict[str, object]


def _blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(blob: pa.Buffer) -> pa.Table:
    """The rows of a chunk."""
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()


@dataclass(frozen=True)
class Chunks:
    """Written chunks, the number of tasks that wrote them, and how many shards their keys need."""

    df: DataFrame
    tasks: int
    shards: int


def chunked(df: DataFrame, text: str = "text", target: int = CHUNK_BYTES) -> Chunks:
    """``df`` written as chunks; their numbers are fixed once written."""

    def cut(batches):
        task, n = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def out():
            nonlocal held, size, n
            table = pa.Table.from_batches(held).combine_chunks()
            batch = table.to_batches(max_chunksize=max(1, table.num_rows))[0]
            if n >> CHUNK_BITS:
                raise ValueError("too many chunks in one task: raise the number of input partitions")
            row = pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int32()), pa.array([(task << CHUNK_BITS) + n]), pa.array([batch.num_rows]), pa.array([size]), pa.array([_blob(batch)], pa.binary())],
                ["task", "chunk", "rows", "bytes", "blob"],
            )
            held, size, n = [], 0, n + 1
            return row

        for b in batches:
            if not b.num_rows:
                continue
            offsets, _ = utf8(b.column(text))
            weight = offsets + 64 * np.arange(len(offsets))  # rows have a weight besides their text
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(weight, weight[at] + target - size, "right")) - 1)
                held.append(b.slice(at, to - at))
                size += int(weight[to] - weight[at])
                at = to
                if size >= target or at < b.num_rows:
                    yield out()
        if held:
            yield out()

    chunks = materialize(df.mapInArrow(cut, CHUNKS))
    last, size = chunks.agg(F.max("task"), F.sum("bytes")).first()
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Chunks(chunks, 1 + (last or 0), max(1, wanted, -(-(size or 0) // SHARD_BYTES)))


def _fields(columns: Kinds) -> str:
    return "".join(f", {c} binary" for c in columns)


def _bytes_of(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of an array's rows between cuts, as bytes."""
    x = np.ascontiguousarray(x)
    width = x.dtype.itemsize * int(np.prod(x.shape[1:], dtype=np.int64))
    offsets = (cuts.astype(np.int64) - cuts[0]) * width
    data = x[cuts[0] : cuts[-1]].view(np.uint8).reshape(-1) if x.size else np.empty(0, np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _array(column: pa.Array | pa.ChunkedArray, kind) -> np.ndarray:
    """All bytes of a column as one array."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column if x.is_valid), kind)


def _dealt(task: int, keys: np.ndarray, n: int, columns: Arrays) -> pa.RecordBatch | None:
    """Entries of one task, one row for each shard."""
    if not len(keys):
        return None
    part = (keys >> np.uint64(32)).astype(np.int64) * n >> 32
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    arrays = [pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(cuts) - 1, task, np.int32))]
    names = ["part", "task"]
    for name, x in {"keys": keys, **columns}.items():
        arrays.append(_bytes_of(x[order], cuts))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names)


class _Outbox:
    """Entries of a task's chunks until they are dealt; with ``merge``, which makes equal keys one, without their chunks."""

    def __init__(self, n: int, columns: Kinds, merge: Callable | None):
        self.n, self.columns, self.merge = n, columns, merge
        self.held: list[tuple[np.ndarray, Arrays]] = []
        self.task, self.size = None, 0

    def add(self, chunk: int, keys: np.ndarray, columns: Arrays) -> Iterator[pa.RecordBatch]:
        task = chunk >> CHUNK_BITS
        if task != self.task:
            yield from self.flush()
            self.task = task
        if len(keys):
            if self.merge is None:
                columns = {"nth": np.full(len(keys), chunk & ((1 << CHUNK_BITS) - 1), np.uint16), **columns}
            self.held.append((keys, columns))
            self.size += keys.nbytes + sum(x.nbytes for x in columns.values())
        if self.size >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys = np.concatenate([k for k, _ in self.held])
            columns = {c: np.concatenate([x[c] for _, x in self.held]) for c in self.held[0][1]}
            if self.merge is not None:
                keys, columns = self.merge(keys, columns)
            row = _dealt(self.task, keys, self.n, columns)
            if row is not None:
                yield row
        self.held, self.size = [], 0


def scattered(chunks: Chunks, columns: Kinds, send: Callable[[int, pa.Table], tuple[np.ndarray, Arrays]], merge: Callable | None = None) -> DataFrame:
    """Every chunk's entries, dealt to shards by key."""

    def run(batches):
        box = _Outbox(chunks_n, columns, merge)
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("blob"), strict=True):
                yield from box.add(chunk, *send(chunk, opened(blob.as_buffer())))
        yield from box.flush()

    chunks_n = chunks.shards
    kept = columns if merge else {"nth": np.uint16, **columns}
    return chunks.df.select("chunk", "blob").mapInArrow(run, f"part int, task int, keys binary{_fields(kept)}").repartitionById(chunks_n, F.col("part"))


def gathered(batches: Iterator[pa.RecordBatch], columns: Kinds, named: bool = True) -> Arrays | None:
    """All entries of a shard: keys, other columns, and with ``named`` the chunk of each."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    table = pa.Table.from_batches(held)
    out = {name: _array(table.column(name), kind) for name, kind in {"keys": np.uint64, **columns}.items()}
    if named:
        size = [len(x.as_buffer()) // 8 for x in table.column("keys")]
        out["chunk"] = (np.repeat(table.column("task").to_numpy().astype(np.int64), size) << CHUNK_BITS) + _array(table.column("nth"), np.uint16)
    return out


def _reply(out: Arrays, back: Kinds) -> pa.RecordBatch | None:
    """Arrays with ``chunk`` as one row for each task."""
    chunk = np.asarray(out["chunk"], np.int64)
    if not len(chunk):
        return None
    order = np.argsort(chunk, kind="stable")
    task = chunk[order] >> CHUNK_BITS
    cuts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
    nth = (chunk[order] & ((1 << CHUNK_BITS) - 1)).astype(np.uint16)
    arrays = [pa.array(task[cuts[:-1]].astype(np.int32)), _bytes_of(nth, cuts), *(_bytes_of(np.asarray(out[c])[order], cuts) for c in back)]
    return pa.RecordBatch.from_arrays(arrays, ["task", "nth", *back])


def _reply_schema(back: Kinds) -> str:
    return f"task int, nth binary{_fields(back)}"


def replied(entries: DataFrame, columns: Kinds, back: Kinds, decide: Callable[[Arrays], Arrays]) -> DataFrame:
    """``decide`` on each shard's entries; its arrays, with ``chunk``, go back to the chunks."""

    def run(batches):
        got = gathered(batches, columns)
        row = _reply(decide(got), back) if got is not None else None
        if row is not None:
            yield row

    return entries.mapInArrow(run, _reply_schema(back))


def published(entries: DataFrame, columns: Kinds, arrays: Kinds, make: Callable[[Arrays], Arrays]) -> DataFrame:
    """Every shard's index: the arrays that ``make`` builds from its entries, written to the shared folder."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        got = gathered(iter(held), columns, named=False)
        if got is not None:
            out = make(got)
            part = held[0].column("part")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(_bytes_of(out[c], np.array([0, len(out[c])])) for c in arrays)], ["part", *arrays])

    return materialize(entries.mapInArrow(run, f"part int{_fields(arrays)}"))


def probed(chunks: Chunks, index: DataFrame, arrays: Kinds, probes: DataFrame, columns: Kinds, back: Kinds, answer: Callable[[Arrays, Arrays], Arrays]) -> DataFrame:
    """Probes meet their shard's index: ``answer(index, probes)`` on one row of probes at a time."""
    none = F.lit(None)
    ours = {f"i_{c}": c for c in arrays}
    theirs = ["task", "keys", "nth", *columns]
    left = index.select("part", F.lit(0).alias("kind"), *(F.col(c).alias(i) for i, c in ours.items()), *(none.cast("int" if c == "task" else "binary").alias(c) for c in theirs))
    right = probes.select("part", F.lit(1).alias("kind"), *(none.cast("binary").alias(i) for i in ours), *theirs)
    both = left.unionByName(right).repartitionById(chunks.shards, F.col("part")).sortWithinPartitions("part", "kind")

    def run(batches):
        part, held = None, None
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                if row.column("kind")[0].as_py() == 0:
                    part, held = row.column("part")[0].as_py(), {c: _array(row.column(k), arrays[c]) for k, c in ours.items()}
                elif row.column("part")[0].as_py() == part:
                    out = _reply(answer(held, gathered(iter([row]), columns)), back)
                    if out is not None:
                        yield out

    return both.mapInArrow(run, _reply_schema(back))


def packed_rows(df: DataFrame, back: dict[str, type]) -> DataFrame:
    """Rows with ``chunk`` and plain number columns in the form of replies."""

    def run(batches):
        for b in batches:
            row = _reply({"chunk": b.column("chunk").to_numpy(), **{c: b.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in back.items()}}, back) if b.num_rows else None
            if row is not None:
                yield row

    return df.select("chunk", *back).mapInArrow(run, _reply_schema(back))


def _met(chunks: Chunks, replies: list[tuple[DataFrame, Kinds]], begin: Callable, schema: str) -> DataFrame:
    """``handle(chunk, table, *arrays of its replies)`` for every chunk, then ``rest()``, of ``handle, rest = begin()`` in each task."""
    none = F.lit(None)
    fields = [f"r{i}_{c}" for i, (_, back) in enumerate(replies) for c in ("nth", *back)]
    kinds = {f"r{i}_{c}": t for i, (_, back) in enumerate(replies) for c, t in {"nth": np.uint16, **back}.items()}
    both = chunks.df.select("task", F.lit(9).alias("kind"), "chunk", "blob", *(none.cast("binary").alias(f) for f in fields))
    for i, (df, back) in enumerate(replies):
        own = {f"r{i}_{c}": F.col(c) for c in ("nth", *back)}
        both = both.unionByName(df.select("task", F.lit(i).alias("kind"), none.cast("long").alias("chunk"), none.cast("binary").alias("blob"), *(own.get(f, none.cast("binary")).alias(f) for f in fields)))
    both = both.repartitionById(chunks.tasks, F.col("task")).sortWithinPartitions("task", "kind", "chunk")
    groups = [[f for f in fields if f.startswith(f"r{i}_")] for i in range(len(replies))]

    def run(batches):
        handle, rest = begin()
        task, held, ready = None, {f: [] for f in fields}, None
        for b in batches:
            where = [b.schema.get_field_index(f) for f in fields]
            for i, (t, kind, chunk) in enumerate(zip(b.column("task").to_pylist(), b.column("kind").to_pylist(), b.column("chunk").to_pylist(), strict=True)):
                if t != task:
                    task, held, ready = t, {f: [] for f in fields}, None
                if kind < 9:
                    for f, at in zip(fields, where, strict=True):
                        if b.column(at)[i].is_valid:
                            held[f].append(b.column(at)[i].as_buffer().to_pybytes())
                    continue
                if ready is None:  # all replies to the task are here: in order of chunk
                    ready = []
                    for group in groups:
                        arrays = [np.frombuffer(b"".join(held.pop(f)), kinds[f]) for f in group]
                        order = np.argsort(arrays[0], kind="stable")
                        ready.append([x[order] for x in arrays])
                nth, got = chunk & ((1 << CHUNK_BITS) - 1), []
                for group, arrays in zip(groups, ready, strict=True):
                    x, y = np.searchsorted(arrays[0], [nth, nth + 1])
                    got.append({f.split("_", 1)[1]: a[x:y] for f, a in zip(group[1:], arrays[1:], strict=True)})
                yield from handle(chunk, opened(b.column("blob")[i].as_buffer()), *got)
        yield from rest()

    return both.mapInArrow(run, schema)


def resolved(chunks: Chunks, replies: list[tuple[DataFrame, Kinds]], schema: str, finish: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
    """Every chunk with its replies of each kind (none: empty arrays)."""
    return _met(chunks, replies, lambda: (finish, lambda: iter(())), schema)


def rescattered(chunks: Chunks, replies: list[tuple[DataFrame, Kinds]], columns: Kinds, send: Callable[..., tuple[np.ndarray, Arrays]]) -> DataFrame:
    """A further round: entries of every chunk, given its replies so far."""
    n = chunks.shards

    def begin():
        box = _Outbox(n, columns, None)
        return (lambda chunk, *rest: box.add(chunk, *send(chunk, *rest))), box.flush

    return _met(chunks, replies, begin, f"part int, task int, keys binary{_fields({'nth': None, **columns})}").repartitionById(n, F.col("part"))
