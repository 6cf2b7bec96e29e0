"""Best-fit packing into sequences of several permitted lengths.

Token lengths of pieces are whole numbers up to the largest permitted length, so the packing
is decided on their histogram, whose size depends on that length alone: best-fit decreasing
over counts, in which runs of equal pieces go to runs of equal bins. When no open bin fits, the
bin size of least cost is opened: for each permitted length the bin is filled on trial from the
pieces still to come, and its cost per token held decides. A bin of length c costs
``c + overhead + c * c / quadratic``: a fixed part for each sequence, and one for attention,
which grows with the square. At the end
each bin is cut down to the smallest permitted length that holds its contents.

Pieces then find their places by rank within their length: ranks come from counts by (length,
salt) and a row number inside each, so a length that a third of all pieces share is spread over
all salts. Only the histogram goes to the driver, and only the plan, bounded like it, is
broadcast.

Documents longer than the largest length are cut; ``eos`` tokens follow each document. Null and
empty texts have no tokens: one row, length 0, no bin. Repeated rows are packed as often as they
occur. Rows without an id are packed like others. An empty table gives an empty result; only the id
and the text are read, so no other column can clash.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import id_text, materialize

CAPACITIES = (1024, 2048, 4096, 8192)
#: A fixed value: how byte-level vocabularies of this family cut a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(docs: DataFrame, vocabulary: str | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and n_tokens of every whole text; without a vocabulary file, tokens are UTF-8 bytes.

    The file (base64 token and rank on each line) is read on the driver and sent along; its size
    is that of a vocabulary, not of the data.
    """
    src = id_text(docs, key, text)
    if vocabulary is None:
        return src.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_tokens"))
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        count = tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(count(t)) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int64())], [key, "n_tokens"])

    return src.mapInArrow(run, f"`{key}` long, n_tokens long")


@dataclass
class Plan:
    """Slots: pieces of ``length`` and rank in [rank, rank + count) go to bins from ``bin`` on, at ``offset``,
    ``fold`` of them side by side in each bin. Bins: runs of bins with one capacity and one fill."""

    slots: np.ndarray  # length, rank, count, bin, offset, fold
    bins: np.ndarray  # first bin, bins, capacity, used

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bin, offset, capacity) of pieces; rank is within the length."""
        s = self.slots
        at = np.searchsorted(s[:, 0] * (1 << 44) + s[:, 1], length * (1 << 44) + rank, "right") - 1
        nth = rank - s[at, 1]
        bin_id = s[at, 3] + nth // s[at, 5]
        offset = s[at, 4] + nth % s[at, 5] * length
        run = np.searchsorted(self.bins[:, 0], bin_id, "right") - 1
        return bin_id, offset, self.bins[run, 2]


def make_plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = 32, quadratic: int = 1 << 16) -> Plan:
    """Best-fit decreasing over a histogram of lengths."""
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    left = np.zeros(top + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    open_by_space: list[list[tuple[int, int, int]]] = [[] for _ in range(top + 1)]  # space: (first bin, bins, capacity)
    some = np.zeros(top + 1, bool)
    slots, next_bin = [], 0

    def put(space: int, first: int, count: int, cap: int) -> None:
        open_by_space[space].append((first, count, cap))
        some[space] = True

    def trial(n: int, cap: int) -> float:
        """Cost per token of a bin of this capacity filled from the longest pieces left."""
        space, used = cap, 0
        size = n
        while size > 0:
            k = min(space // size, int(left[size]))
            used, space = used + k * size, space - k * size
            below = np.flatnonzero(left[: min(space, size - 1) + 1])
            size = int(below[-1]) if len(below) else 0
        used_cap = next(c for c in capacities if c >= used)
        return (used_cap + overhead + used_cap * used_cap / quadratic) / used

    for n in np.flatnonzero(left)[::-1].tolist():
        rank = 0
        while left[n] > 0:
            fits = int(np.argmax(some[n:])) + n
            if some[fits]:
                first, count, cap = open_by_space[fits].pop()
                some[fits] = bool(open_by_space[fits])
                space = fits
            else:
                cap = min((c for c in capacities if c >= n), key=lambda c: (trial(n, c), c))
                first, space = next_bin, cap
                # As many bins as these pieces fill; all of one run.
                count = -(-int(left[n]) // (cap // n))
                next_bin += count
            fold = min(space // n, int(left[n]))
            full = min(count, int(left[n]) // fold)
            slots.append((n, rank, full * fold, first, cap - space, fold))
            put(space - fold * n, first, full, cap)
            rank += full * fold
            left[n] -= full * fold
            if full < count:
                put(space, first + full, count - full, cap)
    bins = []
    for space, runs in enumerate(open_by_space):
        for first, count, cap in runs:
            used = cap - space
            if used:
                bins.append((first, count, next(c for c in capacities if c >= used), used))
    slots.sort()
    bins.sort()
    as_array = lambda rows, k: np.array(rows, np.int64).reshape(-1, k)
    return Plan(as_array(slots, 6), as_array(bins, 4))


def pack(counts: DataFrame, key: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, eos: int = 1, overhead: int = 32, salts: int | None = None) -> DataFrame:
    """key, piece, start, length, bin_id, bin_offset, capacity from key and n_tokens."""
    top, spark = max(capacities), counts.sparkSession
    salts = salts or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = F.when(F.col("n_tokens") > 0, F.col("n_tokens") + eos).otherwise(F.lit(0).cast("long"))
    pieces = (
        counts.select(F.col(key).alias("k"), total.alias("t"))
        .select("k", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("t") / top) - 1, F.lit(0)).cast("long"))).alias("piece"))
        .select("k", "piece", (F.col("piece") * top).alias("start"), F.least(F.col("t") - F.col("piece") * top, F.lit(top)).cast("long").alias("length"))
        # Salts go by row, not by id: rows without an id, or of one repeated id, are spread as well.
        .withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    )
    pieces = materialize(pieces)  # counted and ranked from the same rows, salts fixed
    by_salt = pieces.where("length > 0").groupBy("length", "salt").count()
    # At most (largest length) x salts rows, whatever the input.
    by_salt = by_salt.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    by_salt = materialize(by_salt.select("length", "salt", "count", F.coalesce("before", F.lit(0)).alias("before")))
    histogram = {r[0]: r[1] for r in by_salt.groupBy("length").agg(F.sum("count")).collect()}
    plan = spark.sparkContext.broadcast(make_plan(histogram, capacities, overhead))
    ranked = (
        # Counts grow with the salts: a merge join, whose partitions the row numbers use again.
        pieces.join(by_salt.select("length", "salt", "before").hint("merge"), ["length", "salt"], "left")
        .withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("k", "piece")) - 1 + F.coalesce("before", F.lit(0)))
        .select("k", "piece", "start", "length", "rank")
    )

    def place(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            on = length > 0
            out = np.zeros((3, len(length)), np.int64)
            if on.any():
                out[:, on] = plan.value.place(length[on], rank[on])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("k", "piece", "start", "length")), *(pa.array(x, pa.int64(), mask=~on) for x in out)],
                [key, "piece", "start", "length", "bin_id", "bin_offset", "capacity"],
            )

    return ranked.mapInArrow(place, f"`{key}` long, piece long, start long, length long, bin_id long, bin_offset long, capacity long")


def pack_documents(docs: DataFrame, vocabulary: str | None, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """Token counts of every document, packed."""
    return pack(token_counts(docs, vocabulary), capacities=capacities)


def tokenizer_of(path: str) -> Callable[[str], list[int]]:
    """The encoder of a vocabulary file, for tests."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
