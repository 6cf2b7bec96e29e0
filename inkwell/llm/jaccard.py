"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document is its set of distinct ``width``-word shingles, as 64-bit hashes. Equal sets are one
class, named by its smallest document; only classes are joined.

Two sets of Jaccard similarity t or more differ in at most H = (1-t)/(1+t) * (|R|+|S|) elements.
Sizes fall into bands in which neighbours can be similar; for each band the universe of hashes
is cut into segments, and each segment is given one unit (its subset is indexed: it must be
equal) or two (also every subset with one element deleted: it may differ by one). With more
units than H, similar sets agree in some segments; a cost model picks the allocation for each
band. Spare units, a quarter of H, make similar sets agree in many segments at once.

That is what keeps chance agreements out. A first exchange counts how many classes hold each
key. A class with fewer shared keys than similar sets must have in common leaves the join. The
shared keys of the others are dealt by a hash to one block fewer than similar sets have in common,
so that these agree in two keys of some block: what is indexed is every two keys of a block. Sets that
lack segments, and so may have fewer keys in common, also index coarser blocks, or at last single
keys. Under an index entry every class is linked to the first one, and a class's equal links are
made one where its chunk is: candidates are at most one for each entry that a class sends, and one for
each class of a family, however large.

Candidate clusters are then joined exactly by prefix filtering and counted intersections. A cluster
is cut into blocks of bounded size; each block is joined in itself and with one centre of the whole
cluster. What is joined to the centre in its block needs no comparison with the like of other
blocks; only sets that are not are compared with all of the cluster, a block of them with one of
the cluster at a time. So no link is lost, no unbounded group meets in one task, and a family
of near copies costs what its members cost. Only links that join two components are kept.
Components are the smallest document reachable.

Documents without words or text have an empty set and link with nothing. Rows without an id have
no component. Rows of one id are one document. Repeated rows each give a row. An empty table gives
an empty result; other columns are not read, so none can clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import words as W
from inkwell.llm.common import id_text, materialize, slices, spent, utf8
from inkwell.llm.components import components
from inkwell.llm.exchange import CHUNK_BITS, Chunks, chunked, gathered, packed_rows, replied, rescattered, resolved, scattered

WIDTH, PERCENT = 3, 90
#: Tokens of a block at most, and about as many sets as the blocks of a family are cut to.
BLOCK_TOKENS, BLOCK_SETS = 2_000_000, 64
COPIES = 8


def shingle_sets(column: pa.ChunkedArray, width: int = WIDTH):
    """The sorted shingle hashes of each text in turn."""
    offsets, data = utf8(column)
    for a, b in slices(offsets):
        off, d = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        s, e, row = W.word_spans(d, off, W.NOT_SPACE)
        h = W.span_hashes(d, s, e, W.LOWER_CODES)
        g = W.grams(h, width, 0)
        begin = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            x, y = begin[i], begin[i + 1]
            if y - x >= width:
                yield np.unique(g[x : y - width + 1])
            elif y > x:
                yield W.grams(h[x:y], int(y - x), 0)
            else:
                yield np.empty(0, np.uint64)


# Size bands and allocations


def bands(percent: int):
    """Upper sizes of consecutive bands: a band's largest set can be similar to its smallest."""
    low = 1
    while True:
        up = low * 100 // percent
        yield low, up
        low = up + 1


@lru_cache(maxsize=None)
def _band_list(percent: int, least: int) -> list[tuple[int, int]]:
    out = []
    for band in bands(percent):
        out.append(band)
        if band[1] >= least:
            return out


def band_of(size: int, percent: int) -> int:
    top = 1 << max(8, int(size).bit_length())
    ups = [u for _, u in _band_list(percent, top)]
    return int(np.searchsorted(ups, size))


@dataclass(frozen=True)
class Allocation:
    """Segments of a context, how many of them have two units, and in how many similar sets agree."""

    segments: int
    double: int
    agree: int

    @property
    def spare(self) -> int:
        """Empty segments up to which agreement on them is not indexed."""
        return self.agree - 1


@lru_cache(maxsize=None)
def allocation(band: int, percent: int, rare: float = 1e-3) -> Allocation:
    """For the context of a band and the next.

    The cost of an allocation is its keys for each set, plus what a chance agreement with another
    set of the band costs: a segment of few elements agrees by chance with probability
    ``rare ** elements`` for each of a million sets.
    """
    top = _band_list(percent, 1 << 8)
    k = 8
    while len(top) <= band + 1:
        k += 1
        top = _band_list(percent, 1 << k)
    up, up2 = top[band][1], top[band + 1][1]
    most = min(up2, up * 100 // percent)
    apart = (100 - percent) * (up + most) // (100 + percent)
    units = apart + 1 + max(1, apart // 4)
    best = None
    for double in sorted({0, units // 8, units // 4, units // 2}):
        segments = units - double
        single = segments - double
        each = up / segments
        keys = single + double * (1 + each)
        chance = single * rare**each + double * (1 + each) * rare ** max(each - 1, 0)
        cost = keys + chance * 1e6
        if best is None or cost < best[0]:
            # Differences spoil a segment of one unit each, and one of two units in twos.
            spoiled = min(single, apart) + max(0, apart - single) // 2
            best = (cost, Allocation(segments, double, segments - spoiled))
    return best[1]


def context_keys(h: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, int]:
    """(distinct index keys of a sorted set in one context, segments whose agreement may not be indexed).

    A bare set indexes its small segments too, but a partner that is not bare does not index the
    ones they share, so these count as silent for both.
    """
    plan = allocation(band, percent)
    seg = ((h >> np.uint64(32)) * np.uint64(plan.segments) >> np.uint64(32)).astype(np.int64)
    value = W.mix(h + np.uint64(0x5851F42D4C957F2D))
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])) if len(h) else np.empty(0, np.int64)
    sums = np.zeros(plan.segments, np.uint64)
    count = np.zeros(plan.segments, np.int64)
    if len(h):
        sums[seg[first]] = np.add.reduceat(value, first)
        count[seg[first]] = np.diff(np.append(first, len(h)))
    least = np.ones(plan.segments, np.int64)
    least[: plan.double] = 2
    small = count < least  # empty, or at most one element where one may differ
    silent = int(small.sum())
    bare = silent > plan.spare  # so many that agreement on them must count
    tag = W.mix(np.arange(plan.segments, dtype=np.uint64) + np.uint64((band + 1) << 20))
    on = (count > 0) | bare
    keys = W.mix(sums[on] ^ tag[on])
    if plan.double:
        inside = seg < plan.double
        if not bare:
            inside &= count[seg] > 1
        keys = np.unique(np.concatenate([keys, W.mix((sums[seg[inside]] - value[inside]) ^ tag[seg[inside]])]))
    return keys, silent


def contexts(h: np.ndarray, percent: int) -> list[int]:
    """Contexts of a set: its own band's, and that of the band below."""
    band = band_of(len(h), percent)
    return [b for b in (band - 1, band) if b >= 0]


def similar(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


# Exact join of one block, or of two


def forest(nodes: np.ndarray, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join components among these sets, by prefix filtering; with ``side``, only across sides.

    Tokens are ordered by rising frequency. The set of the most frequent tokens is compared with
    all others first, as it links most of a family of near copies; the rest look for candidates
    in other components by the prefixes of their tokens, and count intersections exactly.
    """
    n = len(nodes)
    size = np.array([len(s) for s in sets], np.int64)
    tokens, inverse, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(tokens))
    owner = np.repeat(np.arange(n), size)
    flat = rank[inverse]
    order = np.lexsort((flat, owner))
    flat = flat[order]
    begin = np.concatenate([[0], np.cumsum(size)])
    label = np.arange(n)
    members = {i: [i] for i in range(n)}
    out: list[tuple[int, int]] = []
    mark = np.zeros(len(tokens), bool)

    def link(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = label[i], label[j]
            if a != b:
                out.append((int(nodes[i]), int(nodes[j])))
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                label[members[b]] = a
                members[a] += members.pop(b)

    def common(i: int, others: np.ndarray) -> np.ndarray:
        mark[flat[begin[i] : begin[i + 1]]] = True
        lens = size[others]
        at = np.repeat(begin[others] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        got = np.add.reduceat(mark[flat[at]].astype(np.int64), np.concatenate([[0], np.cumsum(lens)[:-1]]))
        mark[flat[begin[i] : begin[i + 1]]] = False
        return got

    def compare(i: int, others: np.ndarray) -> None:
        others = others[(label[others] != label[i]) & (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i]))]
        if side is not None:
            others = others[side[others] != side[i]]
        if len(others):
            link(i, others[similar(common(i, others), size[others], size[i], percent)])

    weight = np.add.reduceat(often[np.argsort(often, kind="stable")][flat].astype(float), begin[:-1]) / size
    compare(int(weight.argmax()), np.arange(n))
    prefix = size - (percent * size + 99) // 100 + 1
    near = np.concatenate([np.arange(b, b + p) for b, p in zip(begin[:-1], prefix, strict=True)])
    by = near[np.argsort(flat[near], kind="stable")]
    posts = np.searchsorted(flat[by], np.arange(len(tokens) + 1))
    who = np.searchsorted(begin, by, "right") - 1
    for i in np.argsort(size, kind="stable").tolist():
        t = flat[begin[i] : begin[i] + prefix[i]]
        lists = [who[posts[x] : posts[x + 1]] for x in t.tolist() if posts[x + 1] - posts[x] > 1]
        if lists:
            c = np.concatenate(lists)
            c = c[label[c] != label[i]]
            if len(c):
                compare(i, np.unique(c))
    return out


# The distributed plan

CLASS = {"check": np.uint64, "low": np.int64}
NAMED = {"keys": np.uint64, "check": np.uint64, "low": np.int64}
COUNTED = {"times": np.uint8}
SEEN = {"keys": np.uint64, "times": np.uint8}
KEYED = {"row": np.uint32}
LINK = {"row": np.uint32, "low": np.int64}
LEAD = {"row": np.uint32, "node": np.int64}
PLACED = {"row": np.uint32, "node": np.int64, "component": np.int64, "parts": np.int32, "block": np.int32}
#: A chunk has fewer rows than this many bits count: each weighs 64 bytes at least.
ROW_BITS = 20


def _name_classes(got: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The smallest document of each distinct set, to every chunk that holds the set."""
    order = np.lexsort((got["low"], got["check"], got["keys"]))
    keys, check, low = (got[c][order] for c in ("keys", "check", "low"))
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (check[1:] != check[:-1])]))
    owner = np.repeat(low[first], np.diff(np.append(first, len(keys))))
    return {"chunk": got["chunk"][order], "keys": keys, "check": check, "low": owner}


def _identity(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    total = int(W.mix(h).sum(dtype=np.uint64)), int(W.mix(h ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64))
    both = W.mix(np.array(total, np.uint64) + np.uint64(len(h)))
    return int(both[0]), int(both[1])


def _count(got: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Keys of two classes or more, with their number up to 255, to every chunk that holds them."""
    order = np.argsort(got["keys"], kind="stable")
    keys = got["keys"][order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.add.reduceat(got["times"][order].astype(np.int64), first)
    total = np.repeat(np.minimum(total, 255), np.diff(np.append(first, len(keys))))
    on = total > 1
    return {"chunk": got["chunk"][order][on], "keys": keys[on], "times": total[on].astype(np.uint8)}


def _twos(keys: np.ndarray, blocks: int) -> np.ndarray:
    """An entry for every two keys that a hash deals to the same one of ``blocks`` blocks."""
    block = (W.mix(keys + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    order = np.lexsort((keys, block))
    keys, block = keys[order], block[order]
    out = []
    for d in range(1, len(keys)):
        i = np.flatnonzero(block[d:] == block[:-d])
        if not len(i):
            break
        out.append(W.mix(W.mix(keys[i] + np.uint64(blocks)) ^ keys[i + d]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _indexed(h: np.ndarray, percent: int, known: np.ndarray, times: np.ndarray):
    """For each context, the shared keys of a set and what goes to the index: (context, keys, silent segments, entries).

    Similar sets agree in ``agree`` segments, of which ``silent`` ones may have no common keys; with
    fewer shared keys than the rest there is nothing to find. So they have as many keys in common as
    the needier of both must have. With more than there are blocks, two of them meet in a block. A set whose
    need is no larger than the number of blocks goes on to half as many, and then to its rarest
    single keys, without as many of the most frequent ones as leave one that both index. What the needier
    set indexes the other one does too. One common key is the least for a bare set: a partner that is
    not bare has some of its own.
    """
    for c in contexts(h, percent):
        keys, silent = context_keys(h, c, percent)
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        shared = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        keys, often = keys[shared], times[at[shared]] if len(known) else times
        agree = allocation(c, percent).agree
        least = max(1, agree - silent)
        if len(keys) < least:
            continue
        entries = []
        for blocks in (agree - 1, (agree - 1) // 2):
            if blocks:
                entries.append(_twos(keys, blocks))
                if least > blocks:
                    break
        else:
            entries.append(keys[np.lexsort((keys, often))][: len(keys) - least + 1])
        yield c, keys, silent, np.unique(np.concatenate(entries))


def _firsts(got: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The first class under each entry, once to every other class that sent one with it."""
    node = (got["chunk"] << ROW_BITS) + got["row"]
    order = np.lexsort((node, got["keys"]))
    keys, node = got["keys"][order], node[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    low = np.repeat(node[first], np.diff(np.append(first, len(keys))))
    node, low = _distinct(node[low != node], low[low != node])
    return {"chunk": node >> ROW_BITS, "row": (node & ((1 << ROW_BITS) - 1)).astype(np.uint32), "low": low}


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of two columns."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    return a[new], b[new]


def _links(chunks: Chunks, firsts: DataFrame) -> DataFrame:
    """u, v: every class's distinct links to first classes, from the replies of all shards to its task."""

    def run(batches):
        task, held = None, []

        def out():
            chunk = (task << CHUNK_BITS) + np.concatenate([nth for nth, _, _ in held]).astype(np.int64)
            node, low = _distinct((chunk << ROW_BITS) + np.concatenate([row for _, row, _ in held]), np.concatenate([low for _, _, low in held]))
            return pa.RecordBatch.from_pydict({"u": low, "v": node})

        for b in batches:
            columns = [b.column(c) for c in ("nth", "row", "low")]
            for i, t in enumerate(b.column("task").to_pylist()):
                if t != task and held:
                    yield out()
                    held = []
                task = t
                held.append([np.frombuffer(x[i].as_buffer(), kind) for x, kind in zip(columns, (np.uint16, np.uint32, np.int64), strict=True)])
        if held:
            yield out()

    return firsts.repartitionById(chunks.tasks, F.col("task")).sortWithinPartitions("task").mapInArrow(run, "u long, v long")


def class_table(docs: DataFrame, key: str, text: str, width: int) -> tuple[Chunks, DataFrame]:
    """(chunks, rows): for each document its set's size, its class, its place, and whether it leads the class."""
    chunks = chunked(id_text(docs, key, text), text)

    def send(chunk, table):
        low: dict[tuple[int, int], int] = {}
        for doc, h in zip(table.column(key).to_pylist(), shingle_sets(table.column(text), width), strict=True):
            if doc is not None and len(h):
                k = _identity(h)
                low[k] = min(low.get(k, doc), doc)
        pairs = np.array(list(low), np.uint64).reshape(-1, 2)
        return np.ascontiguousarray(pairs[:, 0]), {"check": np.ascontiguousarray(pairs[:, 1]), "low": np.array(list(low.values()), np.int64)}

    def finish(chunk, table, got):
        owner = dict(zip(zip(got["keys"].tolist(), got["check"].tolist(), strict=True), got["low"].tolist(), strict=True))
        size, name, leads, done = [], [], [], set()
        for doc, h in zip(table.column(key).to_pylist(), shingle_sets(table.column(text), width), strict=True):
            size.append(len(h))
            k = _identity(h) if doc is not None and len(h) else None
            rep = owner[k] if k else None
            name.append(rep if rep is not None else doc)
            leads.append(rep is not None and rep == doc and k not in done)
            if leads[-1]:
                done.add(k)
        columns = {"doc": table.column(key), "n": pa.array(size, pa.int64()), "class": pa.array(name, pa.int64()), "chunk": pa.array([chunk] * len(size), pa.int64())}
        yield from pa.table({**columns, "row": pa.array(range(len(size)), pa.int64()), "lead": pa.array(leads, pa.bool_())}).combine_chunks().to_batches()

    named = replied(scattered(chunks, CLASS, send), CLASS, NAMED, _name_classes)
    return chunks, materialize(resolved(chunks, [(named, NAMED)], "doc long, n long, class long, chunk long, row long, lead boolean", finish))


def similarity_links(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(rows, links): the class of each document, and links u, v between classes that connect all similar ones."""
    chunks, rows = class_table(docs, key, text, width)
    leads = rows.where("lead").select("chunk", "row", F.col("class").alias("node"), "n")
    packed = materialize(packed_rows(leads, LEAD))

    def count(chunk, table, lead):
        """A chunk's distinct keys and how many of its classes hold each."""
        keys = [context_keys(h, c, percent)[0] for h, _, _ in _picked(table, lead, text, width) for c in contexts(h, percent)]
        if not keys:
            return np.empty(0, np.uint64), {}
        k, times = np.unique(np.concatenate(keys), return_counts=True)
        return k, {"times": np.minimum(times, 255).astype(np.uint8)}

    def index(chunk, table, lead, counts):
        """A chunk's index entries, given the numbers of its keys."""
        order = np.argsort(counts["keys"])
        known, times = counts["keys"][order], counts["times"][order]
        keys, rows = [], []
        for h, row, _ in _picked(table, lead, text, width):
            sent = [entries for _, _, _, entries in _indexed(h, percent, known, times)]
            keys += sent
            rows += [np.full(len(k), row, np.uint32) for k in sent]
        return (np.concatenate(keys), {"row": np.concatenate(rows)}) if keys else (np.empty(0, np.uint64), {})

    counted = materialize(replied(rescattered(chunks, [(packed, LEAD)], COUNTED, count), COUNTED, SEEN, _count))
    firsts = replied(rescattered(chunks, [(packed, LEAD), (counted, SEEN)], KEYED, index), KEYED, LINK, _firsts)
    candidates = components(_links(chunks, firsts))
    spent(packed, counted)
    place = F.shiftleft(F.col("chunk"), ROW_BITS) + F.col("row")
    clustered = materialize(candidates.withColumnRenamed("node", "place").join(leads.withColumn("place", place), "place").drop("place"))
    return rows, _joined_blocks(materialize(_sets_of(chunks, _blocks(clustered, block_tokens), text, width)), percent, block_tokens)


def _picked(table: pa.Table, rows: dict[str, np.ndarray], text: str, width: int):
    """(set, row, place among ``rows``) of some rows of a chunk; other texts are not parsed."""
    order = np.argsort(rows["row"], kind="stable")
    at = rows["row"][order]
    if len(at):
        yield from zip(shingle_sets(table.column(text).take(pa.array(at)), width), at.tolist(), order.tolist(), strict=True)


def _blocks(clustered: DataFrame, block_tokens: int) -> DataFrame:
    """Clusters are cut by a hash into blocks of about ``BLOCK_SETS`` sets, or fewer of more than ``block_tokens`` tokens."""
    cut = lambda most, of: F.ceil(of / F.lit(most))
    total = clustered.groupBy("component").agg(F.greatest(cut(block_tokens, F.sum("n")), cut(BLOCK_SETS, F.count("*"))).cast("int").alias("parts"))
    both = clustered.join(total, "component")
    return both.select("chunk", "row", "node", "component", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("block"))


SET = "component long, parts int, block int, node long, tokens binary"


def _sets_of(chunks: Chunks, blocked: DataFrame, text: str, width: int) -> DataFrame:
    """component, parts, block, node and sorted set of every clustered class."""
    kinds = pa.schema([("component", pa.int64()), ("parts", pa.int32()), ("block", pa.int32()), ("node", pa.int64()), ("tokens", pa.binary())])

    def finish(chunk, table, rows):
        out = {c: [] for c in kinds.names}
        for h, _, i in _picked(table, rows, text, width):
            for c in ("component", "parts", "block", "node"):
                out[c].append(rows[c][i])
            out["tokens"].append(h.tobytes())
        yield pa.RecordBatch.from_pydict(out, kinds)

    return resolved(chunks, [(packed_rows(blocked, PLACED), PLACED)], SET, finish)


def _opened_sets(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(nodes, sets, order) by rising node."""
    nodes = table.column("node").to_numpy()
    order = np.argsort(nodes, kind="stable")
    tokens = table.column("tokens").to_pylist()
    return nodes[order], [np.frombuffer(tokens[i], np.uint64) for i in order], order


LINKED = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("component", pa.int64()), ("parts", pa.int32()), ("block", pa.int32()), ("node", pa.int64()), ("tokens", pa.binary())])


def _centre(table: pa.Table) -> pa.Table:
    """The set of a block whose tokens most of its sets hold; which one it is costs time, not links."""
    nodes, sets, order = _opened_sets(table)
    tokens, inverse, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    begin = np.cumsum([0, *map(len, sets)])[:-1]
    best = order[int((np.add.reduceat(often[inverse].astype(float), begin) / [len(x) for x in sets]).argmax())]
    return table.select(["component", "parts", "block", "node", "tokens"]).slice(int(best), 1)


def _joined_blocks(sets: DataFrame, percent: int, block_tokens: int) -> DataFrame:
    """Links within each block and with its cluster's centre, then of what no link joins to the centre with all other blocks."""
    many = F.col("parts") > 1
    centres = sets.where(many & (F.col("block") == 0)).groupBy("component").applyInArrow(_centre, SET)
    copies = centres.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def within(table: pa.Table) -> pa.Table:
        out = {c: [] for c in LINKED.names}
        nodes, sets, order = _opened_sets(table)
        marked = table.column("centre").to_numpy(zero_copy_only=False)[order].astype(bool)
        edges = forest(nodes, sets, percent) if len(nodes) > 1 else []
        if table.column("parts")[0].as_py() > 1:
            up = {n: n for n in nodes.tolist()}

            def root(x):
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            for a, b in edges:
                up[root(a)] = root(b)
            top = root(int(nodes[np.flatnonzero(marked)[0]]))
            facts = {c: table.column(c)[0].as_py() for c in ("component", "parts", "block")}
            for i, n in enumerate(nodes.tolist()):
                if not marked[i] and root(n) != top:
                    for c, x in {"u": None, "v": None, **facts, "node": n, "tokens": sets[i].tobytes()}.items():
                        out[c].append(x)
        for c, x in zip(("u", "v"), zip(*edges, strict=True) if edges else ((), ()), strict=True):
            out[c] = list(x) + out[c]
        for c in LINKED.names[2:]:
            out[c] = [None] * len(edges) + out[c]
        return pa.Table.from_pydict(out, LINKED)

    no = F.lit(False).alias("centre")
    first = materialize(
        sets.select("*", no).unionByName(copies.withColumn("centre", F.lit(True))).groupBy("component", "block").applyInArrow(within, "u long, v long, " + SET)
    )
    links = first.where("u is not null").select("u", "v")
    apart = first.where("node is not null").drop("u", "v")
    # The sets apart against all of their cluster, which is cut into blocks of ``block_tokens`` tokens, or into
    # finer ones as long as the copies of the sets apart, one for each, don't outweigh the cluster ``COPIES`` times.
    tokens = F.sum(F.length("tokens")) / F.lit(8)
    blocks = lambda of: F.ceil(of / F.lit(block_tokens)).cast("int")
    some = materialize(apart.groupBy("component").agg(tokens.alias("few")))
    if some.isEmpty():
        return links
    total = sets.join(some.select("component"), "component", "left_semi").groupBy("component").agg(tokens.alias("all"), F.max("parts").alias("parts"))
    finer = F.least(F.col("parts"), F.ceil(F.lit(COPIES) * F.col("all") / F.col("few"))).cast("int")
    needed = materialize(total.join(some, "component").select("component", F.greatest(blocks(F.col("all")), finer).alias("wide"), blocks(F.col("few")).alias("rounds")))
    spent(some)
    by = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    theirs = apart.join(needed, "component").withColumn("round", by(7, "rounds")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)))
    ours = sets.join(needed, "component").withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1))).withColumn("at", by(9, "wide"))
    pair = lambda df, side: df.select("component", "at", "round", "node", "tokens", F.lit(side).alias("side"))
    kinds = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def across(table: pa.Table) -> pa.Table:
        nodes, sets, order = _opened_sets(table)
        side = table.column("side").to_numpy()[order]
        edges = forest(nodes, sets, percent, side) if side.any() and not side.all() else []
        return pa.Table.from_pydict({"u": [e[0] for e in edges], "v": [e[1] for e in edges]}, kinds)

    return links.union(pair(ours, 0).unionByName(pair(theirs, 1)).groupBy("component", "at", "round").applyInArrow(across, "u long, v long"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """key, n_shingles, component_id."""
    rows, links = similarity_links(docs, key, text, width, percent, block_tokens)
    found = components(links)
    out = rows.select("doc", "n", "class").join(found.withColumnRenamed("node", "class"), "class", "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "class").alias("component_id"))


def oracle(percent: int = PERCENT) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({lower}, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda p: array_to_string(ws[p:p + 2], ' '))) END AS g FROM d
), t AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
), r AS (
  SELECT x FROM t GROUP BY x HAVING count(*) > 1
), c AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS i
  FROM t a JOIN r USING (x) JOIN t b USING (x)
  WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY ALL
), l AS (
  SELECT u, v FROM c WHERE 100 * i >= {percent} * (nu + nv - i)
), e AS (
  SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM s
  UNION
  SELECT e.v, reach.root FROM reach JOIN e ON e.u = reach.node WHERE reach.root < e.v
)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id
FROM s JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) ON node = s.doc_id
"""
