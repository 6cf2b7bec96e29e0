"""Benchmark decontamination by winnowing.

Both sides hash every k consecutive words and keep the smallest hash of each sliding window of
``span - k + 1`` of them, so that any shared run of ``span`` words shares a kept fingerprint at
the same place of the run. Training fingerprints are joined to those of the test items; each hit
is extended to the windows of ``span`` words that chose it, and these are compared by two
further 64-bit hashes. Items of fewer than ``span`` words are one window of all their words,
for which every run of that length is a fingerprint.

A test set of at most ``index_bytes`` of text, which is counted first, is one index that is sent to all
executors; documents are read once and never shuffled. A larger one is dealt to shards: its
fingerprints and its windows are published as sorted arrays; chunks of documents join their distinct
fingerprints to the first, and the windows that chose those found to the second, so neither side is
held whole anywhere. Words: ASCII letters lower-cased, runs of letters, digits and all that is not ASCII.

Null and empty texts have no words and no hits. Items without words or with null text match
nothing; an item without an id marks hits but is not listed; repeated items count once. Each
document row gives one row. With no items, nothing is contaminated; no documents give no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import words as W
from inkwell.llm.common import fresh, id_text, materialize, slices, spent, utf8
from inkwell.llm.exchange import chunked, probed, published, rescattered, resolved, scattered

K = 5


def _at(h: np.ndarray, starts: np.ndarray, k: int, salt: int) -> np.ndarray:
    """grams(h, k, salt) at some starts only."""
    if not len(starts):
        return np.empty(0, np.uint64)
    return W.grams(h[(starts[:, None] + np.arange(k)).ravel()], k, salt)[:: k]


@dataclass
class _Table:
    """Windows of one length: kept fingerprints, and window hashes with the items that hold them."""

    length: int
    prints: np.ndarray
    seen: np.ndarray
    keys: np.ndarray
    check: np.ndarray
    first: np.ndarray
    items: np.ndarray

    def hits(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window number) of every window of the texts that the table holds."""
        n, m = len(h) - self.length + 1, self.length
        none = np.empty(0, np.int64)
        if n <= 0:
            return none, none
        inside = row[:n] == row[m - 1 :]
        chosen, prints = _chosen(h, m)
        mask = np.uint64(len(self.seen) - 1)
        # Neighbouring windows mostly choose the same fingerprint: it is looked up once.
        new = np.concatenate([[True], chosen[1:] != chosen[:-1]])
        places = chosen[new]
        likely = self.seen[(prints[places] & mask).astype(np.int64)]
        idx = np.flatnonzero(likely)
        at = np.minimum(np.searchsorted(self.prints, prints[places[idx]]), len(self.prints) - 1)
        found = np.zeros(len(places), bool)
        found[idx] = self.prints[at] == prints[places[idx]]
        if not found.any():
            return none, none
        starts = np.flatnonzero(found[np.cumsum(new) - 1] & inside)
        key = _at(h, starts, m, 1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[at] == key
        starts, at = starts[same], at[same]
        same = self.check[at] == _at(h, starts, m, 2)
        return starts[same], at[same]


def _chosen(h: np.ndarray, m: int, span_k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Place of the fingerprint that each window of m words keeps, and all fingerprints."""
    k = min(span_k, m) if m >= 2 * span_k else m
    g = W.grams(h, k, 0)
    return W.window_minima(g, m - k + 1), g


class Index:
    """All windows of one block of items, by length; plain arrays, to be broadcast."""

    def __init__(self, rows: list[tuple[int | None, str | None]], span: int = 10):
        offsets, data = utf8(pa.array([t for _, t in rows], pa.string()))
        s, e, row = W.word_spans(data, offsets, W.ALNUM)
        h = W.span_hashes(data, s, e, W.LOWER_CODES)
        size = np.bincount(row, minlength=len(rows))
        self.ids = [i for i, _ in rows]
        self.tables: list[_Table] = []
        begin = np.concatenate([[0], np.cumsum(size)])
        for m in sorted({min(int(n), span) for n in size if n}):
            parts = []
            for i in np.flatnonzero((size == m) if m < span else (size >= span)):
                x = h[begin[i] : begin[i + 1]]
                chosen, g = _chosen(x, m)
                parts.append((g[chosen], W.grams(x, m, 1), W.grams(x, m, 2), np.full(len(chosen), i)))
            prints, key, check, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            # Equal windows are one entry with the list of their items.
            order = np.lexsort((item, check, key))
            key, check, item = key[order], check[order], item[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
            prints = np.unique(prints)
            seen = np.zeros(1 << max(10, int(64 * len(prints)).bit_length()), bool)
            seen[(prints & np.uint64(len(seen) - 1)).astype(np.int64)] = True
            first = np.append(np.flatnonzero(new), len(item))
            self.tables.append(_Table(m, prints, seen, key[new], check[new], first, item))

    def scan(self, h: np.ndarray, row: np.ndarray):
        for t in self.tables:
            starts, window = t.hits(h, row)
            if len(starts):
                yield t, starts, window


class _Hits:
    """What is found in the texts of a range of rows."""

    def __init__(self, row: np.ndarray, rows: int):
        self.row, self.rows = row, rows
        self.edge = np.zeros(len(row) + 1, np.int64)
        self.ids: list[set] = [set() for _ in range(rows)]

    def add(self, starts: np.ndarray, length: int) -> None:
        np.add.at(self.edge, starts, 1)
        np.add.at(self.edge, starts + length, -1)

    def result(self) -> tuple[list[int], list[list[dict]], list[list[str]]]:
        """Of each text: words, hit spans in words (joined, end exclusive), ids of items found as text, sorted."""
        row, hit = self.row, np.cumsum(self.edge)[:-1] > 0
        size = np.bincount(row, minlength=self.rows)
        begin = np.concatenate([[0], np.cumsum(size)])
        same = row[1:] == row[:-1]
        starts = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & same])) if len(hit) else np.empty(0, np.int64)
        stops = np.flatnonzero(hit & ~np.concatenate([hit[1:] & same, [False]])) + 1 if len(hit) else starts
        own: list[list[dict]] = [[] for _ in range(self.rows)]
        for x, y in zip(starts, stops, strict=True):
            r = row[x]
            own[r].append({"start": int(x - begin[r]), "end": int(y - begin[r])})
        return size.tolist(), own, [sorted(str(i) for i in x if i is not None) for x in self.ids]


def _words(column):
    """For ranges of rows: (first row, rows, row of each word, word hashes)."""
    offsets, data = utf8(column)
    for a, b in slices(offsets):
        off, d = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        s, e, row = W.word_spans(d, off, W.ALNUM)
        yield a, b - a, row, W.span_hashes(d, s, e, W.LOWER_CODES)


def scan_texts(column: pa.Array, index: Index) -> list[tuple]:
    """Results of ranges of rows, given the whole index."""
    out = []
    for _, rows, row, h in _words(column):
        hits = _Hits(row, rows)
        for t, starts, window in index.scan(h, row):
            hits.add(starts, t.length)
            for r, w in np.unique(np.stack([row[starts], window], 1), axis=0):
                hits.ids[r].update(index.ids[i] for i in t.items[t.first[w] : t.first[w + 1]])
        out.append(hits.result())
    return out


# A test set in shards

PRINTS = {"keys": np.uint64}
WINDOW = {"check": np.uint64}
ITEM = {"check": np.uint64, "item": np.int64, "known": np.uint8}
FOUND = {"keys": np.uint64, **ITEM}
LISTS = {"keys": np.uint64, **ITEM}


def _tagged(keys: np.ndarray, m: int) -> np.ndarray:
    return W.mix(keys + np.uint64(m))


def _windows(h: np.ndarray, starts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    return _tagged(_at(h, starts, m, 1), m), _at(h, starts, m, 2)


def _inside(row: np.ndarray, m: int) -> np.ndarray:
    n = max(0, len(row) - m + 1)
    return row[:n] == row[m - 1 : m - 1 + n]


def _each_item(table: pa.Table, span: int):
    """(id or None, its words' hashes, window length) of every item with words."""
    ids = table.column("item").to_pylist()
    for a, rows, row, h in _words(table.column("text")):
        begin = np.searchsorted(row, np.arange(rows + 1))
        for i in range(rows):
            x = h[begin[i] : begin[i + 1]]
            if len(x):
                yield ids[a + i], x, min(len(x), span)


def _none() -> tuple[np.ndarray, dict]:
    return np.empty(0, np.uint64), {}


def _sharded(src: DataFrame, whole: str, items: DataFrame, span: int, schema: str, finish) -> DataFrame:
    """Documents against a test set that is dealt to shards."""
    tests, chunks = chunked(items), chunked(src, whole)
    n = max(tests.shards, chunks.shards)
    tests, chunks = type(tests)(tests.df, tests.tasks, n), type(chunks)(chunks.df, chunks.tasks, n)

    def lengths(batches):
        for b in batches:
            found = {m for blob in b.column("blob") for _, _, m in _each_item(pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks(), span)}
            yield pa.RecordBatch.from_pydict({"m": sorted(found)}, pa.schema([("m", pa.int32())]))

    sizes = sorted(r.m for r in tests.df.select("blob").mapInArrow(lengths, "m int").distinct().collect())  # ``span`` at most

    def item_prints(chunk, table):
        keys = [_tagged(g[chosen], m) for _, x, m in _each_item(table, span) for chosen, g in [_chosen(x, m)]]
        return (np.unique(np.concatenate(keys)), {}) if keys else _none()

    def item_windows(chunk, table):
        keys, check, item, known = [], [], [], []
        for i, x, m in _each_item(table, span):
            k, c = _windows(x, np.arange(len(x) - m + 1), m)
            keys.append(k)
            check.append(c)
            item.append(np.full(len(k), i if i is not None else 0))
            known.append(np.full(len(k), i is not None, np.uint8))
        return (np.concatenate(keys), {"check": np.concatenate(check), "item": np.concatenate(item), "known": np.concatenate(known)}) if keys else _none()

    def doc_prints(chunk, table):
        keys = []
        for _, _, row, h in _words(table.column(whole)):
            for m in sizes:
                chosen, g = _chosen(h, m) if len(h) >= m else (np.empty(0, np.int64), np.empty(0, np.uint64))
                keys.append(_tagged(g[np.unique(chosen[_inside(row, m)])], m))
        return (np.unique(np.concatenate(keys)), {}) if keys else _none()

    def likely(table, prints):
        """(range, window length, starts) of the windows whose fingerprint the test set has."""
        known = np.sort(prints)
        for part in _words(table.column(whole)):
            row, h = part[2], part[3]
            for m in sizes if len(known) else ():
                if len(h) < m:
                    continue
                chosen, g = _chosen(h, m)
                key = _tagged(g, m)
                on = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                yield part, m, np.flatnonzero(on[chosen] & _inside(row, m))

    def doc_windows(chunk, table, prints):
        parts = [_windows(part[3], starts, m) for part, m, starts in likely(table, prints["keys"])]
        if not parts:
            return _none()
        keys, check = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((check, keys))
        keys, check = keys[order], check[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (check[1:] != check[:-1])]) if len(keys) else np.empty(0, bool)
        return keys[new], {"check": check[new]}

    def lists(got):
        """Windows in order, each once for each of its items."""
        rows = np.unique(np.rec.fromarrays([got["keys"], got["check"], got["known"], got["item"]], names="keys,check,known,item"))
        return {c: np.ascontiguousarray(rows[c]) for c in LISTS}

    def seen(index, probes):
        at = np.minimum(np.searchsorted(index["keys"], probes["keys"]), len(index["keys"]) - 1)
        on = index["keys"][at] == probes["keys"]
        return {"chunk": probes["chunk"][on], "keys": probes["keys"][on]}

    def listed(index, probes):
        x, y = np.searchsorted(index["keys"], probes["keys"], "left"), np.searchsorted(index["keys"], probes["keys"], "right")
        rep = np.repeat(np.arange(len(x)), y - x)
        at = np.repeat(x - (np.cumsum(y - x) - (y - x)), y - x) + np.arange(len(rep))
        same = index["check"][at] == probes["check"][rep]
        rep, at = rep[same], at[same]
        return {"chunk": probes["chunk"][rep], **{c: index[c][at] for c in LISTS}}

    distinct = lambda keys, columns: (np.unique(keys), columns)
    prints = published(scattered(tests, {}, item_prints, distinct), {}, PRINTS, lambda got: {"keys": np.unique(got["keys"])})
    met = materialize(probed(chunks, prints, PRINTS, scattered(chunks, {}, doc_prints), {}, PRINTS, seen))
    spent(prints)
    index = published(scattered(tests, ITEM, item_windows), ITEM, LISTS, lists)
    found = materialize(probed(chunks, index, LISTS, rescattered(chunks, [(met, PRINTS)], WINDOW, doc_windows), WINDOW, FOUND, listed))
    spent(index, tests.df)

    def done(chunk, table, prints, got):
        order = np.lexsort((got["check"], got["keys"]))
        keys, check, item, known = (got[c][order] for c in FOUND)
        hits = {part[0]: _Hits(part[2], part[1]) for part in _words(table.column(whole))}
        for part, m, starts in likely(table, prints["keys"]):
            k, c = _windows(part[3], starts, m)
            x, y = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            for s, t, i, j in zip(starts.tolist(), c.tolist(), x.tolist(), y.tolist(), strict=True):
                on = [q for q in range(i, j) if check[q] == t]
                if on:
                    hits[part[0]].add(np.array([s]), m)
                    hits[part[0]].ids[part[2][s]].update(int(item[q]) for q in on if known[q])
        yield from finish(table, [h.result() for h in hits.values()])

    return resolved(chunks, [(met, PRINTS), (found, FOUND)], schema, done)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), span: int = 10, index_bytes: int = 32 << 20) -> DataFrame:
    """key, carried columns, n_words, spans (array of start and end words), items (array of ids as text, sorted).

    The last three get underscores where carried columns have their names.
    """
    names = [key, *carry]
    whole, *made = (fresh(c, names) for c in ("text", "n_words", "spans", "items"))
    src = docs.select(*names, F.col(text).cast("string").alias(whole))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*names).schema)
    schema = f"{fields}, `{made[0]}` long, `{made[1]}` array<struct<start:bigint,end:bigint>>, `{made[2]}` array<string>"

    def finish(table, results):
        n, spans, found = ([x for r in results for x in r[i]] for i in range(3))
        arrays = [*(table.column(c) for c in names), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(found, pa.list_(pa.string()))]
        yield from pa.Table.from_arrays(arrays, [*names, *made]).combine_chunks().to_batches()

    tests = id_text(items, "item_id", "text").where(F.col("text").isNotNull()).withColumnRenamed("item_id", "item")
    if (tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > index_bytes:
        return _sharded(src, whole, tests, span, schema, finish)
    held = docs.sparkSession.sparkContext.broadcast(Index([(r[0], r[1]) for r in tests.collect()], span))

    def run(batches):
        for b in batches:
            yield from finish(b, scan_texts(b.column(whole), held.value))

    return src.mapInArrow(run, schema)


def digest_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    out = contamination(id_text(docs), items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def oracle(span: int = 10) -> str:
    """The contract in DuckDB SQL."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce({words}, []) AS ws FROM documents
), b AS (
  SELECT item_id, {words} AS ws FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), {span}) AS m, array_to_string(ws[p:p + least(len(ws), {span}) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {span - 1}, 1) + 1)) AS p FROM b WHERE len(ws) > 0)
), ms AS (SELECT DISTINCT m FROM bw
), dw AS (
  SELECT rid, p, m, array_to_string(ws[p:p + m - 1], ' ') AS win
  FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, ms WHERE len(ws) >= m)
), hits AS (
  SELECT dw.rid, dw.p, dw.m, bw.item_id FROM dw JOIN bw USING (m, win)
), covered AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM hits) GROUP BY rid
), found AS (
  SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""


def brute_force(text: str | None, items: list[tuple[object, str | None]], span: int = 10) -> tuple[int, int, list[str], str]:
    """(words, hit words, ids, digest) by comparing every window, for tests."""
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, found = cut(text), set(), set()
    for i, t in items:
        x = cut(t)
        m = min(len(x), span)
        for p in range(len(x) - m + 1 if m else 0):
            for q in range(len(ws) - m + 1):
                if ws[q : q + m] == x[p : p + m]:
                    hit.update(range(q, q + m))
                    found.add(i)
    ids = sorted(str(i) for i in found if i is not None)
    return len(ws), len(hit), ids, hashlib.sha256(",".join(ids).encode()).hexdigest()
