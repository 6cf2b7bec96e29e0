"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The reference is every document with a smaller id. It is cut into passages by anchors: the anchor
of a window of ``span`` words is its smallest hash of ``K`` consecutive words, and the windows in
a row that share one make a passage of at most ``2 * span - K`` words. Equal windows have equal
anchors, so the passages of one anchor are all the text that a factor in any of them can come
from. A reference block is a shard of anchors, with an index of the windows in its passages.

Each passage is parsed from left to right against its block: the window at the cursor is looked
up; if a smaller document holds it, the factor grows word by word along the reference's text as
far as both agree, and the cursor moves to the first window the factor does not cover; else the
cursor moves on by one. So every window is covered by a factor or was looked up, across the ends
of factors as well, and what the factors cover is what is removed. Factors that go on in step in
the next passage are joined into one.

A first exchange finds the anchors that two documents share; passages under others meet nothing.
Each chunk of documents sends a passage once, for the smallest document that holds it: for its
other documents that one is the reference. A passage that a third of all documents hold thus weighs
no more than the number of chunks. At its ends each document goes on in its own words, though, so
the anchors there have many different passages: those of anchors with more than ``HOT`` are cut into
their single windows, which are dealt to blocks each by its own words.

Words are runs of what is not white space, unchanged, compared by 32-bit hashes, window by window,
under an equal 64-bit anchor. Null texts have no words; texts of fewer than ``span`` words lose
none. Rows without an id neither serve as reference nor lose words; repeated rows of one id are the
same document. An empty table gives an empty result; other columns are not read, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import words as W
from inkwell.llm.common import id_text, materialize, slices, utf8
from inkwell.llm.exchange import chunked, replied, rescattered, resolved, scattered

SPAN, K = 13, 6
HOT = 32
MULTIPLIERS = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _ids(table: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column(key).combine_chunks()
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)


def _parsed(column: pa.ChunkedArray):
    """For ranges of rows: (first row, rows, bytes, offsets, word starts, word ends, row of each word, word hashes)."""
    offsets, data = utf8(column)
    for a, b in slices(offsets):
        off, d = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        s, e, row = W.word_spans(d, off, W.NOT_SPACE)
        yield a, b - a, d, off, s, e, row, W.span_hashes(d, s, e)


def _anchors(h: np.ndarray, row: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of whole windows, place of each one's anchor, hashes of k words)."""
    n = len(h) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    g = W.grams(h, k, 3)
    at = W.window_minima(g, span - k + 1)
    inside = np.flatnonzero(row[:n] == row[span - 1 :])
    return inside, at[inside], g


def _in(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted array."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """First index of each run of equal rows."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def passages(h: np.ndarray, row: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first word, words) of the passages of consecutive texts."""
    starts, at, g = _anchors(h, row, span, k)
    first = _runs(at)
    last = np.append(first[1:], len(at)) - 1
    begin = starts[first]
    return g[at[first]], begin, starts[last[: len(first)]] + span - begin


def _cut_hot(h: np.ndarray, anchor: np.ndarray, begin: np.ndarray, size: np.ndarray, hot: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages with those under hot anchors as their single windows, each keyed by its words."""
    on = _in(anchor, hot)
    many = size[on] - span + 1
    at = np.repeat(begin[on], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    key = np.repeat(anchor[on], many)
    for j in range(span):
        key = key * MULTIPLIERS[200] + h[at + j]
    return np.concatenate([anchor[~on], W.mix(key)]), np.concatenate([begin[~on], at]), np.concatenate([size[~on], np.full(len(at), span)])


def _words_of(h: np.ndarray, begin: np.ndarray, size: np.ndarray, wide: int) -> np.ndarray:
    """Hashes of each passage's words, zeros beyond its end."""
    place = np.minimum(begin[:, None] + np.arange(wide), max(len(h) - 1, 0))
    out = (h[place] >> np.uint64(32)).astype(np.uint32) if len(begin) else np.empty((0, wide), np.uint32)
    out[np.arange(wide) >= size[:, None]] = 0
    return out


def _same(words: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of whole passages."""
    q = MULTIPLIERS[: words.shape[1]]
    one = (words * q).sum(1, dtype=np.uint64) + anchor
    two = (words * MULTIPLIERS[100 : 100 + words.shape[1]]).sum(1, dtype=np.uint64)
    return W.mix(one), W.mix(two + size.astype(np.uint64))


ANCHOR = {"low": np.int64, "high": np.int64, "times": np.int32}
SHARED = {"keys": np.uint64, "hot": np.uint8}
FACTOR = {"doc": np.int64, "place": np.int32, "offset": np.uint8, "length": np.uint8, "ref": np.int64, "ref_at": np.int32}


def _passage_kinds(wide: int) -> dict:
    return {"doc": np.int64, "place": np.int32, "size": np.uint8, "words": np.dtype((np.uint32, (wide,)))}


def shared_anchors(got: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Anchors that two documents hold, back to every chunk that holds them, and whether they have many passages."""
    order = np.argsort(got["keys"], kind="stable")
    keys = got["keys"][order]
    first = _runs(keys)
    twice = np.minimum.reduceat(got["low"][order], first) < np.maximum.reduceat(got["high"][order], first)
    hot = np.add.reduceat(got["times"][order].astype(np.int64), first) > HOT
    size = np.diff(np.append(first, len(keys)))
    on = np.repeat(twice, size)
    return {"chunk": got["chunk"][order][on], "keys": keys[on], "hot": np.repeat(hot, size)[on].astype(np.uint8)}


def parsed(got: dict[str, np.ndarray], span: int) -> dict[str, np.ndarray]:
    """A reference block: all its passages, each parsed against those of smaller documents."""
    order = np.lexsort((got["place"], got["doc"], got["keys"]))
    anchor, doc, place, size, words = (got[c][order] for c in ("keys", "doc", "place", "size", "words"))
    size = size.astype(np.int64)
    wide = words.shape[1]
    # The index: first holder of every window, by a hash of its words.
    key, entry, offset = [], [], []
    for j in range(wide - span + 1):
        on = np.flatnonzero(size >= j + span)
        key.append(W.mix((words[on, j : j + span] * MULTIPLIERS[:span]).sum(1, dtype=np.uint64) + anchor[on]))
        entry.append(on)
        offset.append(np.full(len(on), j))
    key, entry, offset = (np.concatenate(x) for x in (key, entry, offset))
    by = np.lexsort((offset, entry, key))  # entries are in order of anchor and document
    first = _runs(key[by])
    index, holder, held_at = key[by][first], entry[by][first], offset[by][first]
    asked = {(j): (entry[offset == j], key[offset == j]) for j in range(wide - span + 1)}
    cursor = np.zeros(len(doc), np.int64)
    out = {c: [] for c in ("entry", "offset", "length", "ref", "ref_at")}
    for j, (e, k) in asked.items():
        here = cursor[e] == j
        e, k = e[here], k[here]
        cursor[e] = j + 1
        at = np.searchsorted(index, k)  # every window is in the index
        ref, ref_from = holder[at], held_at[at]
        smaller = doc[ref] < doc[e]
        e, ref, ref_from = e[smaller], ref[smaller], ref_from[smaller]
        # The factor grows along the reference's words while both go on and agree.
        length, grows = np.zeros(len(e), np.int64), np.ones(len(e), bool)
        for t in range(wide - j):
            grows &= (j + t < size[e]) & (ref_from + t < size[ref])
            grows[grows] = words[e[grows], j + t] == words[ref[grows], ref_from[grows] + t]
            length += grows
        whole = length >= span
        e, ref, ref_from, length = e[whole], ref[whole], ref_from[whole], length[whole]
        cursor[e] = j + length - span + 1
        for c, x in zip(out, (e, np.full(len(e), j), length, doc[ref], place[ref] + ref_from), strict=True):
            out[c].append(x)
    e, *rest = (np.concatenate(x) for x in out.values())
    return {"chunk": got["chunk"][order][e], "doc": doc[e], "place": place[e], **{c: x.astype(FACTOR[c]) for c, x in zip(("offset", "length", "ref", "ref_at"), rest, strict=True)}}


def _joined_factors(start, length, ref, ref_at, row) -> list[np.ndarray]:
    """Factors that go on in step in the same reference as one: (start, length, ref, ref_at, row)."""
    order = np.lexsort((start, start - ref_at, ref, row))
    start, length, ref, ref_at, row = (x[order] for x in (start, length, ref, ref_at, row))
    end = start + length
    # Within one row, reference and step, ends rise with starts: a factor that begins by then goes on.
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | (ref[1:] != ref[:-1]) | ((start - ref_at)[1:] != (start - ref_at)[:-1]) | (start[1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return [start[first], end[last[: len(first)]] - start[first], ref[first], ref_at[first], row[first]]


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, k: int = K, report: bool = True) -> DataFrame:
    """key, n_words, n_removed, kept (words joined by one space) and, with ``report``, factors (start, length, reference document and start)."""
    src = id_text(docs, key, text)
    chunks = chunked(src, text)
    wide = 2 * span - k
    kinds = _passage_kinds(wide)

    def send_anchors(chunk, table):
        doc, known = _ids(table, key)
        keys, docs_of, ends = [], [], []
        for a, _, _, _, _, _, row, h in _parsed(table.column(text)):
            anchor, begin, size = passages(h, row, span, k)
            on = known[row[begin] + a]
            keys.append(anchor[on])
            docs_of.append(doc[row[begin] + a][on])
            ends.append((h[begin] * MULTIPLIERS[0] + h[begin + size - 1])[on])  # passages differ mostly at their ends
        if not sum(map(len, keys)):
            return np.empty(0, np.uint64), {}
        keys, d, ends = np.concatenate(keys), np.concatenate(docs_of), np.concatenate(ends)
        order = np.lexsort((ends, keys))
        keys, d, ends = keys[order], d[order], ends[order]
        first, other = _runs(keys), np.zeros(len(keys), np.int32)
        other[_runs(keys, ends)] = 1
        return keys[first], {"low": np.minimum.reduceat(d, first), "high": np.maximum.reduceat(d, first), "times": np.add.reduceat(other, first).astype(np.int32)}

    def grouped(table, anchors):
        """For ranges of rows: what _parsed yields, and of its passages under shared anchors (anchor, first word,
        words, hashes, document, place); then all passages of the chunk in groups of equal ones, smallest document first."""
        doc, known = _ids(table, key)
        hot, anchors = np.sort(anchors["keys"][anchors["hot"] > 0]), np.sort(anchors["keys"])
        ranges, parts = [], []
        for n, part in enumerate(_parsed(table.column(text))):
            a, row, h = part[0], part[6], part[7]
            anchor, begin, size = passages(h, row, span, k)
            on = _in(anchor, anchors) & known[row[begin] + a]
            anchor, begin, size = _cut_hot(h, anchor[on], begin[on], size[on], hot, span)
            words = _words_of(h, begin, size, wide)
            place = begin - np.searchsorted(row, row[begin])
            ranges.append(part)
            parts.append((anchor, words, size, doc[row[begin] + a], place, np.full(len(begin), n), begin, *_same(words, size, anchor)))
        if not parts:
            return ranges, None
        anchor, words, size, d, place, n, begin, h1, h2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((n, place, d, h2, h1))
        first = _runs(h1[order], h2[order])
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        return ranges, (anchor[order], words[order], size[order], d[order], place[order], n[order], begin[order], first, group)

    def send_passages(chunk, table, got):
        _, all_ = grouped(table, got)
        if all_ is None:
            return np.empty(0, np.uint64), {}
        anchor, words, size, d, place, _, _, first, _ = all_
        return anchor[first], {"doc": d[first], "place": place[first].astype(np.int32), "size": size[first].astype(np.uint8), "words": words[first]}

    def finish(chunk, table, got, factors):
        ranges, all_ = grouped(table, got)
        found = [[] for _ in ranges]
        if all_ is not None:
            anchor, words, size, d, place, n, begin, first, group = all_
            # Passages of documents after the smallest of their group: that one is the reference for all of their words.
            later = d > d[first][group]
            copy = (n[later], begin[later], size[later], d[first][group][later], place[first][group][later])
            # Passages of the smallest document: the factors found in the block.
            code = lambda doc, at: doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)
            own = np.flatnonzero(~later)
            mine = code(d[first][group][own], place[first][group][own])
            by = np.argsort(code(factors["doc"], factors["place"]), kind="stable")
            told = code(factors["doc"], factors["place"])[by]
            x, y = np.searchsorted(told, mine, "left"), np.searchsorted(told, mine, "right")
            rep = np.repeat(own, y - x)
            f = by[np.repeat(x - (np.cumsum(y - x) - (y - x)), y - x) + np.arange(int((y - x).sum()))] if len(rep) else np.empty(0, np.int64)
            # Two documents' codes may be equal: the factor must be of this very document and place.
            true = (factors["doc"][f] == d[rep]) & (factors["place"][f] == place[first][group][rep])
            rep, f = rep[true], f[true]
            parse = (n[rep], begin[rep] + factors["offset"][f], factors["length"][f].astype(np.int64), factors["ref"][f], factors["ref_at"][f].astype(np.int64))
            for i in range(len(ranges)):
                found[i] = [np.concatenate([c[1:][q][c[0] == i] for c in (copy, parse)]) for q in range(4)]
        out = {"n_words": [], "n_removed": [], "kept": [], "factors": []}
        for (_, rows, text_bytes, off, s, e, row, h), hits in zip(ranges, found, strict=True):
            edge = np.zeros(len(h) + 1, np.int64)
            if hits:
                np.add.at(edge, hits[0], 1)
                np.add.at(edge, hits[0] + hits[1], -1)
            gone = np.cumsum(edge)[:-1] > 0
            out["n_words"].append(np.bincount(row, minlength=rows))
            out["n_removed"].append(np.bincount(row[gone], minlength=rows))
            out["kept"].append(_joined(text_bytes, off, s, e, row, ~gone))
            if report:
                lists: list[list[dict]] = [[] for _ in range(rows)]
                if hits:
                    start, m, ref, at, r = _joined_factors(*hits, row[hits[0]])
                    begin_of = np.searchsorted(row, np.arange(rows))
                    for x in zip(r.tolist(), (start - begin_of[r]).tolist(), m.tolist(), ref.tolist(), at.tolist(), strict=True):
                        lists[x[0]].append(dict(zip(("start", "length", "ref_doc", "ref_start"), x[1:], strict=True)))
                out["factors"] += [sorted(x, key=lambda f: f["start"]) for x in lists]
        numbers = {c: pa.array(np.concatenate(out[c]).astype(np.int64)) for c in ("n_words", "n_removed")}
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())]))
        extra = {"factors": pa.array(out["factors"], kind)} if report else {}
        result = pa.table({key: table.column(key), **numbers, "kept": pa.chunked_array(out["kept"]), **extra})
        yield from result.combine_chunks().to_batches()

    # Each round's replies are written, which frees the files of its exchanges.
    anchors = materialize(replied(scattered(chunks, ANCHOR, send_anchors), ANCHOR, SHARED, shared_anchors))
    factors = materialize(replied(rescattered(chunks, [(anchors, SHARED)], kinds, send_passages), kinds, FACTOR, lambda got: parsed(got, span)))
    schema = f"`{key}` long, n_words long, n_removed long, kept string" + (", factors array<struct<start:bigint,length:bigint,ref_doc:bigint,ref_start:bigint>>" if report else "")
    return resolved(chunks, [(anchors, SHARED), (factors, FACTOR)], schema, finish)


def _joined(d: np.ndarray, off: np.ndarray, s: np.ndarray, e: np.ndarray, row: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Kept words of each text, joined by one space."""
    edge = np.zeros(len(d) + 1, np.int64)
    np.add.at(edge, s[keep], 1)
    np.add.at(edge, e[keep], -1)
    mask = np.cumsum(edge)[:-1] > 0
    kept = np.flatnonzero(keep)
    follow = kept[:-1][row[kept[:-1]] == row[kept[1:]]]  # words with a kept word after them
    d = d.copy()
    d[e[follow]] = 32
    mask[e[follow]] = True
    offsets = np.concatenate([[0], np.cumsum(mask)])[off]
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(d[mask])]).cast(pa.string())


def digest_query(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs, report=False).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def oracle(span: int = SPAN) -> str:
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), w AS (
  SELECT rid, doc_id, p, array_to_string(ws[p:p + {span - 1}], ' ') AS win
  FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - {span - 2})) AS p FROM d WHERE len(ws) >= {span})
), o AS (
  SELECT win, min(doc_id) AS owner FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT DISTINCT rid, unnest(range(p, p + {span})) AS i FROM w JOIN o USING (win) WHERE owner < doc_id
), k AS (
  SELECT rid, ws[i] AS word, i, c.i IS NOT NULL AS gone
  FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) x LEFT JOIN c USING (rid, i)
), t AS (
  SELECT rid, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (rid)
"""
