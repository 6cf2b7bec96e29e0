"""Line dedup over a sharded minimal perfect hash.

Each task sends its distinct line keys, as two 64-bit hashes with the smallest and largest
document id, to the shard of the first hash. A shard keeps the keys of at least two documents,
builds a minimal perfect hash over them, and publishes arrays at its slots: fingerprint (the second
hash), count, and owner (the smallest document). That index is written; it is all that later steps
know of other documents' lines. Every chunk of documents then probes the arrays with its own
distinct keys, dealt to shards: a slot whose fingerprint agrees gives the owner, and the chunk
drops the lines that another document owns. Lines themselves never move; a line that a third of
all documents hold is one key for each task, and one probe for each chunk.

A key is a line stripped of white space with ASCII letters lower-cased; keys of fewer than
``least`` code points never count. Null or empty texts are one empty line. Rows without a
document id neither own nor lose lines. Repeated rows of one id are the same document. An empty
table gives an empty result; columns of ``docs`` keep their names, the two new ones give way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import words as W
from inkwell.llm.common import fresh, id_text, slices, utf8
from inkwell.llm.exchange import chunked, probed, published, resolved, scattered

LEAST = 10
CODES2 = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
CODES2 = CODES2[W.LOWER]


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: levels of bits, each set where exactly one
    of the keys that reach the level falls; a key's slot is the number of bits set before its own."""

    def __init__(self, keys: np.ndarray, gamma: float = 2.0):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, left, level = len(keys), keys, 0
        base = 0
        while len(left):
            m = max(64, int(gamma * len(left)))
            at = self._at(left, level, m)
            bits = np.bincount(at, minlength=m) == 1
            self.levels.append((bits, base + np.cumsum(bits) - 1))
            base += int(bits.sum())
            left, level = left[~bits[at]], level + 1

    @classmethod
    def stored(cls, bits: np.ndarray, levels: np.ndarray) -> PerfectHash:
        """From the bits of all levels, packed, and how many each level has."""
        out = cls(np.empty(0, np.uint64))
        flat, base = np.unpackbits(bits, count=int(levels.sum())).astype(bool), 0
        for a, b in zip(np.cumsum(levels) - levels, np.cumsum(levels), strict=True):
            part = flat[a:b]
            out.levels.append((part, base + np.cumsum(part) - 1))
            base += int(part.sum())
        out.size = base
        return out

    @staticmethod
    def _at(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (W.mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) % np.uint64(m)).astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; some slot or -1 for keys outside the set."""
        out = np.full(len(keys), -1)
        left = np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            at = self._at(keys[left], level, len(bits))
            on = bits[at]
            out[left[on]] = rank[at[on]]
            left = left[~on]
        return out


def line_keys(data: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, whether it has a key, first hash, second hash) of each line."""
    breaks = np.flatnonzero(data == 10)
    row_end = offsets[1:]
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([row_end, breaks]), kind="stable")
    # Rows are in order and a line never passes its row's end, so sorted starts and ends pair up;
    # empty rows tie, and a tie pairs equal places.
    lines = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=len(offsets) - 1) + 1 if len(breaks) else np.ones(len(offsets) - 1, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), lines)
    solid = np.flatnonzero(W.NOT_SPACE[data])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    if len(solid):
        a = np.searchsorted(solid, starts)
        b = np.searchsorted(solid, ends) - 1
        bare = b >= a
        first = np.where(bare, solid[np.minimum(a, len(solid) - 1)], starts)
        last = np.where(bare, solid[np.maximum(b, 0)] + 1, starts)
    else:
        first, last = starts, starts
    keyed = points[last] - points[first] >= least
    h1, h2 = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    h1[keyed] = W.span_hashes(data, first[keyed], last[keyed], W.LOWER_CODES)
    h2[keyed] = W.span_hashes(data, first[keyed], last[keyed], CODES2)
    return starts, ends, row, keyed, h1, h2


def _all_keys(table: pa.Table, key: str, text: str):
    ids = table.column(key)
    known = ids.is_valid().to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    doc = ids.fill_null(0).to_numpy()
    offsets, data = utf8(table.column(text))
    for a, b in slices(offsets):
        s, e, row, keyed, h1, h2 = line_keys(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, s + offsets[a], e + offsets[a], row + a, keyed & known[row + a], h1, h2, doc


def _group(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each group) of equal pairs."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))


SENT = {"check": np.uint64, "low": np.int64, "high": np.int64, "times": np.int64}
PROBE = {"check": np.uint64}
BACK = {"keys": np.uint64, "check": np.uint64, "owner": np.int64}
#: A shard's index: bits of the perfect hash, bits in each level, arrays at its slots; then the keys
#: whose first hash another key has, which no perfect hash can tell apart.
INDEX = {"bits": np.uint8, "levels": np.int64, "prints": np.uint64, "counts": np.uint32, "owners": np.int64, "twin": np.uint64, "twin_print": np.uint64, "twin_owner": np.int64}


def merged(keys: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Equal keys of a task as one."""
    order, first = _group(keys, columns["check"])
    return keys[order][first], {
        "check": columns["check"][order][first], "low": np.minimum.reduceat(columns["low"][order], first), "high": np.maximum.reduceat(columns["high"][order], first),
        "times": np.add.reduceat(columns["times"][order], first),
    }


def index_of(got: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays of a shard, over its keys of two documents or more."""
    keys, c = merged(got["keys"], got)
    twice = c["low"] < c["high"]
    k1, k2, owner, count = keys[twice], c["check"][twice], c["low"][twice], c["times"][twice]
    lone = np.concatenate([[True], k1[1:] != k1[:-1]]) if len(k1) else np.empty(0, bool)
    mph = PerfectHash(k1[lone])
    at = mph.slot(k1[lone])
    prints, counts, owners = np.zeros(mph.size, np.uint64), np.zeros(mph.size, np.uint32), np.zeros(mph.size, np.int64)
    prints[at], counts[at], owners[at] = k2[lone], np.minimum(count[lone], 0xFFFFFFFF), owner[lone]
    levels = [bits for bits, _ in mph.levels]
    bits = np.packbits(np.concatenate(levels)) if levels else np.empty(0, np.uint8)
    return {"bits": bits, "levels": np.array([len(x) for x in levels], np.int64), "prints": prints, "counts": counts, "owners": owners, "twin": k1[~lone], "twin_print": k2[~lone], "twin_owner": owner[~lone]}


def answer(index: dict[str, np.ndarray], probes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Owners of the probed keys that the index holds."""
    h1, h2 = probes["keys"], probes["check"]
    mph = PerfectHash.stored(index["bits"], index["levels"])
    slot = mph.slot(h1)
    hit = slot >= 0
    hit[hit] = (index["prints"][slot[hit]] == h2[hit]) & (index["counts"][slot[hit]] > 1)
    owner = np.zeros(len(h1), np.int64)
    owner[hit] = index["owners"][slot[hit]]
    for a, b, o in zip(index["twin"], index["twin_print"], index["twin_owner"], strict=True):
        same = (h1 == a) & (h2 == b)
        hit |= same
        owner[same] = o
    return {"chunk": probes["chunk"][hit], "keys": h1[hit], "check": h2[hit], "owner": owner[hit]}


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text of kept lines, then n_lines and n_dropped (with underscores where these names are taken)."""
    names = docs.columns
    made = [fresh(c, names) for c in ("n_lines", "n_dropped")]
    if docs.schema[key].dataType.simpleString() != "bigint":
        docs = docs.withColumn(key, F.col(key).cast("long"))
    chunks = chunked(docs, text)

    def own(chunk, table):
        parts = []
        for *_, row, keyed, h1, h2, doc in _all_keys(table, key, text):
            parts.append((h1[keyed], h2[keyed], doc[row[keyed]]))
        h1, h2, doc = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))
        return merged(h1, {"check": h2, "low": doc, "high": doc, "times": np.ones(len(h1), np.int64)}) if len(h1) else (h1, {})

    def probe(chunk, table):
        keys, columns = own(chunk, table)
        return keys, {c: columns[c] for c in PROBE if len(keys)}

    def finish(chunk, table, got):
        order = np.argsort(got["keys"], kind="stable")
        k1, k2, owner = got["keys"][order], got["check"][order], got["owner"][order]
        texts = table.column(text).to_pylist()
        total, lost = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        offsets, data = utf8(table.column(text))
        for a, b, s, e, row, keyed, h1, h2, doc in _all_keys(table, key, text):
            total[a:b] = np.bincount(row - a, minlength=b - a)
            drop = np.zeros(len(row), bool)
            if len(k1):
                at = np.searchsorted(k1, h1)
                more = keyed.copy()
                while more.any():  # one round, unless two keys share a first hash
                    more &= at < len(k1)
                    here = np.minimum(at, len(k1) - 1)
                    more &= k1[here] == h1
                    drop |= more & (k2[here] == h2) & (owner[here] != doc[row])
                    more &= k2[here] != h2
                    at = at + 1
            lost[a:b] = np.bincount(row[drop] - a, minlength=b - a)
            for r in np.flatnonzero(lost[a:b]) + a:
                x, y = np.searchsorted(row, [r, r + 1])
                stay = np.flatnonzero(~drop[x:y]) + x
                texts[r] = b"\n".join(data[s[i] : e[i]].tobytes() for i in stay).decode()
        columns = {c: table.column(c) for c in names}
        columns[text] = pa.array(texts, pa.string())
        yield from pa.table({**columns, made[0]: total, made[1]: lost}).combine_chunks().to_batches()

    index = published(scattered(chunks, SENT, own, merged), SENT, INDEX, index_of)
    owners = probed(chunks, index, INDEX, scattered(chunks, PROBE, probe), PROBE, BACK, answer)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return resolved(chunks, [(owners, BACK)], f"{fields}, `{made[0]}` long, `{made[1]}` long", finish)


def digest_query(docs: DataFrame) -> DataFrame:
    out = line_dedup(id_text(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def oracle(least: int = LEAST) -> str:
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, i, ls[i] AS line,
         translate(trim(ls[i], {space}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)
), o AS (
  SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= {least} GROUP BY k HAVING min(doc_id) < max(doc_id)
), m AS (
  SELECT l.*, coalesce(owner <> doc_id, false) AS lost FROM l LEFT JOIN o USING (k)
)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY rid
"""
