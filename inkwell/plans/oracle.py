"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from inkwell.plans.queries import HIGH, LOW, STRIDE

#: Events in blocks: h (one row for each event), lay (one row for each block, with places).
BLOCKS = """
e AS (SELECT event_id, epoch_us(ts) AS ts, strlen(props) AS len, event_type = 'error' AS a FROM events),
f AS (SELECT *, CASE WHEN a OR coalesce(lag(a) OVER (ORDER BY event_id), true) THEN 1 ELSE 0 END AS s FROM e),
g AS (SELECT *, CAST(sum(s) OVER (ORDER BY event_id) - 1 AS BIGINT) AS block_no FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY block_no ORDER BY event_id) - 1 AS comp_no FROM g),
bl AS (SELECT block_no, CASE WHEN bool_or(a) THEN 'A' ELSE 'B' END AS kind, arg_min(ts, comp_no) AS start_ts, arg_max(ts, comp_no) AS end_ts,
       count(*) AS n_components, CAST(sum(len) AS BIGINT) AS content_bytes,
       CAST(70 + sum(CASE WHEN a THEN 0 ELSE 17 END + len) AS BIGINT) AS size FROM h GROUP BY block_no),
lay AS (SELECT *, CAST(11 + coalesce(sum(size) OVER (ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS mn_start FROM bl)
"""
RANGE = f"epoch_us(TIMESTAMP '{LOW}') AND epoch_us(TIMESTAMP '{HIGH}')"
SIDES = (("included", "="), ("excluded", ""), ("unbounded", None))


def _matrix() -> str:
    parts = []
    for ln, lo in SIDES:
        for hn, ho in SIDES:
            low = "true" if lo is None else f"epoch_us(ts) >{lo} a"
            high = "true" if ho is None else f"epoch_us(ts) <{ho} b"
            parts.append(f"SELECT '{ln}' AS lower, '{hn}' AS upper, count(*) FILTER ({low} AND {high}) AS n FROM events, b")
    return "WITH b AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events WHERE event_id IN (100, 700)) " + " UNION ALL ".join(parts)


#: Parity of one byte, of each single bit, for four parity bytes.
BITS = (0x0F367840, 0x1E6CF080, 0x3CD8FD1D, 0x78ADE73A, 0xF047D374, 0xFD8EBBE8, 0xE7016BCD, 0xD302D687)
#: Parity of the magic number, by parity length.
MAGIC_PARITY = (
    (2, "6173"),
    (4, "0eb642e8"),
    (6, "59ebb128c1f8"),
    (8, "959a808d3f4ff595"),
    (16, "d3d2b45358ae2d4364d4648401a80f9a"),
    (32, "53a7f20ed2decf80dcf62c637c548340b3168ebea2b5466e8bc558167415d4c8"),
)

PARITY = f"""
WITH RECURSIVE unit(i, p) AS (VALUES {', '.join(f'({i}, CAST({p} AS BIGINT))' for i, p in enumerate(BITS))}),
g AS (SELECT b, bit_xor(CASE WHEN (b >> i) & 1 = 1 THEN p ELSE 0 END) AS v FROM range(256) t(b), unit GROUP BY b),
t(d, b, v) AS (
  SELECT 0, b, v FROM g
  UNION ALL
  SELECT d + 1, t.b, xor((t.v & 16777215) << 8, g.v) FROM t JOIN g ON g.b = t.v >> 24 WHERE d < 250
),
c AS (
  SELECT doc_id, c AS chunk_no, substr(hx, CAST(502 * c + 1 AS BIGINT), 502) AS part
  FROM (SELECT doc_id, hx, unnest(range((length(hx) + 501) // 502)) AS c FROM (SELECT doc_id, hex(encode(text)) AS hx FROM documents))
),
y AS (
  SELECT doc_id, chunk_no, length(part) // 2 - 1 - i AS d,
         (instr('0123456789ABCDEF', substr(part, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(part, 2 * i + 2, 1)) - 1 AS b
  FROM (SELECT doc_id, chunk_no, part, unnest(range(length(part) // 2)) AS i FROM c)
)
SELECT doc_id, chunk_no, format('{{:08x}}', CAST(bit_xor(t.v) AS BIGINT)) AS parity FROM y JOIN t USING (d, b) GROUP BY doc_id, chunk_no
"""

N = "strlen(text)"
CHUNKS = "CAST((strlen(text) + 250) // 251 AS BIGINT)"


def oracle_sql() -> dict[str, str]:
    bad = f"SELECT doc_id, 'EccChunk' AS kind, {N} AS data_len, CAST(0 AS BIGINT) AS chunk_at FROM documents WHERE doc_id % 10 = 0 AND {N} >= 64"
    return {
        "content_range_scan": f"SELECT epoch_us(ts) AS ts, CASE WHEN event_type = 'error' THEN 'A' ELSE 'B' END AS block_kind, props FROM events WHERE epoch_us(ts) BETWEEN {RANGE}",
        "range_bound_matrix": _matrix(),
        "scan_from_hint": f"WITH {BLOCKS} SELECT count(*) AS n, min(ts) AS min_ts, max(ts) AS max_ts, CAST(sum(len) AS BIGINT) AS bytes FROM h WHERE block_no >= 50",
        "open_tail_scan": f"""WITH {BLOCKS}, l AS (SELECT max(block_no) AS b FROM bl WHERE kind = 'B' AND n_components >= 3)
            SELECT CASE WHEN block_no < b THEN 'Closed' ELSE 'OpenBBlock' END AS state, count(*) AS n, max(ts) AS max_ts
            FROM h, l WHERE block_no < b OR block_no = b AND comp_no < 2 GROUP BY 1""",
        "content_bytes": "SELECT page_id, strlen(html) AS n_bytes, sha256(html) AS sha FROM pages",
        "file_config": "SELECT true AS matches, CAST(4 AS INTEGER) AS ecc_len",
        "components": f"SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS comp_no, turn AS ts, true AS ecc, {N} AS data_len, sha256(text) AS sha FROM conversations",
        "journal_roundtrip": "SELECT epoch_us(ts) AS ts, props FROM events",
        "journal_roundtrip_atomic": "SELECT doc_id, sha256(text) AS sha, true AS ecc, 'A' AS block_kind FROM documents",
        "magic_scan": f"SELECT doc_id, CAST(doc_id % 3 = 0 AS BIGINT) AS n_found, CASE WHEN doc_id % 3 = 0 THEN {N} ELSE -1 END AS first_at FROM documents",
        "block_assign": f"WITH {BLOCKS} SELECT event_id, block_no, comp_no, CASE WHEN a THEN 'A' ELSE 'B' END AS kind FROM h",
        "block_assign_close": """WITH e AS (SELECT event_id, event_type = 'error' AS a, event_type = 'signup' AS c FROM events),
            f AS (SELECT *, CASE WHEN NOT c AND (a OR coalesce(lag(a OR c) OVER (ORDER BY event_id), true)) THEN 1 ELSE 0 END AS s FROM e),
            g AS (SELECT *, CAST(sum(s) OVER (ORDER BY event_id) - 1 AS BIGINT) AS block_no FROM f)
            SELECT event_id, block_no, row_number() OVER (PARTITION BY block_no ORDER BY event_id) - 1 AS comp_no, CASE WHEN a THEN 'A' ELSE 'B' END AS kind FROM g WHERE NOT c""",
        "frame_layout": f"WITH {BLOCKS} SELECT block_no, kind, mn_start, mn_start + 12 AS block_start, mn_start + size AS block_end, n_components FROM lay",
        "block_times": f"WITH {BLOCKS} SELECT block_no, mn_start + 12 AS block_start, start_ts FROM lay",
        "block_summary": f"WITH {BLOCKS} SELECT block_no, kind, start_ts, end_ts, n_components, content_bytes FROM bl",
        "block_hash": "SELECT epoch_us(ts) AS start_ts, substr(sha256(props), 1, 40) AS stored, substr(sha256(props), 1, 40) AS computed FROM events WHERE event_type = 'error'",
        "block_states": f"WITH {BLOCKS} SELECT kind, 'Closed' AS state, count(*) AS n, CAST(sum(n_components) AS BIGINT) AS n_components, true AS hashes_agree FROM bl GROUP BY kind",
        "integrity_summary": f"""WITH {BLOCKS} SELECT count(*) AS num_blocks, CAST(sum(content_bytes) AS BIGINT) AS data_contents, CAST(sum(content_bytes) AS BIGINT) AS data_size_on_disk,
            CAST(0 AS BIGINT) AS errors_corrected, CAST(11 + sum(size) AS BIGINT) AS file_len_checked FROM bl""",
        "integrity_errors": f"WITH {BLOCKS} SELECT 'Corruption' AS error, mn_start + 12 AS error_at, 'StartHeader' AS component FROM lay WHERE block_no = 20",
        "integrity_damaged": f"""WITH {BLOCKS}, z AS (SELECT block_no, arg_min(len, comp_no) AS len0 FROM h GROUP BY block_no)
            SELECT block_no, kind, 'Closed' AS state, CAST([0, 1, 0, 2, 1][block_no % 5 + 1] AS BIGINT) AS errors_corrected,
                   CAST(CASE WHEN block_no % 5 = 2 AND len0 > 0 THEN n_components ELSE 0 END AS BIGINT) AS n_segments FROM bl JOIN z USING (block_no)""",
        "integrity_summary_damaged": f"""WITH {BLOCKS} SELECT count(*) AS num_blocks, CAST(sum(content_bytes) AS BIGINT) AS data_contents,
            CAST(sum([0, 1, 0, 2, 1][block_no % 5 + 1]) AS BIGINT) AS errors_corrected, CAST(11 + sum(size) AS BIGINT) AS file_len_checked FROM bl""",
        "damaged_segments": f"""WITH {BLOCKS}, z AS (SELECT block_no, arg_min(len, comp_no) AS len0 FROM h GROUP BY block_no)
            SELECT block_no, CASE WHEN kind = 'A' THEN 'Corrupt' ELSE 'MaybeCorrupt' END AS kind, CAST(len AS BIGINT) AS data_len,
                   CAST(mn_start + 29 + CASE WHEN kind = 'A' THEN 0 ELSE sum(17 + len) OVER (PARTITION BY block_no ORDER BY comp_no) - len END AS BIGINT) AS data_start
            FROM h JOIN lay USING (block_no) JOIN z USING (block_no) WHERE block_no % 5 = 2 AND len0 > 0""",
        "recovery_damaged": f"""WITH {BLOCKS}, z AS (SELECT block_no, arg_min(len, comp_no) AS len0 FROM h GROUP BY block_no)
            SELECT mn_start + size AS cut, CAST(CASE WHEN block_no % 3 = 0 THEN mn_start ELSE mn_start + size END AS BIGINT) AS recovered_len, block_no > 0 AS has_blocks,
                   CAST(CASE WHEN block_no % 3 = 2 THEN 2 ELSE 0 END AS BIGINT) AS errors_corrected,
                   CAST(CASE WHEN block_no % 3 = 1 AND len0 > 0 THEN n_components ELSE 0 END AS BIGINT) AS n_segments FROM lay JOIN z USING (block_no)""",
        "tail_recovery": f"""WITH {BLOCKS},
            l AS (SELECT max(block_no) AS b FROM lay),
            cuts AS (SELECT block_no, mn_start + 1 + block_no * {STRIDE} % size AS cut FROM lay
                     UNION SELECT block_no, unnest(range(mn_start + 1, mn_start + size + 1)) FROM lay, l WHERE block_no = b),
            c AS (SELECT h.block_no, CAST(sum(17 + len) OVER (PARTITION BY h.block_no ORDER BY comp_no) AS BIGINT) AS c FROM h),
            x AS (SELECT cut, block_no, any_value(kind) AS kind, any_value(mn_start) AS mn_start, any_value(size) AS size, coalesce(max(c.c) FILTER (mn_start + 29 + c.c <= cut), 0) AS whole
                  FROM cuts JOIN lay USING (block_no) JOIN c USING (block_no) GROUP BY ALL)
            SELECT CAST(cut AS BIGINT) AS cut,
                   CAST(CASE WHEN cut = mn_start + size THEN cut WHEN kind = 'B' AND cut >= mn_start + 29 THEN mn_start + 29 + whole + 41 ELSE mn_start END AS BIGINT) AS recovered_len,
                   cut = mn_start + size OR kind = 'B' AND cut >= mn_start + 29 OR block_no > 0 AS has_blocks FROM x""",
        "ecc_len": f"SELECT doc_id, {N} AS n_bytes, {CHUNKS} * 4 AS n_ecc, {N} AS n_message FROM documents",
        "ecc_parity": PARITY,
        "ecc_verify": f"SELECT doc_id, {CHUNKS} AS n_chunks, CASE WHEN doc_id % 4 > 0 THEN {CHUNKS} ELSE 0 END AS n_dirty FROM documents WHERE {N} > 0",
        "ecc_correct": f"""SELECT doc_id, restored, CASE WHEN restored THEN errors ELSE CAST(0 AS BIGINT) END AS errors, CASE WHEN restored THEN sha END AS sha
            FROM (SELECT doc_id, doc_id % 4 < 3 OR {N} < 3 AS restored, CAST(({CHUNKS} - 1) * (doc_id % 4) + least(doc_id % 4, {N} - 251 * ({CHUNKS} - 1)) AS BIGINT) AS errors, sha256(text) AS sha
            FROM documents WHERE {N} > 0)""",
        "two_phase_repair": f"SELECT doc_id, doc_id % 4 = 0 OR {N} = 0 AS first_ok, doc_id % 4 < 3 OR {N} < 3 AS repaired_ok FROM documents",
        "corrupt_segments": bad,
        "corruption_class": f"SELECT kind, count(*) AS n, CAST(sum(data_len) AS BIGINT) AS bytes FROM ({bad}) GROUP BY kind",
        "ecc_constants": f"SELECT CAST(n AS INTEGER) AS ecc_len, p AS parity FROM (VALUES {', '.join(f"({n}, '{p}')" for n, p in MAGIC_PARITY)}) t(n, p)",
        "tag_decode": """SELECT CAST(tag AS INTEGER) AS tag, CASE WHEN legal THEN ['A', 'B', 'content', 'end'][((tag >> 5) & 3) + 1] END AS kind,
            legal AND tag & 8 <> 0 AS has_ecc, legal AND tag & 4 <> 0 AS is_comp, legal
            FROM (SELECT tag, tag IN (0, 4, 8, 12, 32, 64, 68, 72, 76, 96) AS legal FROM range(256) t(tag))""",
        "header_pack": f"WITH {BLOCKS} SELECT event_id, format('40{{:016x}}{{:02x}}{{:02x}}{{:02x}}{{:02x}}', ts, len & 255, (len >> 8) & 255, (len >> 16) & 255, (len >> 24) & 255) AS raw FROM e",
        "io_error_class": """SELECT * FROM (VALUES ('EROFS', 'fatal', 'ReadOnlyFileSystem'), ('ENOSPC', 'fatal', 'NoSpace'), ('EFBIG', 'fatal', 'FileTooLarge'),
            ('EBADF', 'fatal', 'InvalidFileDescriptor'), ('EDQUOT', 'fatal', 'QuotaExceeded'), ('EIO', 'fatal', 'HardwareFailure'),
            ('EAGAIN', 'transient', 'TemporarilyUnavailable'), ('EINTR', 'transient', 'Interrupted'), ('ENFILE', 'transient', 'TooManyOpenFiles'),
            ('EMFILE', 'transient', 'TooManyOpenFiles'), ('EDEADLK', 'transient', 'LockContention'), ('EPIPE', 'transient', 'Other'),
            ('PermissionDenied', 'fatal', 'PermissionDenied'), ('NotFound', 'fatal', 'FileNotFound'), ('Interrupted', 'transient', 'Interrupted'),
            ('WouldBlock', 'transient', 'TemporarilyUnavailable')) t(name, class, variant)""",
        "backoff_schedule": "SELECT CAST(a AS INTEGER) AS attempt, CAST(least(50 * 2 ** (a - 1), 5000) AS BIGINT) AS delay_ms FROM range(1, 10) t(a)",
        "ts_monotonic_check": """SELECT o_orderkey, ts, prev_ts FROM (
            SELECT o_orderkey, epoch_us(o_orderdate) AS ts, lag(epoch_us(o_orderdate)) OVER (ORDER BY o_orderkey) AS prev_ts FROM orders) WHERE ts < prev_ts""",
        "ts_monotonic_nulls": """SELECT o_orderkey, ts, prev_ts FROM (
            SELECT o_orderkey, ts, lag(ts) OVER (ORDER BY o_orderkey) AS prev_ts FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN epoch_us(o_orderdate) END AS ts FROM orders)) WHERE ts < prev_ts""",
        "stream_tail": "SELECT epoch_us(ts) AS ts, props FROM events",
        "stream_append": "SELECT turn AS ts, sha256(text) AS sha, true AS ecc FROM conversations",
        "stream_block_assign": """WITH e AS (SELECT user_id % 4 AS journal, event_id AS seq, event_type = 'error' AS a FROM events),
            f AS (SELECT *, CASE WHEN a OR coalesce(lag(a) OVER w, true) THEN 1 ELSE 0 END AS s FROM e WINDOW w AS (PARTITION BY journal ORDER BY seq)),
            g AS (SELECT *, CAST(sum(s) OVER (PARTITION BY journal ORDER BY seq) - 1 AS BIGINT) AS block_no FROM f)
            SELECT journal, seq, CASE WHEN a THEN 'A' ELSE 'B' END AS kind, block_no, row_number() OVER (PARTITION BY journal, block_no ORDER BY seq) - 1 AS comp_no FROM g""",
    }
