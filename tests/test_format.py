"""Golden vectors, the fixture, its damages, and every truncation of it."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.functions import rs
from inkwell.sources.format import ECC_LENGTHS, MAGIC, ConfigMismatch, Layout, read_config
from inkwell.sources.parser import Journal
from tests.golden import LAYOUT, golden

G = golden()


def journal(data: bytes) -> Journal:
    return Journal(data[11:], LAYOUT, 11, "blake3")


def zero(data: bytes, *at: int) -> bytes:
    x = bytearray(data)
    for i in at:
        x[i] = 0
    return bytes(x)


def test_parity_vectors():
    assert list(rs.encode(MAGIC, 2)) == [97, 115]
    assert list(rs.encode(MAGIC, 4)) == [14, 182, 66, 232]
    assert list(rs.encode(b"\x80" * 251, 4)) == [214, 227, 17, 164]
    assert list(rs.encode(b"\x80" * 500, 4)) == [214, 227, 17, 164, 30, 173, 161, 146]
    assert list(rs.encode(bytes([1, 2, 3, 4, 5, 6, 7, 8, 9, 0]), 4)) == [166, 78, 63, 214]
    assert rs.encode(bytes(13), 4) == bytes(4)


def test_fixture_layout():
    assert len(G) == 344
    blocks = list(journal(G).walk())
    assert [(b.mn_start, b.block_start, b.block_end, b.kind, len(b.components)) for b in blocks] == [(11, 23, 172, "B", 3), (172, 184, 256, "A", 1), (256, 268, 344, "A", 1)]
    assert [c.data_start for c in blocks[0].components] == [57, 90, 119]
    assert list(blocks[0].stored_hash) == [33, 215, 215, 192, 27, 1, 94, 58, 192, 97, 207, 38, 108, 77, 159, 4, 65, 107, 184, 244]
    assert list(blocks[2].stored_hash) == [59, 64, 117, 102, 139, 248, 203, 101, 132, 81, 227, 62, 79, 23, 156, 103, 106, 46, 127, 152]


def test_integrity_of_damaged_files():
    r = journal(G).integrity()
    assert (r["num_blocks"], r["errors_corrected"], r["data_contents"], r["file_len_checked"]) == (3, 0, 64, 344)
    r = journal(G + G[11:19]).integrity()
    assert (r["num_blocks"], r["file_len_checked"]) == (3, 344)
    for cut in (289, 281):
        r = journal(G[:cut]).integrity()
        assert (r["num_blocks"], r["file_len_checked"], r["data_contents"]) == (2, 256, 50)
    assert journal(G[:289]).integrity()["last_state"] == "OpenABlock"
    assert journal(G[:281]).integrity()["last_state"] == "IncompleteStartHeader"
    r = journal(G[:61]).integrity()
    assert (r["num_blocks"], r["file_len_checked"], r["last_state"]) == (0, 40, "OpenBBlock")
    r = journal(zero(G, 285, 287)).integrity()
    assert (r["errors_corrected"], r["segments"]) == (2, [])
    assert journal(zero(G, 282, 284)).integrity()["errors_corrected"] == 2
    s = journal(zero(G[:289], 201, 203)).integrity()["segments"]
    assert [(x.kind, x.data_start, x.data_len) for x in s] == [("Corrupt", 201, 14)]
    s = journal(zero(G[:205], 57, 59)).integrity()["segments"]
    assert [(x.kind, x.data_start, x.data_len) for x in s] == [("MaybeCorrupt", 57, 12), ("MaybeCorrupt", 119, 12)]
    s = journal(zero(G, 285, 287, 288)).integrity()["segments"]
    assert [(x.kind, x.chunk_start, x.chunk_ecc_start, x.data_len) for x in s] == [("EccChunk", 289, 285, 14)]


def test_recovery_of_damaged_files():
    def rec(data):
        r = journal(data).recover()
        return r["recovered_len"], len(r["ops"]), r["errors_corrected"]

    assert rec(G) == (344, 1, 0)
    assert rec(G + G[11:19]) == (344, 1, 0)
    assert rec(G[:289])[:2] == (256, 2)
    assert rec(G[:281])[:2] == (256, 2)
    assert rec(G[:61])[:2] == (81, 2)
    assert rec(zero(G, 285, 287)) == (344, 2, 2)
    assert rec(zero(G, 282, 284)) == (344, 1, 2)
    r = journal(zero(G[:289], 201, 203)).recover()
    assert (r["recovered_len"], len(r["ops"]), [(x.kind, x.data_start) for x in r["segments"]]) == (256, 3, [("Corrupt", 201)])
    r = journal(zero(G[:205], 57, 59)).recover()
    assert (r["recovered_len"], len(r["ops"]), [x.data_start for x in r["segments"]]) == (172, 3, [57, 119])
    # A start header beyond repair: recovery goes on before it and ends.
    assert rec(zero(G, 268, 269, 270))[0] == 256
    assert rec(G + b"\x01" * 40)[0] == 344


def truncated(length: int) -> int:
    """Length after recovery of a prefix, in closed form."""
    if length < 23:
        return min(length, 11)
    ends = [(11, 172, "B", [40, 69, 102, 131]), (172, 256, "A", []), (256, 344, "A", [])]
    for s, e, kind, comps in ends:
        if length == e:
            return e
        if s < length < e:
            h = s + 12
            if kind == "B" and length >= h + 17:
                return max(c for c in comps if c <= length) + 41
            return s
        if length == s:
            return s
    return length


def test_every_truncation():
    for n in range(11, 345):
        assert journal(G[:n]).recover()["recovered_len"] == truncated(n), n


def test_config():
    assert read_config(G).ecc_len == 4
    for bad in (b"", G[:3], b"x" + G[1:]):
        with pytest.raises(ConfigMismatch):
            read_config(bad)
    with pytest.raises(ConfigMismatch):
        read_config(G, 8)
    for n in ECC_LENGTHS:
        assert read_config(Layout(n).file_header()) == Layout(n)


def test_zero_tail_is_not_data():
    r = journal(G + LAYOUT.magic + bytes(200))
    states = [b.state for b in r.walk()]
    assert states[-1] == "InvalidBlockStructure"
    assert journal(G + LAYOUT.magic + bytes(10)).recover()["recovered_len"] == 344


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=200), st.sampled_from(ECC_LENGTHS), st.randoms(use_true_random=False))
def test_flips_within_radius_are_repaired(data, n, rnd):
    data = data[: 255 - n]
    word = bytearray(data + rs.encode(data, n))
    for i in rnd.sample(range(len(word)), min(n // 2, len(word))):
        word[i] ^= rnd.randrange(1, 256)
    d, p, e = rs.correct(bytes(word[: len(data)]), bytes(word[len(data) :]))
    assert d == data and d + p == data + rs.encode(data, n) and e == min(n // 2, len(word))


@pytest.mark.parametrize("size", [0, 1, 250, 251, 252, 502])
@pytest.mark.parametrize("n", ECC_LENGTHS)
def test_content_sizes(size, n):
    lay = Layout(n)
    data = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    for ecc in (False, True):
        x = lay.magic + lay.a_block(1 << 63, 5, data, ecc, None, "sha256", "zstd")
        (b,) = Journal(x, lay, 0).walk()
        assert (b.state, b.stored_hash == b.computed_hash, b.segments, b.errors) == ("Closed", True, [], 0)


def test_compressed_blocks_and_magic_in_content():
    lay = LAYOUT
    text = b"abc " * 500 + lay.magic
    x = lay.magic + lay.a_block(1, 1, text, True, 3, "sha256", "zstd")
    (b,) = Journal(x, lay, 0).walk()
    assert b.components[0].compressed and b.components[0].orig_len == len(text)
    x = lay.magic + lay.a_block(1, 1, lay.magic * 3, False, None, "sha256", "zstd")
    j = Journal(x, lay, 0)
    assert [b.state for b in j.walk(resync=True)] == ["Closed"]
