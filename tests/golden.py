"""The 344-byte fixture: one B block of three components, two A blocks."""

from __future__ import annotations

from inkwell.functions import codecs
from inkwell.sources.format import Layout
from tests.blake3 import Blake3

codecs.register_hash("blake3", Blake3)
TS = int.from_bytes(bytes([7, 6, 5, 4, 3, 2, 1, 0]), "big")
LAYOUT = Layout(4)
B, A = b"Some content", b"Atomic content"


def golden() -> bytes:
    lay, h = LAYOUT, Blake3()
    out = lay.file_header() + lay.magic + lay.pack(0x20, TS)
    for ecc in (False, True, False):
        c = lay.component(TS, B, ecc, None, "zstd")
        h.update(c)
        out += c
    out += lay.close(TS, h.digest())
    for ecc in (False, True):
        out += lay.magic + lay.a_block(TS, TS, A, ecc, None, "blake3", "zstd")
    return out
