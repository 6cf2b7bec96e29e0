"""Bytes of a journal: file header, magic numbers, component headers, blocks.

file   := magic version ecc_len
block  := magic parity, start header, body, end header, hash parity
header := tag(1) time(8, big-endian) length(4, little-endian) parity
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache

from inkwell.functions import codecs, rs

#: Fixed values of the file format: the bytes of the magic number, the version.
MAGIC = bytes([100, 111, 99, 117, 102, 111, 114, 116])
VERSION = b"V1"
ECC_LENGTHS = (2, 4, 6, 8, 16, 32)
TAGS = {
    0x00: "A", 0x08: "A", 0x04: "A", 0x0C: "A",
    0x20: "B",
    0x40: "content", 0x48: "content", 0x44: "content", 0x4C: "content",
    0x60: "end",
}
ECC_FLAG, COMP_FLAG = 0x08, 0x04
START_A, START_B, CONTENT, END = 0x00, 0x20, 0x40, 0x60
FILE_HEADER, HEADER, HASH = 11, 13, codecs.HASH_LEN
MOST = 0xFFFFFFFF


class JournalError(Exception):
    """Base of all errors of this package."""


class ConfigMismatch(JournalError):
    """The file's magic, version or parity length is not what was asked for."""


class EndOfFile(JournalError):
    """A component goes past the end of the file."""


class InvalidStructure(JournalError):
    def __init__(self, start: int):
        super().__init__(f"invalid block structure at {start}")
        self.start = start


class Corruption(JournalError):
    def __init__(self, start: int, component: str):
        super().__init__(f"{component} beyond repair at {start}")
        self.start, self.component = start, component


@dataclass(frozen=True)
class Layout:
    """Sizes that follow from the parity length, and the bytes of the magic number."""

    ecc_len: int = 4

    def __post_init__(self):
        if self.ecc_len not in ECC_LENGTHS:
            raise ConfigMismatch(f"parity length {self.ecc_len}")

    @cached_property
    def magic(self) -> bytes:
        return _magic(self.ecc_len)

    @cached_property
    def mn(self) -> int:
        return len(MAGIC) + self.ecc_len

    @cached_property
    def header(self) -> int:
        return HEADER + self.ecc_len

    @cached_property
    def hash(self) -> int:
        return HASH + self.ecc_len

    @cached_property
    def end(self) -> int:
        """Bytes that close a block."""
        return self.header + self.hash

    def ecc(self, length: int) -> int:
        return rs.ecc_size(length, self.ecc_len)

    def file_header(self) -> bytes:
        return MAGIC + VERSION + bytes([self.ecc_len])

    def protected(self, data: bytes) -> bytes:
        return data + rs.encode(data, self.ecc_len)

    def pack(self, tag: int, ts: int, length: int = 0) -> bytes:
        """A header with its parity."""
        return self.protected(raw_header(tag, ts, length))

    def content(self, data: bytes, ecc: bool) -> bytes:
        return (rs.encode(data, self.ecc_len) if ecc else b"") + data

    def a_block(self, ts: int, end_ts: int, data: bytes, ecc: bool, level: int | None, hash_name: str, codec: str) -> bytes:
        """An atomic block without its magic number."""
        data, original = codecs.stored(data, level, codec)
        tag = START_A | (ECC_FLAG if ecc else 0) | (COMP_FLAG if original is not None else 0)
        body = self.content(data, ecc)
        return self.pack(tag, ts, len(data)) + body + self.pack(END, end_ts) + self.protected(codecs.hash_bytes(hash_name, body))

    def component(self, ts: int, data: bytes, ecc: bool, level: int | None, codec: str) -> bytes:
        """A component of a best-effort block; all of its bytes are hashed."""
        data, original = codecs.stored(data, level, codec)
        tag = CONTENT | (ECC_FLAG if ecc else 0) | (COMP_FLAG if original is not None else 0)
        return self.pack(tag, ts, len(data)) + self.content(data, ecc)

    def close(self, ts: int, digest: bytes) -> bytes:
        return self.pack(END, ts) + self.protected(digest)


@lru_cache(maxsize=None)
def _magic(n: int) -> bytes:
    return MAGIC + rs.encode(MAGIC, n)


def raw_header(tag: int, ts: int, length: int = 0) -> bytes:
    if length > MOST:
        raise JournalError("content of 4 GiB or more does not fit a length of 32 bits")
    return bytes([tag]) + (ts & (1 << 64) - 1).to_bytes(8, "big") + length.to_bytes(4, "little")


def signed(raw: bytes) -> int:
    """Big-endian time as a signed 64-bit number; times of 2^63 and more come out negative."""
    return int.from_bytes(raw, "big", signed=True)


def read_config(head: bytes, ecc_len: int | None = None) -> Layout:
    """The layout that a file's first bytes name; a mismatch with ``ecc_len`` raises."""
    if len(head) < FILE_HEADER or head[:8] != MAGIC or head[8:10] != VERSION:
        raise ConfigMismatch("not a journal")
    if ecc_len is not None and head[10] != ecc_len:
        raise ConfigMismatch(f"parity length {head[10]}, not {ecc_len}")
    return Layout(head[10])
