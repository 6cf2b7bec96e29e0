"""Pluggable hash, codec and clock of a journal; neither hash nor codec is recorded in a file."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

HASH_LEN = 20


class _Truncated:
    """A hashlib hash cut to 20 bytes; copies keep the state, so a failed write can restore it."""

    def __init__(self, inner):
        self.inner = inner

    def update(self, data: bytes) -> None:
        self.inner.update(data)

    def digest(self) -> bytes:
        return self.inner.digest()[:HASH_LEN]

    def copy(self) -> _Truncated:
        return _Truncated(self.inner.copy())


HASHES: dict[str, Callable] = {name: (lambda n=name: _Truncated(hashlib.new(n))) for name in ("sha256", "sha1", "sha512", "blake2b")}


#: Hashes, codecs and stores that callers added, which sessions send to the workers.
ADDED: dict[str, dict] = {"hash": {}, "codec": {}, "store": {}}


def register_hash(name: str, make: Callable) -> None:
    """``make()`` returns an object with update, digest (20 bytes) and copy. Call it before ``session.enable``."""
    HASHES[name] = ADDED["hash"][name] = make


def adopt(added: dict[str, dict]) -> None:
    """Takes over what another process registered."""
    HASHES.update(added["hash"])
    CODECS.update(added["codec"])
    ADDED["store"].update(added["store"])


def hash_bytes(name: str, *parts: bytes) -> bytes:
    h = HASHES[name]()
    for p in parts:
        h.update(p)
    return h.digest()


def _zstd(level: int, data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def _unzstd(data: bytes, size: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)


def _zlib(level: int, data: bytes) -> bytes:
    import zlib

    return zlib.compress(data, level)


def _unzlib(data: bytes, size: int) -> bytes:
    import zlib

    return zlib.decompress(data)


CODECS: dict[str, tuple[Callable[[int, bytes], bytes], Callable[[bytes, int], bytes]]] = {"zstd": (_zstd, _unzstd), "zlib": (_zlib, _unzlib)}


def register_codec(name: str, compress: Callable, decompress: Callable) -> None:
    """``compress(level, data)`` and ``decompress(data, size)``. Call it before ``session.enable``."""
    CODECS[name] = ADDED["codec"][name] = compress, decompress


def stored(content: bytes, level: int | None, codec: str = "zstd") -> tuple[bytes, int | None]:
    """(bytes as stored, original length if compressed): compressed only if that is smaller in all.

    A codec that fails falls back to the plain content.
    """
    if level is None:
        return content, None
    try:
        packed = CODECS[codec][0](level, content)
    except Exception:  # noqa: BLE001  any codec error means: store as is
        return content, None
    if len(packed) + 4 < len(content):
        return len(content).to_bytes(4, "big") + packed, len(content)
    return content, None


def restored(data: bytes, original: int | None, codec: str = "zstd") -> bytes:
    return data if original is None else CODECS[codec][1](data[4:], original)


def now_micros() -> int:
    return time.time_ns() // 1000
