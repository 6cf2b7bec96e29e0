"""Where journals lie: local or mounted files, or any file system that pyarrow opens by its URI.

Paths without a scheme, and ``file:`` ones, go through the operating system. Others (``hdfs://``,
``s3://``, ``gs://``) go through ``pyarrow.fs``, on the driver and on executors alike, as do schemes
that ``register_store`` adds. What is needed is little: whole objects are written once and seen
when they are closed; they are listed, read at places, and deleted.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable

from inkwell.functions import codecs


def register_store(scheme: str, make: Callable) -> None:
    """``make(uri)`` returns a pyarrow file system and the path in it. Call it before ``session.enable``."""
    codecs.ADDED["store"][scheme] = make


class Files:
    """Files of the operating system."""

    remote = False

    def open(self, path: str, mode: str):
        return open(path, mode, buffering=1 << 20)

    def size(self, path: str) -> int:
        return os.path.getsize(path)

    def is_file(self, path: str) -> bool:
        return os.path.isfile(path)

    def names(self, path: str) -> list[str]:
        """Names of the files in a folder; none where there is no such folder."""
        return sorted(e.name for e in os.scandir(path) if e.is_file()) if os.path.isdir(path) else []

    def folder(self, path: str) -> None:
        os.makedirs(path, exist_ok=True)

    def move(self, path: str, target: str) -> None:
        os.replace(path, target)

    def delete(self, path: str) -> None:
        if os.path.exists(path):
            os.remove(path)


class Remote:
    """A file system of pyarrow."""

    remote = True

    def __init__(self, fs):
        self.fs = fs

    def _info(self, path: str):
        return self.fs.get_file_info(path)

    def open(self, path: str, mode: str):
        if "w" in mode:
            return self.fs.open_output_stream(path)
        return io.BufferedReader(self.fs.open_input_file(path), 1 << 20)

    def size(self, path: str) -> int:
        return self._info(path).size

    def is_file(self, path: str) -> bool:
        return self._info(path).is_file

    def names(self, path: str) -> list[str]:
        from pyarrow.fs import FileSelector

        return sorted(i.base_name for i in self.fs.get_file_info(FileSelector(path, allow_not_found=True)) if i.is_file)

    def folder(self, path: str) -> None:
        self.fs.create_dir(path, recursive=True)

    def move(self, path: str, target: str) -> None:
        self.fs.move(path, target)

    def delete(self, path: str) -> None:
        if self.is_file(path):
            self.fs.delete_file(path)


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def at(path: str) -> tuple[Files | Remote, str]:
    """The store of a path and the path in it."""
    scheme = path.split("://", 1)[0] if "://" in path else "file"
    if scheme in codecs.ADDED["store"]:
        fs, inside = codecs.ADDED["store"][scheme](path)
        return Remote(fs), inside
    if scheme == "file":
        return Files(), local(path)
    from pyarrow.fs import FileSystem

    fs, inside = FileSystem.from_uri(path)
    return Remote(fs), inside
