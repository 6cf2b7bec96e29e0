"""I/O error classes and retries with exponential backoff."""

from __future__ import annotations

import errno
import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

#: Which errors are fatal, by name of the kind and of the code.
FATAL_KINDS = {"PermissionDenied": "PermissionDenied", "NotFound": "FileNotFound"}
FATAL_CODES = {"EROFS": "ReadOnlyFileSystem", "ENOSPC": "NoSpace", "EFBIG": "FileTooLarge", "EBADF": "InvalidFileDescriptor", "EDQUOT": "QuotaExceeded", "EIO": "HardwareFailure"}
TRANSIENT_KINDS = {"Interrupted": "Interrupted", "WouldBlock": "TemporarilyUnavailable"}
TRANSIENT_CODES = {"EAGAIN": "TemporarilyUnavailable", "EWOULDBLOCK": "TemporarilyUnavailable", "EINTR": "Interrupted", "ENFILE": "TooManyOpenFiles", "EMFILE": "TooManyOpenFiles", "EDEADLK": "LockContention"}


class FileSystemError(OSError):
    fatal = True

    def __init__(self, variant: str, cause: OSError, context: str | None = None):
        text = f"{context}: {cause}" if context and variant in ("Other", "IoError") else str(cause)
        super().__init__(cause.errno, text)
        self.variant, self.context = variant, context


class FatalError(FileSystemError):
    pass


class TransientError(FileSystemError):
    fatal = False


def kind_of(e: OSError) -> str:
    for kind, cls in (("PermissionDenied", PermissionError), ("NotFound", FileNotFoundError), ("Interrupted", InterruptedError), ("WouldBlock", BlockingIOError)):
        if isinstance(e, cls):
            return kind
    return "Other"


def classify(kind: str, code: int | None) -> tuple[str, str]:
    """(fatal or transient, variant); what is unknown is transient."""
    for table, fate in ((FATAL_KINDS, "fatal"), (TRANSIENT_KINDS, "transient")):
        if kind in table:
            return fate, table[kind]
    for table, fate in ((FATAL_CODES, "fatal"), (TRANSIENT_CODES, "transient")):
        for name, variant in table.items():
            if code is not None and code == getattr(errno, name, None):
                return fate, variant
    return "transient", "Other" if code is not None else "IoError"


def categorized(e: OSError, context: str | None = None) -> FileSystemError:
    fate, variant = classify(kind_of(e), e.errno)
    return (FatalError if fate == "fatal" else TransientError)(variant, e, context)


@dataclass(frozen=True)
class RetryConfig:
    max_attempts: int = 5
    initial_ms: int = 50
    factor: float = 2.0
    cap_ms: int = 5000
    total_s: float = 30.0
    jitter: float = 0.0

    def __post_init__(self):
        if self.max_attempts < 1:
            raise ValueError("max_attempts is at least 1")

    def delays(self) -> list[int]:
        """Milliseconds between attempts."""
        out, d = [], float(self.initial_ms)
        for _ in range(self.max_attempts - 1):
            out.append(int(min(d, self.cap_ms)))
            d = min(d * self.factor, self.cap_ms)
        return out


def retry_call(call: Callable, config: RetryConfig = RetryConfig(), context: str | None = None, sleep: Callable[[float], None] = time.sleep):
    """``call()``, again after transient errors; fatal ones and the last one are raised as classified."""
    began = time.monotonic()
    for i in range(config.max_attempts):
        try:
            return call()
        except OSError as e:
            error = e if isinstance(e, FileSystemError) else categorized(e, context)
            if error.fatal or i == config.max_attempts - 1 or int(time.monotonic() - began) >= config.total_s:
                raise error from e
            sleep(config.delays()[i] / 1000 * (1 + config.jitter * random.random()))


def retrying(config: RetryConfig = RetryConfig(), context: str | None = None):
    """Decorator form of ``retry_call``."""

    def wrap(f):
        @wraps(f)
        def inner(*a, **k):
            return retry_call(lambda: f(*a, **k), config, context)

        return inner

    return wrap


class RetryingFile:
    """A binary file whose every call is retried; after a transient error it goes on from where the call began."""

    def __init__(self, path: str, mode: str = "rb", config: RetryConfig = RetryConfig(), opener: Callable = open, sleep: Callable[[float], None] = time.sleep):
        self.path, self.config, self.sleep, self.at = path, config, sleep, 0
        self.file = self._try(lambda: opener(path, mode), "open")

    def _try(self, call: Callable, what: str):
        return retry_call(call, self.config, f"{what} {self.path}", self.sleep)

    def _from_here(self, call: Callable, what: str):
        tried = False

        def again():
            nonlocal tried
            if tried:  # a failed call may have moved the position
                self.file.seek(self.at)
            tried = True
            return call()

        out = self._try(again, what)
        self.at = self.file.tell()
        return out

    def read(self, size: int = -1) -> bytes:
        return self._from_here(lambda: self.file.read(size), "read")

    def write(self, data: bytes) -> int:
        return self._from_here(lambda: self.file.write(data), "write")

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = self._try(lambda: self.file.seek(to, whence), "seek")
        return self.at

    def tell(self) -> int:
        return self.at

    def truncate(self, size: int | None = None) -> int:
        return self._try(lambda: self.file.truncate(size), "truncate")

    def flush(self) -> None:
        self._try(self.file.flush, "flush")

    def close(self) -> None:
        self._try(self.file.close, "close")

    def __enter__(self) -> RetryingFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()


#: The standard error that stands for each variant; what is not listed is a plain OSError.
STANDARD = {
    "PermissionDenied": PermissionError, "ReadOnlyFileSystem": PermissionError, "FileNotFound": FileNotFoundError,
    "TemporarilyUnavailable": BlockingIOError, "LockContention": BlockingIOError, "Interrupted": InterruptedError,
}


def standard(error: FileSystemError) -> OSError:
    """The error as a standard one, for callers that know no classes: of IoError the cause itself."""
    if error.variant == "IoError" and isinstance(error.__cause__, OSError):
        return error.__cause__
    out = STANDARD.get(error.variant, OSError)(error.errno, str(error))
    out.__cause__ = error
    return out
