"""Files by path or URI: listing folders, and reading forward by ranges.

Bare paths and ``file:`` are read as local files, links seen as links; any other scheme goes through an Arrow file system.
A scheme that Arrow doesn't know needs an opener: "module:function", called with the URI in driver and tasks, that gives an
Arrow file system and the path in it."""

from __future__ import annotations

import importlib
import os
import re
import stat
from collections.abc import Iterator
from typing import NamedTuple

#: Bytes fetched beside those asked for: at first, and at most where reading goes on.
AHEAD = (16 << 10, 1 << 20)
FILE, FOLDER, LINK, OTHER, MISSING = "file", "folder", "link", "other", "missing"


class Entry(NamedTuple):
    name: str
    kind: str
    size: int | None


class Local:
    """Local files.  ``file:`` may stand before a path; entries whose names are no UTF-8 are passed over."""

    def _plain(self, path: str) -> str:
        return re.sub(r"^file:(//(?=/))?", "", path)

    def _entry(self, name: str, s: os.stat_result) -> Entry:
        kind = LINK if stat.S_ISLNK(s.st_mode) else FOLDER if stat.S_ISDIR(s.st_mode) else FILE if stat.S_ISREG(s.st_mode) else OTHER
        return Entry(name, kind, s.st_size if kind == FILE else None)

    def look(self, path: str) -> Entry:
        try:
            return self._entry(os.path.basename(path), os.lstat(self._plain(path)))
        except (FileNotFoundError, NotADirectoryError):
            return Entry(os.path.basename(path), MISSING, None)

    def entries(self, folder: str) -> Iterator[Entry]:
        with os.scandir(self._plain(folder)) as found:
            for e in found:
                if not e.name.isprintable() and any("\ud800" <= c <= "\udfff" for c in e.name):
                    continue  # a name that is no text
                try:
                    yield self._entry(e.name, e.stat(follow_symlinks=False))
                except OSError:
                    continue  # gone since

    def open(self, path: str):
        return open(self._plain(path), "rb", buffering=0)


class Remote:
    """Files of an Arrow file system, which shows no links."""

    def __init__(self, fs, inner: str, uri: str):
        self.fs, self.inner, self.uri = fs, inner.rstrip("/"), uri.rstrip("/")

    def _plain(self, uri: str) -> str:
        return self.inner + uri.rstrip("/").removeprefix(self.uri)

    def _entry(self, info) -> Entry:
        from pyarrow.fs import FileType

        kind = {FileType.File: FILE, FileType.Directory: FOLDER, FileType.NotFound: MISSING}.get(info.type, OTHER)
        return Entry(info.base_name, kind, info.size if kind == FILE else None)

    def look(self, path: str) -> Entry:
        return self._entry(self.fs.get_file_info(self._plain(path)))

    def entries(self, folder: str) -> Iterator[Entry]:
        from pyarrow.fs import FileSelector

        yield from map(self._entry, self.fs.get_file_info(FileSelector(self._plain(folder))))

    def open(self, path: str):
        return self.fs.open_input_file(self._plain(path))


def is_local(path: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) is None or path.startswith("file:")


def place(path: str, opener: str | None = None) -> Local | Remote:
    """Where a path or URI and all under it lie."""
    if opener:
        module, _, function = opener.partition(":")
        return Remote(*getattr(importlib.import_module(module), function)(path), path)
    if is_local(path):
        return Local()
    from pyarrow.fs import FileSystem

    return Remote(*FileSystem.from_uri(path), path)


class Ranged:
    """Reads a file forward.  What is skipped is not fetched; ``fetched`` counts what is, ``budget`` bounds it."""

    def __init__(self, stream, size: int, budget: int | None = None):
        self.stream, self.size, self.budget = stream, size, budget
        self.at, self.fetched, self.ahead = 0, 0, AHEAD[0]
        self.held, self.used = b"", 0

    def read(self, n: int) -> bytes:
        """n bytes, or those that are left."""
        out = self.held[self.used : self.used + n]
        self.used += len(out)
        self.at += len(out)
        lacking = min(n - len(out), self.size - self.at)
        if lacking <= 0:
            return out
        parts = [out]
        while lacking:
            want = min(lacking + self.ahead, self.size - self.at)
            if self.budget is not None:
                want = min(want, self.budget - self.fetched)
                if want <= 0:
                    raise OSError(f"more than {self.budget} bytes would be read")
            self.stream.seek(self.at)
            self.held, self.used = self.stream.read(want), 0
            if not self.held:
                break
            self.fetched += len(self.held)
            self.ahead = min(2 * self.ahead, AHEAD[1])
            part = self.held[:lacking]
            self.used = len(part)
            self.at += len(part)
            lacking -= len(part)
            parts.append(part)
        return b"".join(parts)

    def skip(self, n: int) -> int:
        """Passes over n bytes, or those that are left."""
        n = min(n, self.size - self.at)
        self.at += n
        self.used += n
        if self.used > len(self.held):
            self.held, self.used, self.ahead = b"", 0, AHEAD[0]
        return n
