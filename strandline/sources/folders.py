"""Data sources for spark.read.format() and spark.readStream.format(): git log dumps and watched folders.

Files are opened with pyarrow's file systems, by path or URI: local and mounted folders, and the stores these know.

git_dump: rows of the dumps (git log --numstat, see git_log) in a file or folder. A dump is cut into ranges of bytes; a task
takes the commits whose header starts in its range, so a change needs no window to find its commit, and one large
dump is read by many tasks. Option table: commits or changes; option range_bytes.

watched_folder: path, modified, size and content of the files below a folder. As a stream it yields a file again whenever its time
of modification moves on; its offset is the last (time, path) that was read, so a stream resumes where it stopped. Files of the
last settle_seconds wait for the next batch: others of the same time may still come.

Filters on commit_hash, author_name, path and modified are applied at the source (spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

import datetime
import re
import time
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, StringStartsWith

RANGE_BYTES = 16 << 20
READ_BYTES = 1 << 20
HEADER = re.compile(rb"@([0-9A-Za-z]+)\|([^|\n]*)\|([^|\n]*)\|([^|\n]*)\|([^\n]*)")
CHANGE = re.compile(rb"(\d+|-)\t(\d+|-)\t([^\n]+)")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_below(path: str) -> list[fs.FileInfo]:
    """The files below a folder, or the file itself; hidden ones and markers of writers don't count."""
    system, at = opened(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return [f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"]


def lines_between(path: str, start: int, end: int) -> Iterator[bytes]:
    """The lines of a file from the first header that starts in a range up to the first header behind it."""
    system, at = opened(path)
    with system.open_input_file(at) as file:
        where, open_, rest = max(0, start - 1), start == 0, b""
        file.seek(where)
        if start:  # the line that holds the byte before the range belongs to the range before
            rest = None
        while True:
            data = file.read(READ_BYTES)
            if rest is None:
                cut = data.find(b"\n")
                if cut < 0 and data:
                    where += len(data)
                    continue
                data, where, rest = data[cut + 1 :] if data else b"", where + cut + 1, b""
            lines = (rest + data).split(b"\n")
            rest = lines.pop() if data else b""
            for line in lines:
                if line.startswith(b"@"):
                    if where >= end:
                        return
                    open_ = True
                where += len(line) + 1
                if open_:
                    yield line.rstrip(b"\r")
            if not data:
                return


class Pushed:
    """What a reader can leave out by itself: equality, prefixes and lower bounds of some columns."""

    def __init__(self, columns: set[str]):
        self.columns, self.tests = columns, []

    def take(self, filters: Iterable[Filter]) -> Iterator[Filter]:
        """Keeps the filters that it applies, and returns the others."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.columns and isinstance(f, EqualTo | StringStartsWith | GreaterThan | GreaterThanOrEqual):
                self.tests.append((name, type(f), f.value))
            else:
                yield f

    def __call__(self, **row) -> bool:
        for name, kind, value in self.tests:
            x = row[name]
            if x is None:
                return False
            if isinstance(x, datetime.datetime) and isinstance(value, datetime.datetime) and value.tzinfo is None:
                value = value.replace(tzinfo=x.tzinfo)
            good = x == value if kind is EqualTo else x.startswith(value) if kind is StringStartsWith else x > value if kind is GreaterThan else x >= value
            if not good:
                return False
        return True


class DumpRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class DumpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.kind = options["path"], int(options.get("range_bytes", RANGE_BYTES)), options.get("table", "changes")
        self.pushed = Pushed({"commit_hash", "author_name"})

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        yield from self.pushed.take([f for f in filters if self.kind == "commits" or getattr(f, "attribute", ("",))[0] == "commit_hash"])
        yield from (f for f in filters if self.kind != "commits" and getattr(f, "attribute", ("",))[0] != "commit_hash")

    def partitions(self) -> list[InputPartition]:
        scheme = "file://" if self.path.startswith("file:") else ""
        return [DumpRange(scheme + f.path, a, min(a + self.size, f.size)) for f in files_below(self.path) for a in range(0, f.size, self.size)]

    def read(self, partition: DumpRange | None) -> Iterator[tuple]:
        if partition is None:  # there are no files
            return
        commit, wanted = None, False
        for line in lines_between(partition.path, partition.start, partition.end):
            if line.startswith(b"@"):
                if not (m := HEADER.fullmatch(line)):
                    commit = None
                    continue
                commit, name, email, date, message = (x.decode("utf-8", "replace") for x in m.groups())
                wanted = self.pushed(commit_hash=commit, author_name=name)
                if wanted and self.kind == "commits":
                    try:
                        when = datetime.datetime.fromisoformat(date).replace(tzinfo=None)
                    except ValueError:
                        when = None
                    yield commit, name, email, when, message
            elif commit and wanted and self.kind == "changes" and (m := CHANGE.fullmatch(line)):
                added, deleted, path = m.groups()
                yield commit, path.decode("utf-8", "replace"), *(0 if n == b"-" else int(n) for n in (added, deleted))


class GitDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_dump"

    def schema(self) -> str:
        if self.options.get("table", "changes") == "commits":
            return "commit_hash string, author_name string, author_email string, author_date timestamp_ntz, message string"
        return "commit_hash string, file_path string, lines_added long, lines_deleted long"

    def reader(self, schema) -> DataSourceReader:
        return DumpReader(dict(self.options))


class FileGroup(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))
        self.paths = paths


def _time(info: fs.FileInfo) -> int:
    return info.mtime_ns // 1000


class FolderFiles:
    """Files of a folder, read in groups of about RANGE_BYTES."""

    def __init__(self, options: dict):
        self.path, self.size, self.settle = options["path"], int(options.get("range_bytes", RANGE_BYTES)), float(options.get("settle_seconds", 0))
        self.glob = options.get("suffix", "")
        self.pushed = Pushed({"path", "modified"})

    def found(self) -> list[tuple[int, str, int]]:
        return sorted((_time(f), f.path, f.size) for f in files_below(self.path) if f.path.endswith(self.glob))

    def groups(self, files: list[tuple[int, str, int]]) -> list[InputPartition]:
        out, held, size = [], [], 0
        for _, path, n in files:
            if held and size + n > self.size:
                out.append(FileGroup(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, FileGroup(held)] if held else out

    def rows(self, partition: FileGroup | None) -> Iterator[tuple]:
        system = opened(self.path)[0]
        for path in partition.paths if partition else []:
            info = system.get_file_info(path)
            if info.type != fs.FileType.File:
                continue  # it went meanwhile
            when = datetime.datetime.fromtimestamp(_time(info) / 1e6, datetime.UTC)
            if self.pushed(path=path, modified=when):
                with system.open_input_file(path) as file:
                    yield path, when, info.size, file.read().decode("utf-8", "replace")


class FolderReader(FolderFiles, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return self.pushed.take(filters)

    def partitions(self) -> list[InputPartition]:
        return self.groups(self.found())

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        return self.rows(partition)


class FolderStream(FolderFiles, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        old = int((time.time() - self.settle) * 1e6)
        known = [(t, p) for t, p, _ in self.found() if t <= old]
        return dict(zip(("time", "path"), known[-1], strict=True)) if known else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = (start["time"], start["path"]), (end["time"], end["path"])
        return self.groups([f for f in self.found() if a < f[:2] <= b])

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class WatchedFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "watched_folder"

    def schema(self) -> str:
        return "path string, modified timestamp, size long, content string"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session and lets their filters be pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GitDump, WatchedFolder):
        spark.dataSource.register(source)


__all__ = ["GitDump", "WatchedFolder", "register"]
