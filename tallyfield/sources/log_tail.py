"""Log files that grow in place, as a streaming data source.

``spark.readStream.format("log_tail").option("path", folder).load()`` gives every line once, as
(run, file, at, line): the folder of the file, its path, the line's first byte, and its text. What
has been read is a byte position per file, kept in the query's own checkpoint. A line counts when
its line break is there: the unfinished rest of a file waits for a later batch. A file that became
shorter was written anew and is read from its start.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "run string, file string, at long, line string"
SPLIT_BYTES = 64 << 20  # of one file that one task reads
BLOCK = 1 << 20


def _folder(path: str):
    """(file system, path) of a folder given by URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def whole_lines(store, path: str, done: int, size: int) -> int:
    """First byte behind the last line break in [done, size); ``done`` if there is none."""
    with store.open_input_file(path) as f:
        end = size
        while end > done:
            start = max(done, end - BLOCK)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return done


def lines_between(store, path: str, first: int, last: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in [first, last), none beyond ``stop``.

    A line that begins before ``first`` belongs to the part before, so parts of a file have each
    line once, however they are cut.
    """
    with store.open_input_file(path) as f:
        at = max(first - 1, 0)
        f.seek(at)
        skip = first > 0  # up to and with the break before the first own line
        rest = b""
        while at < stop:
            block = f.read(min(BLOCK, stop - at))
            if not block:
                return
            at += len(block)
            rest += block
            lines = rest.split(b"\n")
            rest = lines.pop()
            place = at - len(rest) - sum(len(x) + 1 for x in lines)
            for line in lines:
                if skip:
                    skip = False
                elif place >= last:
                    return
                else:
                    yield place, line
                place += len(line) + 1
            if place >= last and not skip:
                return


@dataclass
class Part(InputPartition):
    """Bytes of one file: lines that begin in [first, last), up to ``stop``."""

    run: str
    file: str
    first: int
    last: int
    stop: int


class LogTailReader(DataSourceStreamReader):
    """Offsets are {"files": {path: bytes read}}; all methods but ``read`` run in the driver.

    The driver lists the folder and reads the last bytes of grown files, never a whole one.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.suffix = options.get("suffix", ".jsonl")
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.known: dict[str, int] = {}  # ends found before, so that only new bytes are searched

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, root = _folder(self.path)
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and info.path.endswith(self.suffix):
                done = self.known.get(info.path, 0)
                if info.size != done:
                    self.known[info.path] = whole_lines(store, info.path, done if info.size > done else 0, info.size)
        return {"files": dict(self.known)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for file, stop in sorted(end["files"].items()):
            done = start["files"].get(file, 0)
            first = done if stop >= done else 0
            while first < stop:
                last = min(first + self.split, stop)
                out.append(Part(file.rsplit("/", 2)[-2] if "/" in file else "", file, first, last, stop))
                first = last
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        store, _ = _folder(self.path)
        text = codecs.getdecoder("utf-8")
        for at, line in lines_between(store, partition.file, partition.first, partition.last, partition.stop):
            yield partition.run, partition.file, at, text(line, "replace")[0].rstrip("\r")


class LogTail(DataSource):
    """The source behind the name ``log_tail``; options path, suffix (.jsonl) and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogTailReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make ``log_tail`` known to a session."""
    spark.dataSource.register(LogTail)
