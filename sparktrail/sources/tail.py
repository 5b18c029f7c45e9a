"""A streaming source of lines from files that still grow.

``spark.readStream.format("growing_lines").option("path", folder)`` gives ``file, start, line`` for
every complete line: ``start`` is the byte at which the line begins. A last line without
its end is held back until it has one. The position of a query is the bytes read of each
file; a file that became shorter, or begins differently, is read again from its start.

A file leaves the position when it is gone from the folder; one that is replaced by
another of the same length is noticed when it grows. Reading is split in ranges of bytes,
so one large file is read by many tasks. A batch takes all that is new, since the engine
does not tell Python sources where the last one ended. Folders may be on any store that
``pyarrow.fs`` opens by its URI.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "growing_lines"
SCHEMA = "file string, start bigint, line string"
#: Bytes by which a file's beginning is told, that are looked at to find a line's end, of a task.
HEAD, LOOK, RANGE = 256, 1 << 16, 64 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def create(path: str):
    """A file of a store, written from its start."""
    store, name = _store(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(name)


class Range(InputPartition):
    """A task's part of what is new in a file: the lines that begin in it, up to the end of the new bytes."""

    def __init__(self, file: str, first: int, start: int, end: int, stop: int) -> None:
        self.file, self.first, self.start, self.end, self.stop = file, first, start, end, stop


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LineReader(self.options)


def _head(source, size: int) -> str:
    return hashlib.sha256(source.read_at(size, 0)).hexdigest()[:16]


def _line_end(source, low: int, high: int) -> int:
    """The place after the last line end in a range of bytes; ``low`` if there is none."""
    while high > low:
        start = max(low, high - LOOK)
        at = source.read_at(high - start, start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        high = start
    return low


class LineReader(DataSourceStreamReader):
    """Offsets are ``{file: [bytes read, bytes of the head, hash of the head]}``."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.suffix = options.get("suffix", "")
        self.position: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> list:
        from pyarrow import fs

        store, path = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return store, sorted((f for f in found if f.is_file and f.base_name.endswith(self.suffix) and f.base_name[:1] not in "._"), key=lambda f: f.path)

    def latestOffset(self) -> dict:
        """Where the complete lines end now. Files that have not changed since the last call are not opened."""
        store, files = self._files()
        position = {}
        for info in files:
            known = self.position.get(info.path)
            if known and info.size == known[3]:
                position[info.path] = known
                continue
            read, head_size, head = known[:3] if known else (0, 0, "")
            with store.open_input_file(info.path) as source:
                if info.size < read or (head_size and _head(source, head_size) != head):
                    read = 0
                end = _line_end(source, read, info.size)
                head_size = min(HEAD, end)
                position[info.path] = [end, head_size, _head(source, head_size), info.size]
        self.position = position
        return {file: known[:3] for file, known in position.items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for file, (upto, _, _) in end.items():
            begin, head_size, head = start.get(file, [0, 0, ""])
            if begin > upto or (head_size and self._changed(file, head_size, head)):
                begin = 0
            out += [Range(file, begin, at, min(at + RANGE, upto), upto) for at in range(begin, upto, RANGE)]
        return out

    def _changed(self, file: str, head_size: int, head: str) -> bool:
        store, _ = _store(self.folder)
        with store.open_input_file(file) as source:
            return _head(source, head_size) != head

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = _store(self.folder)
        with store.open_input_file(partition.file) as source:
            at = partition.start
            if at > partition.first:  # the line that spans the range's start belongs to the one before
                source.seek(at - 1)
                at += len(_rest_of_line(source)) - 1
            source.seek(at)
            held = b""
            while at < partition.end:
                block = source.read(min(1 << 20, partition.stop - at - len(held)))
                if not block:
                    break
                lines = (held + block).split(b"\n")
                held = lines.pop()
                for line in lines:
                    if at >= partition.end:
                        return
                    yield partition.file.rsplit("/", 1)[-1], at, line.removesuffix(b"\r").decode("utf-8", "replace")
                    at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


def _rest_of_line(source) -> bytes:
    out = b""
    while block := source.read(LOOK):
        at = block.find(b"\n")
        if at >= 0:
            return out + block[: at + 1]
        out += block
    return out


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)
