"""Ends of text files: a data source that seeks instead of reading files whole, and a stream of the lines that are appended.

Files are opened through Arrow's file systems, so a path may be local or a URI of
a store that Arrow knows. Reading a tail costs the bytes asked for, whatever the
size of the file.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

TAIL_BYTES = 8192
BLOCK = 1 << 16
#: Bytes of a file that one task of a stream reads.
PART_BYTES = 64 << 20


def _open(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def files_of(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, of all files below a folder, or of those in it whose names match a pattern; hidden ones are left out."""
    from pyarrow import fs

    system, place = _open(path)
    folder, _, name = place.rpartition("/")
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [(place, info.size)]
    if info.type == fs.FileType.Directory:
        folder, name = place, "*"
    elif not any(c in name for c in "*?["):
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(folder, recursive=folder == place))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._" and fnmatch.fnmatchcase(f.base_name, name))


def tail(system, file: str, size: int, n: int) -> bytes:
    """The last ``n`` bytes of a file of ``size`` bytes."""
    with system.open_input_file(file) as opened:
        opened.seek(max(0, size - n))
        return opened.read(min(size, n))


def whole_characters(data: bytes, cut: bool) -> str:
    """Text of bytes that may begin inside a character; what is damaged elsewhere becomes U+FFFD."""
    skip = 0
    while cut and skip < min(3, len(data)) and data[skip] & 0xC0 == 0x80:
        skip += 1
    return data[skip:].decode("utf-8", errors="replace")


def line_end(system, file: str, size: int, least: int = 0) -> int:
    """Where the last whole line within ``size`` bytes ends; ``least`` if none ends after it."""
    with system.open_input_file(file) as opened:
        while size > least:
            begin = max(least, size - BLOCK)
            opened.seek(begin)
            found = opened.read(size - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            size = begin
    return least


@dataclass
class _File(InputPartition):
    path: str
    start: int
    end: int


class _TailReader(DataSourceReader):
    def __init__(self, path: str, n: int):
        self.path, self.n = path, n

    def partitions(self) -> list[_File]:
        return [_File(file, max(0, size - self.n), size) for file, size in files_of(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition is not None:  # a folder without files has one empty partition
            data = tail(_open(self.path)[0], partition.path, partition.end, self.n)
            yield partition.path, partition.end, whole_characters(data, partition.start > 0)


class _LineReader(DataSourceStreamReader):
    """Offsets are the bytes read of each file. A new file is read from its begin, one that has become shorter again from its begin."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system = _open(self.path)[0]
        return {"files": json.dumps({file: line_end(system, file, size) for file, size in files_of(self.path)}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        spans = [(file, before.get(file, 0) if before.get(file, 0) <= upto else 0, upto) for file, upto in after.items()]
        return [_File(file, at, upto) for file, a, upto in spans for at in range(a, upto, PART_BYTES)]

    def read(self, partition: _File) -> Iterator[tuple]:
        """The lines that begin in one part: its first ``PART_BYTES`` after ``start``; the last may go on behind them."""
        stop = min(partition.end, partition.start + PART_BYTES)
        with _open(self.path)[0].open_input_file(partition.path) as opened:
            at = partition.start
            if at:  # the line before may have begun in the part before
                opened.seek(at - 1)
                at += _skip(opened) - 1
            opened.seek(at)
            rest, begin = b"", at
            while begin < stop:
                block = opened.read(min(BLOCK, partition.end - begin - len(rest)))
                if not block:
                    return
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if begin >= stop:
                        return
                    yield partition.path, begin, line.removesuffix(b"\r").decode("utf-8", errors="replace")
                    begin += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


def _skip(opened) -> int:
    """Bytes up to and with the next line end."""
    n = 0
    while block := opened.read(BLOCK):
        found = block.find(b"\n")
        if found >= 0:
            return n + found + 1
        n += len(block)
    return n


class FileTail(DataSource):
    """``path`` (a file, folder or pattern) and ``bytes`` of its end; read as a stream, the lines that come."""

    @classmethod
    def name(cls) -> str:
        return "file_tail"

    def schema(self) -> str:
        return "path string, size long, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TailReader(self.options["path"], int(self.options.get("bytes", TAIL_BYTES)))


class FileLines(DataSource):
    """``path`` (a file, folder or pattern): (source, seq, line) of each whole line, ``seq`` being the byte at which it begins."""

    @classmethod
    def name(cls) -> str:
        return "file_lines"

    def schema(self) -> str:
        return "source string, seq long, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _LineReader(self.options["path"])


def log_tail(spark: SparkSession, path: str, n_bytes: int = TAIL_BYTES) -> DataFrame:
    """(path, size, text): the last ``n_bytes`` of each text file, without a character that the cut damaged; nothing else of it is read."""
    spark.dataSource.register(FileTail)
    return spark.read.format("file_tail").option("path", path).option("bytes", n_bytes).load()


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (source, seq, line): the lines that are appended to the files, each once it is whole, going on where an earlier run stopped."""
    spark.dataSource.register(FileLines)
    return spark.readStream.format("file_lines").option("path", path).load()
