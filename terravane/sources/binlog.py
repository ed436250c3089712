"""A change log in numbered files of JSON lines as a Spark source, read by (file, position).

Files are named so that their names order them; lines are appended to the last
one. A batch is a range of bytes of each file; a position is never inside a
line. Files may lie in any store that Arrow's file systems reach.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, pos long, table_name string, event_type string, before_json string, after_json string, ts string"
#: Bytes of a file that one task reads.
PART = 32 << 20


def _open(path: str):
    return stores.FileSystem.from_uri(path) if "://" in path else (stores.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(name, length) of the log files, in their order."""
    fs, root = _open(path)
    found = fs.get_file_info(stores.FileSelector(root, recursive=True))
    named = [(f.path[len(root) :].lstrip("/"), f.size) for f in found if f.type == stores.FileType.File]
    return sorted((n, s) for n, s in named if not n.rpartition("/")[2].startswith((".", "_")))


@dataclass
class Range(InputPartition):
    """The lines of a file that begin from ``start`` on and before ``end``."""

    file: str
    start: int
    end: int


def ranges(path: str, after: tuple[str, int], to: tuple[str, int], part: int = PART) -> list[Range]:
    """Ranges of all that lies behind the position ``after``, up to ``to``."""
    out = []
    for name, size in files(path):
        first = after[1] if name == after[0] else 0
        last = to[1] if name == to[0] else size
        if name < after[0] or name > to[0]:
            continue
        out += [Range(name, at, min(at + part, last)) for at in range(first, last, part)]
    return out


def lines(path: str, part: Range) -> Iterator[tuple]:
    """Rows of SCHEMA, ``pos`` behind each line; lines that are not yet whole, or no JSON objects, are left out."""
    fs, root = _open(path)
    with io.BufferedReader(fs.open_input_file(f"{root}/{part.file}"), 1 << 20) as f:
        at = part.start
        if at:
            # a line belongs to the range that it begins in
            f.seek(at - 1)
            at += len(f.readline()) - 1
            f.seek(at)
        while at < part.end:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            at += len(line)
            try:
                row = json.loads(line)
            except ValueError:
                continue
            if isinstance(row, dict):
                image = lambda k, row=row: None if row.get(k) is None else json.dumps(row[k], ensure_ascii=False)
                yield part.file, at, row.get("table"), row.get("type"), image("before"), image("after"), row.get("ts")


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        found = files(self.path)
        return ranges(self.path, ("", 0), found[-1]) if found else []

    def read(self, partition):
        return lines(self.path, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are {"file", "pos"}; the start can be given, to go on from a stored position."""

    def __init__(self, path: str, file: str, pos: int) -> None:
        self.path, self.first = path, {"file": file, "pos": pos}

    def initialOffset(self):
        return self.first

    def latestOffset(self):
        found = files(self.path)
        if not found:
            return self.first
        fs, root = _open(self.path)
        name, size = found[-1]
        # up to the end of the last whole line
        with fs.open_input_file(f"{root}/{name}") as f:
            back = min(size, 1 << 16)
            while True:
                f.seek(size - back)
                cut = f.read(back).rfind(b"\n")
                if cut >= 0 or back == size:
                    return {"file": name, "pos": size - back + cut + 1}
                back = min(size, back * 2)

    def partitions(self, start, end):
        return ranges(self.path, (start["file"], start["pos"]), (end["file"], end["pos"]))

    def read(self, partition):
        return lines(self.path, partition)

    def commit(self, end):
        pass


class BinlogSource(DataSource):
    """Format ``binlog_files``; options path, and file and pos to start a stream behind a position."""

    @classmethod
    def name(cls):
        return "binlog_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def streamReader(self, schema):
        return _StreamReader(self.options["path"], self.options.get("file", ""), int(self.options.get("pos", 0)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The whole log."""
    spark.dataSource.register(BinlogSource)
    return spark.read.format("binlog_files").option("path", path).load()


def stream(spark: SparkSession, path: str, file: str = "", pos: int = 0) -> DataFrame:
    """The log as a stream, from behind a position on."""
    spark.dataSource.register(BinlogSource)
    return spark.readStream.format("binlog_files").option("path", path).option("file", file).option("pos", str(pos)).load()
