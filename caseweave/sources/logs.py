"""The end of a log as a data source: read backwards by blocks, whatever the length of the log."""
from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 64 * 1024


def last_lines(f: BinaryIO, size: int, n: int, block: int = BLOCK) -> list[tuple[int, str]]:
    """(offset, line) of the last ``n`` lines of a file, in order; reads no more blocks than hold them."""
    if n <= 0:
        return []
    blocks, start, breaks = [], size, 0
    while start > 0 and breaks <= n:  # one break more than lines: the last line may end with one
        begin = max(0, start - block)
        f.seek(begin)
        blocks.append(f.read(start - begin))
        breaks += blocks[-1].count(b"\n")
        start = begin
    rows, at = [], start
    for i, line in enumerate(b"".join(reversed(blocks)).split(b"\n")):
        if i or start == 0:  # what lies before the first break may be the rest of a line
            rows.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(line) + 1
    if rows and rows[-1][0] == size:  # nothing after the last break
        rows.pop()
    return rows[-n:]


def log_files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The log, or the logs under a folder by name; files whose names begin with a dot or underscore are left out."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    files, root = fs.FileSystem.from_uri(path)
    info = files.get_file_info(root)
    found = [info] if info.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
    return files, sorted((i for i in found if i.is_file and not i.base_name.startswith((".", "_"))), key=lambda i: i.path)


class _TailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.n, self.block = options["path"], int(options.get("lines", 100)), int(options.get("block", BLOCK))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, found = log_files(self.path)
        missing = self.n
        for info in reversed(found):
            if missing <= 0:
                return
            with files.open_input_file(info.path) as f:
                rows = last_lines(f, info.size, missing, self.block)
            missing -= len(rows)
            yield from ((info.path, at, line) for at, line in rows)


class LogTail(DataSource):
    """``spark.read.format("log_tail").option("lines", n).load(path)``: file, offset and line."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, offset bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return _TailReader(self.options)


def read_log_tail(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """line_no (file, offset) and line of the last ``n`` lines of a log or a folder of logs ordered by name."""
    spark.dataSource.register(LogTail)
    d = spark.read.format("log_tail").option("lines", str(n)).load(path)
    return d.select(F.struct("file", "offset").alias("line_no"), "line")
