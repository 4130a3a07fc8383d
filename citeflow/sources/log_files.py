"""The newest lines of log files, read from their ends.

A Python data source; a partition is one file, or several of many. A task reads blocks from the end backwards and stops at the last line
it needs, so what it reads does not grow with the file.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from citeflow.settings import LOG_TAIL_ROWS

BLOCK_BYTES = 64 * 1024
FILES_A_TASK, TASKS = 256, 64  # at most so many files a task, if there are as many tasks
SCHEMA = "path string, from_end int, value string"


def tail_lines(file, size: int, limit: int, block: int = BLOCK_BYTES):
    """``(number from the end, line)`` of the last ``limit`` lines that are not blank, newest first, and the bytes read.

    Lines are cut at line feeds as bytes, so no character is ever split, wherever a block begins. Bytes that are no
    UTF-8 come as replacement characters.
    """
    found: list[str] = []
    rest: list[bytes] = []  # what was read of the line that goes on before the block, newest part first
    at, read = size, 0
    while at > 0 and len(found) < limit:
        begin = max(0, at - block)
        file.seek(begin)
        data = file.read(at - begin)
        read += len(data)
        at = begin
        first, *lines = data.split(b"\n")
        for line in reversed(lines):
            whole = line + b"".join(reversed(rest))
            rest = []
            if whole.strip(b" ") and len(found) < limit:
                found.append(whole.decode(errors="replace"))
        rest.append(first)
    if at == 0 and len(found) < limit:
        whole = b"".join(reversed(rest))
        if whole.strip(b" "):
            found.append(whole.decode(errors="replace"))
    return [(i, line) for i, line in enumerate(found, 1)], read


def files_a_task(files: int) -> int:
    """Few files are read in a task each. A task has a price of its own, so of many files each task reads several."""
    return max(1, min(FILES_A_TASK, files // TASKS))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("limit", LOG_TAIL_ROWS))
        self.block = int(options.get("block", BLOCK_BYTES))

    def partitions(self):
        files, root = fs.FileSystem.from_uri(self.path)
        scheme = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        info = files.get_file_info(root)
        if info.type == fs.FileType.File:
            return [_Files([self.path])]
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        logs = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        paths = sorted(scheme + f.path for f in logs)
        step = files_a_task(len(paths))
        return [_Files(paths[i : i + step]) for i in range(0, len(paths), step)]

    def read(self, partition):
        if partition is None:
            return
        for uri in partition.paths:
            files, path = fs.FileSystem.from_uri(uri)
            with files.open_input_file(path) as file:
                lines, _ = tail_lines(file, file.size(), self.limit, self.block)
            for number, line in lines:
                yield (uri, number, line)


class LogTail(DataSource):
    """``spark.read.format("log_tail").option("limit", 300).load(path)``; ``path`` is a file or a folder."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def log_file_tail(spark: SparkSession, path: str, limit: int = LOG_TAIL_ROWS) -> DataFrame:
    """``(path, from_end, value)``: the last ``limit`` lines that are not blank of every file under ``path``, 1 the newest.

    The path is named with its file system before tasks see it, so all of them read the same one.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = files.makeQualified(folder).toString()
    uri = f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri
    spark.dataSource.register(LogTail)
    return spark.read.format("log_tail").option("limit", limit).load(uri)
