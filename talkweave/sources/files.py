"""Corpus files as a Spark data source: ``spark.read.format("corpus_files")`` reads every file of a folder by its suffix.

Spark's own file sources leave out names that start with ``_`` without a word and give a line no place in its file.  Here only names that
start with a dot and ``readme.md`` are left out, folders are searched to any depth, and a row holds its file and its byte offset there.

With ``whole`` a row is a file, and small files share a task; else a row is a line, and a file is cut into ranges of ``range_bytes``: a line
belongs to the range in which it starts, so ranges need not know of each other and a retried task reads the same rows.  The driver lists names
and sizes only.  Files are opened through Arrow (local paths and what its file systems know: ``hdfs``, ``s3``, ``gs``).

Defined cases: an empty folder or file has no rows (an empty whole file is one row with an empty text); the last line needs no line end; ``\\r\\n``
ends a line too; bytes that are not UTF-8 become the replacement character.
"""
from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20          # of text in a batch that goes to the JVM; a longer row is a batch of its own
COLUMNS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("raw", pa.string())])


@dataclass
class Ranges(InputPartition):
    """Byte ranges (path, start, end) that one task reads."""
    parts: list[tuple[str, int, int]]


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(path: str, suffixes: set[str]) -> list[tuple[str, int]]:
    """(path, bytes) of the corpus files below a folder, by name; a path that is a file is taken whatever its name is."""
    system, root = file_system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [
        f for f in system.get_file_info(fs.FileSelector(root, recursive=True))
        if f.type == fs.FileType.File and not f.base_name.startswith(".") and f.base_name.lower() != "readme.md"
        and f.extension.lower() in suffixes]
    return sorted((f.path, f.size) for f in found)


def lines_of(f: io.BufferedReader, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that start in [start, end)."""
    at = start
    if start:
        f.seek(start - 1)
        at += len(f.readline()) - 1           # a line that starts before the range is the business of the range before
    while at < end:
        line = f.readline()
        if not line:
            return
        yield at, line.removesuffix(b"\n").removesuffix(b"\r")
        at += len(line)


class FileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffixes = set(options.get("suffixes", "").split(","))
        self.whole = options.get("whole", "false") == "true"
        self.most = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        if self.whole:
            groups, have = [[]], 0
            for p, n in listed(self.path, self.suffixes):
                if groups[-1] and have + n > self.most:
                    groups.append([])
                    have = 0
                groups[-1].append((p, 0, n))
                have += n
        else:
            groups = [[(p, s, min(n, s + self.most))] for p, n in listed(self.path, self.suffixes) for s in range(0, n, self.most)]
        return [Ranges(g) for g in groups or [[]]]

    def _rows(self, partition: Ranges) -> Iterator[tuple[str, int, bytes]]:
        system, _ = file_system(self.path)
        for path, start, end in partition.parts:
            with system.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 20) as f:
                if self.whole:
                    yield path, 0, f.read()
                else:
                    yield from ((path, at, line) for at, line in lines_of(f, start, end))

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, at, text in self._rows(partition):
            rows.append((path, at, text.decode("utf-8", "replace")))
            size += len(text)
            if size >= BATCH_BYTES or len(rows) == 4096:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), COLUMNS)], schema=COLUMNS)


class CorpusFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_files"

    def schema(self) -> str:
        return "path string, offset long, raw string"

    def reader(self, schema) -> FileReader:
        return FileReader(dict(self.options))


def read_files(spark: SparkSession, path: str, *suffixes: str, whole: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offset, raw) of the files with one of the suffixes (in any case): whole files, or their lines."""
    spark.dataSource.register(CorpusFiles)
    return (spark.read.format("corpus_files").option("suffixes", ",".join(suffixes)).option("whole", str(whole).lower())
            .option("range_bytes", range_bytes).load(path))
