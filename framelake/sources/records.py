"""A data source of fixed-size records: a file of any length is read in byte ranges by many tasks.

    spark.dataSource.register(RecordSource)
    spark.read.format("fixed_records").option("path", "a.yuv").option("record_size", 384).load()

Files are opened by pyarrow's file systems (local, object stores, HDFS). The last record of a file may be short.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, record long, data binary"
#: Bytes that one task reads, and bytes that it holds at once.
SPLIT_BYTES, BATCH_BYTES = 128 << 20, 8 << 20


def _opened(uri: str):
    """File system and path of a path or URI (Spark writes ``file:/x`` for ``file:///x``)."""
    from pyarrow import fs

    if uri.startswith("file:/"):  # names are as they are, not escaped
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


@dataclass
class Range(InputPartition):
    """Records ``first`` to ``first + count`` of a file."""

    file: str
    first: int
    count: int


class RecordReader(DataSourceReader):
    def __init__(self, paths: list[str], size: int, split: int, overlap: int = 0) -> None:
        if size <= 0:
            raise ValueError("record_size must be positive")
        self.paths, self.size, self.split, self.overlap = paths, size, max(1, split // size), overlap

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        found = []
        for given in self.paths:
            system, path = _opened(given)
            info = system.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(given)
            files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file]
            prefix = given.removesuffix(path) if info.is_file else given.rstrip("/")[: len(given.rstrip("/")) - len(path.rstrip("/"))]
            for f in sorted(files, key=lambda f: f.path):
                n = -(-f.size // self.size)
                found += [Range(prefix + f.path, first, min(self.split, n - first)) for first in range(0, n, self.split)]
        return found

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, path = _opened(part.file)
        step = max(1, BATCH_BYTES // (self.size + self.overlap))
        with system.open_input_file(path) as f:
            for first in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - first)
                f.seek(first * self.size)
                raw = f.read(n * self.size + self.overlap)
                data = [raw[k * self.size : (k + 1) * self.size + self.overlap] for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * n), pa.array(range(first, first + n), pa.int64()), pa.array(data, pa.binary())], names=["file", "record", "data"])


class RecordSource(DataSource):
    """Options: ``path`` (a file or a folder) or ``paths`` (a JSON list of them), ``record_size``, ``split_bytes``,
    ``overlap``: further bytes behind a record that are read with it."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return RecordReader(paths, int(self.options["record_size"]), int(self.options.get("split_bytes", SPLIT_BYTES)), int(self.options.get("overlap", 0)))
