"""IDX files as a data source: read and written by many tasks at a time.

An IDX file is a header and records of one length, so a byte range of whole
records is a partition, and a row's place in the file follows from its number:
a writer's tasks put their records where they belong, in one file, and a
repeated task writes the same bytes again.  Both need a path that executors can
open as a file, as shared folders are; other paths, and gzip, which can't be
split, are read whole by read_idx().
"""

from __future__ import annotations

import os
import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this library
#: Fixed values of the format.
IMAGES, LABELS = 2051, 2049
SPLIT = 64 << 20
RECORDS = 4096


def local_path(path: str) -> str | None:
    """The path as open() takes it, if it may."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if "://" not in path else None


def header(path: str) -> tuple[int, tuple[int, ...]]:
    """Offset of the records, and (n, h, w) or (n,); magic number, sizes and length are checked."""
    with open(path, "rb") as f:
        start = f.read(16)
    magic, n = struct.unpack(">ii", start[:8]) if len(start) >= 8 else (0, 0)
    if magic not in (IMAGES, LABELS) or magic == IMAGES and len(start) < 16:
        raise ValueError(f"{path} doesn't start as an IDX file of images or labels")
    offset, shape = (16, (n, *struct.unpack(">ii", start[8:16]))) if magic == IMAGES else (8, (n,))
    if os.path.getsize(path) != offset + prod(shape):
        raise ValueError(f"{os.path.getsize(path) - offset} bytes of data, but {shape} has {prod(shape)}")
    return offset, shape


@dataclass
class Records(InputPartition):
    """Records first … end-1."""

    first: int
    end: int


class IdxReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split
        self.offset, self.shape = header(path)
        self.length = prod(self.shape[1:])

    def partitions(self) -> list[Records]:
        each = max(1, self.split // max(self.length, 1))
        return [Records(k, min(k + each, self.shape[0])) for k in range(0, self.shape[0], each)] or [Records(0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            f.seek(self.offset + partition.first * self.length)
            for at in range(partition.first, partition.end, RECORDS):
                n = min(RECORDS, partition.end - at)
                data = f.read(n * self.length)
                if len(data) != n * self.length:
                    raise ValueError(f"{self.path} is cut short")
                values = pa.array(np.frombuffer(data, np.uint8).astype(np.int16))
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * self.length)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(ends, values)], names=["row_id", "value"])


class IdxWriter(DataSourceArrowWriter):
    def __init__(self, path: str, shape: tuple[int, ...]) -> None:
        self.path, self.shape = path, shape
        start = struct.pack(">ii", IMAGES if len(shape) == 3 else LABELS, shape[0]) + b"".join(struct.pack(">i", x) for x in shape[1:])
        self.offset, self.length = len(start), prod(shape[1:])
        # On the driver, before any task: a file of the whole length.
        with open(path, "wb") as f:
            f.write(start)
            f.truncate(self.offset + prod(shape))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        seen = 0
        with open(self.path, "r+b") as f:
            for b in batches:
                ids = b.column(0).to_numpy()
                values = b.column(1).flatten().to_numpy()
                if len(values) != len(ids) * self.length or len(ids) and not (0 <= values.min() and values.max() <= 255):
                    raise ValueError(f"records aren't {self.length} bytes each")
                if len(ids) and not (0 <= ids.min() and ids.max() < self.shape[0]):
                    raise ValueError(f"row ids aren't 0 … {self.shape[0] - 1}")
                data = values.astype(np.uint8).reshape(len(ids), self.length)
                order = np.argsort(ids, kind="stable")
                cuts = np.flatnonzero(np.diff(ids[order]) != 1) + 1
                for run in np.split(order, cuts):  # neighbours at once
                    if len(run):
                        f.seek(self.offset + int(ids[run[0]]) * self.length)
                        f.write(data[run].tobytes())
                seen += len(ids)
        return Written(seen)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        found = sum(m.records for m in messages if m is not None)
        if found != self.shape[0]:
            os.remove(self.path)
            raise ValueError(f"{found} records were written, but there are to be {self.shape[0]}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)


@dataclass
class Written(WriterCommitMessage):
    records: int


class IdxSource(DataSource):
    """Options: path; to read, split (bytes of a partition); to write, shape (n,h,w or n)."""

    @classmethod
    def name(cls) -> str:
        return "idx"

    def schema(self) -> str:
        return "row_id bigint, value array<smallint>"

    def reader(self, schema) -> IdxReader:
        return IdxReader(self._path(), int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> IdxWriter:
        return IdxWriter(self._path(), tuple(int(x) for x in self.options["shape"].split(",")))

    def _path(self) -> str:
        path = local_path(self.options["path"])
        if path is None:
            raise ValueError(f"{self.options['path']} can't be opened as a file")
        return path


def read_split(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """row_id, value of a plain IDX file, a partition for each range of bytes."""
    spark.dataSource.register(IdxSource)
    return spark.read.format("idx").option("split", split).load(path)


def write_idx(rows: DataFrame, path: str, shape: tuple[int, ...], row_id: str = "row_id", value: str = "value") -> None:
    """One IDX file of arrays of bytes by dense row ids: images for (n, h, w), labels for (n,)."""
    spark = rows.sparkSession
    spark.dataSource.register(IdxSource)
    out = rows.selectExpr(f"CAST(`{row_id}` AS BIGINT) AS row_id", f"CAST(`{value}` AS ARRAY<SMALLINT>) AS value")
    out.write.format("idx").mode("append").option("shape", ",".join(map(str, shape))).save(path)
