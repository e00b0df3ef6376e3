"""IDX files (plain or gzip) of digit images and labels, decoded on the executors."""

from __future__ import annotations

import gzip
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorframe.sources.idx_source import header, local_path, read_split

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this library
IMAGES, LABELS = 2051, 2049
_FILES = {"train": ("train-images-idx3-ubyte", "train-labels-idx1-ubyte"), "test": ("t10k-images-idx3-ubyte", "t10k-labels-idx1-ubyte")}


def decode(content: bytes) -> np.ndarray:
    """[n, h, w] or [n] of bytes; magic number, sizes and length are checked."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    if len(data) < 8:
        raise ValueError("an IDX file is cut short")
    magic, n = struct.unpack(">ii", data[:8])
    if magic not in (IMAGES, LABELS):
        raise ValueError(f"{magic} isn't the magic number of images or labels")
    shape = (n, *struct.unpack(">ii", data[8:16])) if magic == IMAGES else (n,)
    body = data[16 if magic == IMAGES else 8 :]
    if len(body) != int(np.prod(shape)):
        raise ValueError(f"{len(body)} bytes of data, but {shape} has {int(np.prod(shape))}")
    return np.frombuffer(body, np.uint8).reshape(shape)


def read_idx(spark: SparkSession, path: str, shape: tuple[int, int] | None = None) -> DataFrame:
    """row_id, value array<smallint> of one file; labels have arrays of one.  Images of another shape than asked for raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                a = decode(content.as_py())
                if shape is not None and a.ndim == 3 and a.shape[1:] != shape:
                    raise ValueError(f"images of {a.shape[1:]} aren't {shape}")
                for at in range(0, len(a), 4096):
                    part = a[at : at + 4096].reshape(len(a[at : at + 4096]), -1).astype(np.int16)
                    ends = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.ListArray.from_arrays(pa.array(ends), pa.array(part.reshape(-1)))], names=["row_id", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row_id long, value array<smallint>")


def digits(spark: SparkSession, folder: str, split: str = "train", suffix: str = ".gz", shape: tuple[int, int] = (28, 28)) -> DataFrame:
    """row_id, split, value array<smallint>, label of a folder with the four files of a digits data set."""
    paths = [f"{folder}/{name}{suffix}" for name in _FILES[split]]
    if not suffix and all(local_path(p) for p in paths):  # plain files are read by ranges
        if (found := header(local_path(paths[0]))[1][1:]) != shape:
            raise ValueError(f"images of {found} aren't {shape}")
        images, labels = (read_split(spark, p) for p in paths)
    else:
        images, labels = (read_idx(spark, p, shape) for p in paths)
    return images.join(labels.select("row_id", F.get("value", F.lit(0)).alias("label")), "row_id").select("row_id", F.lit(split).alias("split"), "value", "label")
