"""TensorFrame: an n-dimensional array as a DataFrame.

Cells (the working form) have a column i0 … for each axis and v; all cells are
present, in no order.  Dense rows (row_id, value array) have the first axis as
rows and the others flattened, row-major; they are for storage, for exchange
with other frames, and for Arrow kernels.  Frames are immutable: views,
ownership and devices of eager libraries have no counterpart, as operators only
extend the plan.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorframe import types as K

#: A side of a join with at most so many cells (16 bytes or so each) is broadcast.
BROADCAST_CELLS = 200_000


def axes(n: int, prefix: str = "i") -> list[str]:
    return [f"{prefix}{k}" for k in range(n)]


class TensorFrame:
    def __init__(self, df: DataFrame | None, shape: Sequence[int], dtype: str = "f64", rows: DataFrame | None = None, block=None) -> None:
        self.shape = tuple(int(x) for x in shape)
        K.size(self.shape)
        if df is not None and df.columns != [*axes(len(self.shape)), "v"]:
            raise K.ShapeError(f"columns {df.columns} aren't the cells of rank {len(self.shape)}")
        K.spark_type(dtype)
        self._df, self.dtype = df, dtype
        #: Where known: (i0, value array) along the first axis, from which the cells come; a row block; driver data.
        self._rows: DataFrame | None = rows
        self._block = block
        self.local: np.ndarray | None = None
        self._spark: SparkSession | None = None

    @classmethod
    def from_rows(cls, rows: DataFrame, shape: Sequence[int], dtype: str = "f64") -> TensorFrame:
        """Cells of [n, *inner] from (i0, value), which row-wise operators use as it is."""
        return cls(None, shape, dtype, rows)

    @classmethod
    def from_block(cls, block, shape: Sequence[int]) -> TensorFrame:
        """A row block, or a sum over its rows, as a tensor; its plan is made when it is asked for."""
        return cls(None, shape, "f64", block=block)

    @property
    def df(self) -> DataFrame:
        """The cells."""
        if self._df is None:
            if self.local is not None:
                self._df = self._from_local()
            elif self._block is not None and self._block.is_sum:
                cells = blocks.gathered({"": self._block}).select(F.col("at").alias("lin"), "v")
                self._df = TensorFrame.from_linear(cells, self.shape)._df
            elif self.ndim == 1:
                self._df = self.rows.select("i0", F.get("value", F.lit(0)).cast(K.spark_type(self.dtype)).alias("v"))
            else:
                inner = self.shape[1:]
                lin = self.rows.select("i0", F.posexplode("value").alias("lin", "v"))
                index = [(F.expr(f"lin div {s}") % d).cast("long").alias(f"i{k + 1}") for k, (d, s) in enumerate(zip(inner, K.strides(inner), strict=True))]
                self._df = lin.select("i0", *index, F.col("v").cast(K.spark_type(self.dtype)).alias("v"))
        return self._df

    @property
    def rows(self) -> DataFrame | None:
        if self._rows is None and self._block is not None and not self._block.is_sum:
            self._rows = self._block.rows()
        return self._rows

    @property
    def block(self):
        """The row block of doubles with dense rows, or of operators on blocks; else None."""
        if self._block is None and self.local is None and self.ndim and self.shape[0]:
            if self._rows is not None and self.dtype == "f64":
                (self._block,) = blocks.source(self._rows, {"value": ("value", self.shape[1:])})
        return None if self._block is None or self._block.is_sum or not self.shape[0] else self._block

    def numbers(self):
        """The row block of a tensor of rank 1, whose rows are numbers."""
        if self.block is None and self._block is None and self.require(ndim=1).shape[0]:
            (self._block,) = blocks.source(self.df, {"v": ("v", ())})
        return self.block

    @property
    def sums(self):
        """The sum over rows that this tensor is, if it is one."""
        return self._block if self._block is not None and self._block.is_sum else None

    # Inspectors.
    @property
    def spark(self) -> SparkSession:
        if self._spark is not None:
            return self._spark
        return (self._df if self._df is not None else self._rows if self._rows is not None else self._block.base.df).sparkSession

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return K.size(self.shape)

    def is_empty(self) -> bool:
        return self.size == 0

    @property
    def index(self) -> list[str]:
        return axes(self.ndim)

    def __repr__(self) -> str:
        return f"TensorFrame(shape={self.shape}, dtype={self.dtype})"

    def require(self, ndim: int | None = None, dtype: str | None = None) -> TensorFrame:
        """Itself, if it has this rank and element type."""
        if ndim is not None and ndim != self.ndim:
            raise K.ShapeError(f"rank {self.ndim} isn't {ndim}")
        if dtype is not None and dtype != self.dtype:
            raise TypeError(f"element type {self.dtype} isn't {dtype}")
        return self

    def with_df(self, df: DataFrame, shape: Sequence[int] | None = None, dtype: str | None = None) -> TensorFrame:
        return TensorFrame(df, self.shape if shape is None else shape, dtype or self.dtype)

    def hinted(self) -> DataFrame:
        """The cells, to be broadcast in a join if they are few by the shape, and else to be merged.

        The planner may not choose: it goes by the size of the files that cells come from, which exploded rows outgrow.
        """
        return F.broadcast(self.df) if self.size <= BROADCAST_CELLS else self.df.hint("merge")

    @property
    def strides(self) -> tuple[int, ...]:
        """Of the row-major order, in cells."""
        return K.strides(self.shape)

    def is_standard_layout(self) -> bool:
        """Always: cells carry their indices, and rows are flattened row-major."""
        return True

    is_contiguous = is_standard_layout

    def cache(self) -> TensorFrame:
        return self.with_df(self.df.cache())

    def linear(self) -> Column:
        """Row-major place of a cell."""
        out = F.lit(0).cast("long")
        for c, s in zip(self.index, K.strides(self.shape), strict=True):
            out = out + F.col(c) * s
        return out

    # Sources.
    @classmethod
    def from_linear(cls, df: DataFrame, shape: Sequence[int], dtype: str = "f64") -> TensorFrame:
        """Cells from (lin, v)."""
        index = [(F.expr(f"lin div {s}") % d).cast("long") for d, s in zip(shape, K.strides(tuple(shape)), strict=True)]
        return cls(df.select(*[e.alias(f"i{k}") for k, e in enumerate(index)], "v"), shape, dtype)

    @classmethod
    def from_numpy(cls, spark: SparkSession, array: np.ndarray, dtype: str = "f64") -> TensorFrame:
        """Driver data, hence small: parameters and fixtures."""
        a = np.asarray(array)
        if dtype in K.RANGES and a.size and not (K.RANGES[dtype][0] <= a.min() and a.max() <= K.RANGES[dtype][1]):
            raise OverflowError(f"values are outside {dtype}")
        out = cls(None, a.shape, dtype)
        out.local, out._spark = K.rounded_array(a, dtype) if dtype in K.HALVES else a, spark
        return out

    def _from_local(self) -> DataFrame:
        a, dtype = self.local, self.dtype
        flat = a.reshape(-1)
        values = [int(x) for x in flat] if dtype in K.RANGES else [float(x) for x in flat]
        if dtype == "u64":
            values = [Decimal(x) for x in values]
        index = np.indices(a.shape).reshape(a.ndim, -1).T.tolist() if a.ndim else [[]] * len(values)
        schema = T.StructType([*(T.StructField(c, T.LongType(), False) for c in axes(a.ndim)), T.StructField("v", K.spark_type(dtype))])
        return self._spark.createDataFrame([(*i, v) for i, v in zip(index, values, strict=True)], schema)

    @classmethod
    def from_column(cls, df: DataFrame, row_id: str, values: str, shape: Sequence[int], dtype: str = "f64", rows: int | None = None) -> TensorFrame:
        """Cells of [rows, *shape] from a frame with an array for each row; row ids are 0 … rows-1."""
        value = F.col(values) if isinstance(values, str) else values
        if dtype in K.HALVES:
            value = F.transform(value, lambda v: K.rounded(v, dtype))
        n = df.count() if rows is None else rows
        return cls.from_rows(df.select(F.col(row_id).cast("long").alias("i0"), value.cast(T.ArrayType(K.spark_type(dtype))).alias("value")), (n, *shape), dtype)

    @classmethod
    def from_columns(cls, df: DataFrame, row_id: str, columns: dict[str, Sequence[int]], rows: int | None = None) -> list[TensorFrame]:
        """A tensor [rows, *shape] for each column, of arrays or numbers, of one frame: operators on them need no join and one scan."""
        n = df.count() if rows is None else rows
        found = blocks.source(df.select(F.col(row_id).cast("long").alias("i0"), *columns), {c: (c, tuple(shape)) for c, shape in columns.items()})
        return [cls.from_block(b, (n, *shape)) for b, shape in zip(found, columns.values(), strict=True)]

    @classmethod
    def full(cls, spark: SparkSession, shape: Sequence[int], value: float, dtype: str = "f64") -> TensorFrame:
        cells = spark.range(K.size(tuple(shape))).select(F.col("id").alias("lin"), K.rounded(F.lit(value).cast(K.spark_type(dtype)), dtype).alias("v"))
        out = cls.from_linear(cells, shape, dtype)
        if out.size == 1 and dtype == "f64":
            out.local = np.full(out.shape, float(value))
        return out

    @classmethod
    def zeros(cls, spark: SparkSession, shape: Sequence[int], dtype: str = "f64") -> TensorFrame:
        return cls.full(spark, shape, 0, dtype)

    @classmethod
    def ones(cls, spark: SparkSession, shape: Sequence[int], dtype: str = "f64") -> TensorFrame:
        return cls.full(spark, shape, 1, dtype)

    uninit = zeros

    # Sinks.
    def to_numpy(self) -> np.ndarray:
        """All cells at the driver, in order: for small tensors."""
        if self.local is not None and self.dtype in ("f64", "i64"):
            return self.local.astype(float if self.dtype == "f64" else np.int64)
        t = self.df.select(self.linear().alias("lin"), F.col("v").cast("double" if K.is_float(self.dtype) else self.df.schema["v"].dataType)).toArrow()
        lin = t.column("lin").to_numpy()
        if len(lin) != self.size:
            raise K.ShapeError(f"{len(lin)} cells, but {self.shape} has {self.size}")
        out = np.empty(self.size, dtype=t.column("v").to_numpy().dtype)
        out[lin] = t.column("v").to_numpy()
        return out.reshape(self.shape)

    def dense(self, row_id: str = "row_id", value: str = "value") -> DataFrame:
        """Rows along the first axis, the others flattened row-major."""
        if self.rows is not None:
            return self.rows.select(F.col("i0").alias(row_id), F.col("value").alias(value))
        if self.sums is not None and self.ndim == 1:
            return self.df.select(F.col("i0").alias(row_id), F.array("v").alias(value))
        inner = F.lit(0).cast("long")
        for c, s in zip(self.index[1:], K.strides(self.shape)[1:], strict=True):
            inner = inner + F.col(c) * s
        cells = F.sort_array(F.collect_list(F.struct(inner.alias("lin"), "v")))
        return self.df.groupBy(F.col("i0").alias(row_id)).agg(F.transform(cells, lambda x: x["v"]).alias(value))

    def save(self, path: str) -> None:
        """Cells as Parquet, with shape and element type beside them."""
        self.df.write.mode("overwrite").parquet(f"{path}/cells")
        meta = json.dumps({"shape": self.shape, "dtype": self.dtype})
        self.spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TensorFrame:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return cls(spark.read.parquet(f"{path}/cells"), meta["shape"], meta["dtype"])


from tensorframe.operators import blocks  # noqa: E402  operators need TensorFrame
