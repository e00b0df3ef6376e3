"""Elementwise operators: projections, joins on indices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tensorframe import types as K
from tensorframe.frame import TensorFrame
from tensorframe.operators.shape import broadcast


def _convert(v: Column, dtype: str, saturate: bool) -> Column:
    if dtype in K.RANGES and saturate:
        least, most = K.RANGES[dtype]
        v = F.when(F.isnan(v.cast("double")), 0).otherwise(F.when(v < least, least).when(v > most, most).otherwise(v))
    return K.rounded(v.cast(K.spark_type(dtype)), dtype)


def cast(x: TensorFrame, dtype: str, mode: str = "error") -> TensorFrame:
    """Another element type; values outside it raise, or saturate."""
    if mode not in ("error", "saturate"):
        raise ValueError(mode)
    return x.with_df(x.df.withColumn("v", _convert(F.col("v"), dtype, mode == "saturate")), dtype=dtype)


def scaled_cast(x: TensorFrame, alpha: float, dtype: str) -> TensorFrame:
    """alpha times the converted value, in the new type."""
    y = cast(x, dtype)
    return y.with_df(y.df.withColumn("v", K.rounded((F.col("v") * F.lit(alpha)).cast(K.spark_type(dtype)), dtype)))


def zipped(x: TensorFrame, y: TensorFrame, f: Callable[[Column, Column], Column], dtype: str | None = None) -> TensorFrame:
    """f(x, y) with y broadcast to x; repeated axes are simply not joined on."""
    along = K.broadcast_shape(y.shape, x.shape)
    if along is None:
        raise K.ShapeError(f"{y.shape} doesn't broadcast to {x.shape}")
    on = [(k, a) for k, a in enumerate(along) if a is not None]
    right = y.hinted().select(*[F.col(f"i{a}").alias(f"j{k}") for k, a in on], F.col("v").alias("w"))
    condition = F.lit(True)
    for k, _ in on:
        condition = condition & (F.col(f"i{k}") == F.col(f"j{k}"))
    joined = x.df.join(right, condition, "inner") if on else x.df.crossJoin(F.broadcast(right))  # one cell
    return x.with_df(joined.select(*x.index, K.rounded(f(F.col("v"), F.col("w")).cast(K.spark_type(dtype or x.dtype)), dtype or x.dtype).alias("v")), dtype=dtype)


def scaled_add(x: TensorFrame, alpha: float, y: TensorFrame) -> TensorFrame:
    """x + alpha * y, y broadcast to x."""
    if x.local is not None and y.local is not None and x.dtype == y.dtype == "f64" and K.broadcast_shape(y.shape, x.shape) is not None:
        return TensorFrame.from_numpy(x.spark, x.local + alpha * y.local)
    if x.block is not None and y.local is not None and (y.ndim < x.ndim or y.shape[0] == 1) and K.broadcast_shape(y.shape, x.shape) is not None:
        return TensorFrame.from_block(x.block.then("shift", x.shape[1:], None, (alpha * y.local.astype(float),)), x.shape)
    if x.block is not None and y.block is not None and x.shape == y.shape:
        return TensorFrame.from_block(x.block.then("plus", x.shape[1:], float(alpha), other=y.block), x.shape)
    return zipped(x, y, lambda a, b: a + b * F.lit(alpha))


def add_assign(x: TensorFrame, y: TensorFrame) -> TensorFrame:
    return scaled_add(x, 1.0, y) if K.is_float(x.dtype) else zipped(x, y, lambda a, b: a + b)


def scaled(x: TensorFrame, by: TensorFrame) -> TensorFrame:
    """x times the one number of another tensor."""
    if x.block is not None and by.local is not None:
        return TensorFrame.from_block(x.block.then("scale", x.shape[1:], float(by.local.reshape(()))), x.shape)
    return zipped(x, by, lambda a, b: a * b)


def assign(x: TensorFrame, y: TensorFrame) -> TensorFrame:
    """y broadcast to x's shape, in x's type."""
    return cast(broadcast(y, x.shape), x.dtype)


_BINARY = {"identity": lambda a, y: a, "add": lambda a, y: a + y, "sub": lambda a, y: a - y, "mul": lambda a, y: a * y, "div": lambda a, y: a / y}


def binary(op: str, alpha: float, x: TensorFrame, y: TensorFrame) -> TensorFrame:
    """(alpha * x) op y, over y's shape; identity is alpha * x."""
    return zipped(y, x, lambda old, new: _BINARY[op](new * F.lit(alpha), old))


def fill(x: TensorFrame, value: float) -> TensorFrame:
    return x.with_df(x.df.withColumn("v", K.rounded(F.lit(value).cast(K.spark_type(x.dtype)), x.dtype)))


def one_hot(labels: TensorFrame, classes: int, dtype: str = "f64") -> TensorFrame:
    """[.., classes], 1 at the label; a label outside the classes raises."""
    label = F.when((F.col("v") >= 0) & (F.col("v") < classes), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("no such class: "), F.col("v").cast("string"))).cast("long"))
    df = labels.df.withColumn("_label", label).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(classes - 1).cast("long"))))
    return TensorFrame(df.select(*labels.index, F.col("_c").alias(f"i{labels.ndim}"), (F.col("_c") == F.col("_label")).cast("int").cast(K.spark_type(dtype)).alias("v")), (*labels.shape, classes), dtype)


def _passes(v: Column) -> Column:
    """v >= 0 as floats compare: never for NaN, which Spark sorts last."""
    return (v >= 0) & ~F.isnan(v)


def relu(x: TensorFrame) -> TensorFrame:
    """x where x >= 0, else 0; NaN gives 0."""
    if x.block is not None:
        return TensorFrame.from_block(x.block.then("relu", x.shape[1:]), x.shape)
    return x.with_df(x.df.withColumn("v", F.when(_passes(F.col("v")), F.col("v")).otherwise(F.lit(0)).cast(K.spark_type(x.dtype))))


def relu_backward(x: TensorFrame, dy: TensorFrame) -> TensorFrame:
    """dy where x >= 0 (at 0 too), else 0."""
    if x.block is not None and dy.block is not None and x.shape == dy.shape:
        return TensorFrame.from_block(x.block.then("relu_back", x.shape[1:], other=dy.block), x.shape)
    return zipped(x, dy, lambda a, d: F.when(_passes(a), d).otherwise(F.lit(0)))


__all__ = ["add_assign", "assign", "binary", "cast", "fill", "one_hot", "relu", "relu_backward", "scaled", "scaled_add", "scaled_cast", "zipped"]
