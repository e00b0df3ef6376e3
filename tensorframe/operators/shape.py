"""Shape operators: renamed or recomputed index columns."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import functions as F

from tensorframe import types as K
from tensorframe.frame import TensorFrame
from tensorframe.operators import blocks


def reshape(x: TensorFrame, shape: Sequence[int], order: str = "C") -> TensorFrame:
    """Same cells, counted in row-major (C) or column-major (F) order, under another shape."""
    shape = tuple(shape)
    if prod(shape) != x.size:
        raise K.ShapeError(f"{x.shape} doesn't reshape to {shape}")
    if order == "F":
        return reverse_axes(reshape(reverse_axes(x), shape[::-1]))
    if x.sums is not None:
        return TensorFrame.from_block(x.sums, shape)
    if x.ndim > 1 and x.block is not None and shape and shape[0] == x.shape[0]:
        return TensorFrame.from_block(x.block.then("reshape", shape[1:], shape[1:]), shape)
    if x.local is not None:
        return TensorFrame.from_numpy(x.spark, x.local.reshape(shape), x.dtype)
    return TensorFrame.from_linear(x.df.select(x.linear().alias("lin"), "v"), shape, x.dtype)


def flatten(x: TensorFrame) -> TensorFrame:
    """[d0, d1·…·dn]; rank 0 becomes [1, 1]."""
    return reshape(x, (x.shape[0], prod(x.shape[1:])) if x.ndim else (1, 1))


def permute(x: TensorFrame, order: Sequence[int]) -> TensorFrame:
    if sorted(order) != list(range(x.ndim)):
        raise K.ShapeError(f"{tuple(order)} isn't a permutation of {x.ndim} axes")
    return x.with_df(x.df.select(*[F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(order)], "v"), [x.shape[a] for a in order])


def reverse_axes(x: TensorFrame) -> TensorFrame:
    return permute(x, range(x.ndim)[::-1])


transpose = reverse_axes


def broadcast(x: TensorFrame, shape: Sequence[int]) -> TensorFrame:
    """Repeat along new axes (aligned at the last) and axes of length 1."""
    shape = tuple(shape)
    along = K.broadcast_shape(x.shape, shape)
    if along is None:
        raise K.ShapeError(f"{x.shape} doesn't broadcast to {shape}")
    df = x.df.select(*[F.col(f"i{a}").alias(f"n{k}") for k, a in enumerate(along) if a is not None], "v")
    for k, a in enumerate(along):
        if a is None:
            df = df.withColumn(f"n{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shape[k] - 1).cast("long")))) if shape[k] else df.withColumn(f"n{k}", F.lit(0).cast("long")).filter("false")
    return x.with_df(df.select(*[F.col(f"n{k}").alias(f"i{k}") for k in range(len(shape))], "v"), shape)


def broadcast_backward(dy: TensorFrame, shape: Sequence[int]) -> TensorFrame:
    """The gradient of broadcast from shape: sums over every axis that was repeated."""
    from tensorframe.operators.reduce import sum_axes

    shape = tuple(shape)
    along = K.broadcast_shape(shape, dy.shape)
    if along is None:
        raise K.ShapeError(f"{shape} doesn't broadcast to {dy.shape}")
    over = [k for k, a in enumerate(along) if a is None]
    if dy.block is not None and 0 in over:
        return TensorFrame.from_block(blocks.total(dy.block, over[1:]), shape)
    return reshape(sum_axes(dy, over), shape)


def _checked(x: TensorFrame, axis: int, at: int) -> None:
    if not 0 <= axis < x.ndim or not 0 <= at < x.shape[axis]:
        raise IndexError(f"no index {at} along axis {axis} of {x.shape}")


def index_axis(x: TensorFrame, axis: int, at: int) -> TensorFrame:
    """The cells at one index; the axis goes."""
    _checked(x, axis, at)
    kept = [k for k in range(x.ndim) if k != axis]
    return x.with_df(x.df.filter(F.col(f"i{axis}") == at).select(*[F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(kept)], "v"), [x.shape[a] for a in kept])


def collapse_axis(x: TensorFrame, axis: int, at: int) -> TensorFrame:
    """The cells at one index; the axis stays with length 1."""
    _checked(x, axis, at)
    return x.with_df(x.df.filter(F.col(f"i{axis}") == at).withColumn(f"i{axis}", F.lit(0).cast("long")), [1 if k == axis else d for k, d in enumerate(x.shape)])


def standard_layout(x: TensorFrame) -> TensorFrame:
    """Cells have no layout: itself."""
    return x
