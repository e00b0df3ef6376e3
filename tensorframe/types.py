"""Element types and shape arithmetic."""

from __future__ import annotations

from math import prod

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark has no unsigned or 16-bit float types: those widen, with a range check at ingest, and are rounded.
DTYPES: dict[str, T.DataType] = {
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f16": T.FloatType(), "bf16": T.FloatType(), "f32": T.FloatType(), "f64": T.DoubleType(),
}
#: Least and greatest values of the integer types.
RANGES = {f"i{b}": (-(2 ** (b - 1)), 2 ** (b - 1) - 1) for b in (8, 16, 32, 64)} | {f"u{b}": (0, 2**b - 1) for b in (8, 16, 32, 64)}
MOST_ELEMENTS = 2**63 - 1


class ShapeError(ValueError):
    """Shapes that don't fit an operator."""


def spark_type(dtype: str) -> T.DataType:
    if dtype not in DTYPES:
        raise TypeError(f"no element type {dtype!r}; there are {', '.join(DTYPES)}")
    return DTYPES[dtype]


def is_float(dtype: str) -> bool:
    return dtype in ("f16", "bf16", "f32", "f64")


#: Of 16-bit floats: bits after the point, least exponent of a normal number, greatest finite number.
HALVES = {"f16": (10, -14, 65504.0), "bf16": (7, -126, float(2**127 * (2 - 2**-7)))}


def rounded(v: Column, dtype: str) -> Column:
    """v, for 16-bit floats rounded to the nearest that the type has, ties to even, as the widened type."""
    if dtype not in HALVES:
        return v
    bits, least, most = HALVES[dtype]
    x = v.cast("double")
    exponent = F.greatest(F.floor(F.log2(F.abs(x))).cast("int"), F.lit(least))
    unit = F.pow(F.lit(2.0), exponent - bits)
    near = F.rint(x / unit) * unit
    kept = F.isnan(x) | (x == 0) | (F.abs(x) == float("inf"))
    return F.when(kept, x).when(F.abs(near) > most, F.signum(x) * float("inf")).otherwise(near).cast(spark_type(dtype))


def rounded_array(a: np.ndarray, dtype: str) -> np.ndarray:
    """rounded() of an array, as 32-bit floats."""
    a = np.asarray(a, np.float32)
    if dtype == "f16":
        with np.errstate(over="ignore"):
            return a.astype(np.float16).astype(np.float32)
    if dtype != "bf16":
        return a
    bits = a.view(np.uint32)
    near = (bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))) & np.uint32(0xFFFF0000)
    return np.where(np.isnan(a), a, near.view(np.float32))


def size(shape: tuple[int, ...]) -> int:
    n = prod(shape)
    if n > MOST_ELEMENTS:
        raise ShapeError(f"{shape} has too many elements")
    return n


def strides(shape: tuple[int, ...]) -> tuple[int, ...]:
    """Of the row-major order."""
    return tuple(prod(shape[k + 1 :]) for k in range(len(shape)))


def broadcast_shape(shape: tuple[int, ...], to: tuple[int, ...]) -> tuple[int | None, ...] | None:
    """For each axis of `to`, the axis of shape that it runs along, None where it repeats; None if impossible."""
    if len(to) < len(shape):
        return None
    out: list[int | None] = [None] * (len(to) - len(shape))
    for k, (a, b) in enumerate(zip(shape, to[len(to) - len(shape) :], strict=True)):
        if a != b and a != 1:
            return None
        out.append(k if a == b else None)
    return tuple(out)


def conv_output(size: int, kernel: int, padding: int = 0, stride: int = 1, dilation: int = 1) -> int | None:
    """(a + 2p - d(f-1) - 1) / s + 1; None if nothing is left."""
    span = size + 2 * padding - dilation * (kernel - 1) - 1
    return span // stride + 1 if span >= 0 else None


def conv_input(size: int, kernel: int, padding: int = 0, stride: int = 1, dilation: int = 1) -> int:
    """The input length that gives this output length."""
    return dilation * (kernel - 1) + 1 + stride * (size - 1) - 2 * padding


def conv_shape(shape: tuple[int, ...], kernel, padding, stride, dilation) -> tuple[int, ...]:
    out = tuple(conv_output(*x) for x in zip(shape, kernel, padding, stride, dilation, strict=True))
    if any(x is None or x < 1 for x in out):
        raise ShapeError(f"a filter of {kernel} doesn't fit {shape}")
    return out  # type: ignore[return-value]


def pair(x, n: int = 2) -> tuple[int, ...]:
    return (x,) * n if isinstance(x, int) else tuple(x)
