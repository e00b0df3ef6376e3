"""Sums: hash aggregates.  Integers add up in 64 bits, floats in doubles; results keep the wide type.

Sums of doubles depend on their order, hence on how rows are dealt out.  Exact
ones don't: a number is cut at fixed places of the binary exponent, LIMB bits
apart, into whole numbers, which are added up as such, by place; the whole is
rounded once, at the end.  Partial sums merge without rounding, so any
partitioning, and any rerun, gives equal bits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorframe import types as K
from tensorframe.frame import TensorFrame, axes


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this library

#: Bits between cuts: 2^37 numbers can be added up in 64 bits.
LIMB = 26
#: Limbs that the 53 bits of a double can reach over, and one for a logarithm that is one off.
LIMBS = 4


def _wide(dtype: str) -> str:
    return "f64" if K.is_float(dtype) else "u64" if dtype == "u64" else "i64"


def _with_out(total: TensorFrame, beta: float, out: TensorFrame | None) -> TensorFrame:
    from tensorframe.operators.elementwise import zipped

    if out is None or beta == 0:
        return total
    if out.shape != total.shape:
        raise K.ShapeError(f"{out.shape} isn't {total.shape}")
    return zipped(total, out, lambda s, o: s + o * F.lit(beta))


def exact_sums(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, v): the correctly rounded sum of v, a double, by keys; NaN and infinities as floats add them."""
    odd = F.isnan("v") | (F.abs("v") == float("inf"))
    # Places from the exponent down; each cut is exact, as are products with powers of two in the range of doubles.
    df = df.select(*keys, F.when(odd, F.col("v")).alias("odd"), F.when(odd, 0.0).otherwise(F.col("v")).alias("rest"))
    top = F.when(F.col("rest") == 0, 0).otherwise(F.floor(F.log2(F.abs("rest")) / LIMB)).cast("int")
    df = df.withColumn("top", top)
    for k in range(LIMBS):
        # In two steps, as a power of two may be beyond the range where its product is not.
        half = ((F.col("top") - k) * LIMB / 2).cast("int")
        other = (F.col("top") - k) * LIMB - half
        scaled = F.col("rest") * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), -other)
        whole = F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("long")
        df = df.withColumn(f"q{k}", whole).withColumn("rest", F.col("rest") - F.col(f"q{k}").cast("double") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), other))
    limbs = F.filter(F.array(*[F.struct((F.col("top") - k).alias("place"), F.col(f"q{k}").alias("q")) for k in range(LIMBS)]), lambda x: x["q"] != 0)
    parts = df.select(*keys, "odd", F.explode_outer(limbs).alias("x")).select(*keys, "odd", "x.*")
    # A number with several limbs has several rows, of which the first alone has what is odd about it: odd ones have none.
    sums = parts.groupBy(*keys, "place").agg(F.sum("q").alias("q"), F.sum("odd").alias("odd"))
    whole = sums.groupBy(*keys).agg(F.collect_list(F.when(F.col("q").isNotNull(), F.struct("place", "q"))).alias("limbs"), F.sum("odd").alias("odd"))

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for limbs, odd in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low = min((x["place"] for x in limbs), default=0)
                total = sum(x["q"] << LIMB * (x["place"] - low) for x in limbs)
                try:
                    v = odd if odd is not None else total * 2 ** (LIMB * low) if low >= 0 else total / 2 ** (-LIMB * low)
                    out.append(float(v))
                except OverflowError:
                    out.append(float("inf") if total > 0 else float("-inf"))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(out, pa.float64())], names=[*keys, "v"])

    kinds = dict(df.dtypes)
    return whole.select("limbs", "odd", *keys).mapInArrow(rounded, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "v double"]))


def sum_axes(x: TensorFrame, over: Sequence[int], exact: bool = False) -> TensorFrame:
    """Sums over some axes, which go; exact: of doubles, rounded once and the same in any order."""
    if not all(0 <= a < x.ndim for a in over):
        raise IndexError(f"no axes {over} in {x.shape}")
    kept = [a for a in range(x.ndim) if a not in set(over)]
    dtype = _wide(x.dtype)
    if exact and K.is_float(x.dtype) and all(x.shape[a] for a in over):
        cells = x.df.select(*[F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(kept)], F.col("v").cast("double").alias("v"))
        return TensorFrame(exact_sums(cells, axes(len(kept))), [x.shape[a] for a in kept], "f64")
    grouped = x.df.groupBy(*[F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(kept)]).agg(F.coalesce(F.sum("v"), F.lit(0)).cast(K.spark_type(dtype)).alias("v"))
    out = TensorFrame(grouped.select(*axes(len(kept)), "v"), [x.shape[a] for a in kept], dtype)
    if any(x.shape[a] == 0 for a in over) and out.size and kept:  # no cell, but sums of nothing
        return TensorFrame.zeros(x.spark, out.shape, dtype)
    return out


def sum_axis(x: TensorFrame, axis: int, beta: float = 0, out: TensorFrame | None = None, exact: bool = False) -> TensorFrame:
    """Sum over an axis, plus beta * out."""
    return _with_out(sum_axes(x, [axis], exact), beta, out)


def sum_all(x: TensorFrame, beta: float = 0, out: TensorFrame | None = None, exact: bool = False) -> TensorFrame:
    """Sum of all cells as a tensor of rank 0, plus beta * out."""
    return _with_out(sum_axes(x, range(x.ndim), exact), beta, out)
