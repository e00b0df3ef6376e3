"""Matrix products: a join on the shared index and a sum.

Row blocks times driver data of bounded size need neither: the matrix goes to the
rows, as does the other way the sum over rows of two blocks' outer products.  A side that is
small by its shape is broadcast to the other's cells, and partial aggregation
before the shuffle is the split of long inner axes.  Two large matrices of floats
are multiplied by dense tiles (tiles.py); of integers, which must not be rounded,
by cells that meet by range of the output and shared index.  Of two with short
rows, AᵀB is a sum of outer products and ABᵀ a Cartesian product of strips of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorframe import types as K
from tensorframe.frame import BROADCAST_CELLS, TensorFrame
from tensorframe.operators.shape import transpose
from tensorframe.operators.tiles import EDGE, GRAM_CELLS, Tiles, gram, outer


#: Ranges of rows, and of columns, that the output of two large matrices is cut into.
TILES = 8


def row_product(value: str, matrix: np.ndarray) -> Column:
    """The array value times a matrix, as an array."""
    columns = F.lit([[float(x) for x in c] for c in np.asarray(matrix).T])
    return F.transform(columns, lambda c: F.aggregate(F.zip_with(value, c, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x))


def _turned(x: TensorFrame) -> TensorFrame:
    return transpose(x) if x.local is None else TensorFrame.from_numpy(x.spark, x.local.T, x.dtype)


def dot(a: TensorFrame, b: TensorFrame, ta: bool = False, tb: bool = False, alpha: float = 1.0, beta: float = 0.0, c: TensorFrame | None = None) -> TensorFrame:
    """alpha * A·B + beta * C of matrices of one element type, either one transposed on the way."""
    a.require(ndim=2), b.require(ndim=2, dtype=a.dtype)
    first, second = a, b
    a, b = _turned(a) if ta else a, _turned(b) if tb else b
    (m, k), (k2, n) = a.shape, b.shape
    if k != k2:
        raise K.ShapeError(f"{a.shape} and {b.shape} don't multiply")
    wide = "double" if K.is_float(a.dtype) else "long"
    if wide == "double" and k and not ta and first.block is not None and b.local is not None and b.size <= BROADCAST_CELLS:
        out = TensorFrame.from_block(first.block.then("dense", (n,), None, (alpha * b.local.astype(float),)), (m, n))
        return _plus(out, beta, c)
    if wide == "double" and ta and not tb and first.block is not None and second.block is not None and m * n <= GRAM_CELLS:
        out = TensorFrame.from_block(first.block.then("sum:dense", (m, n), other=second.block), (m, n))
        return _plus(out if alpha == 1 else out.with_df(out.df.withColumn("v", F.col("v") * F.lit(alpha))), beta, c)
    # Dense rows aren't cut into cells, even to meet a small side.
    small = min(a.size, b.size) <= BROADCAST_CELLS and (first.rows is None or second.local is not None or k == 0)
    if wide == "double" and not small:
        # No side is small: dense tiles, or sums of outer products where the output is small.
        if ta and not tb and m * n <= GRAM_CELLS:
            out = gram(first, second)
            return _plus(out if alpha == 1 else TensorFrame.from_rows(out.rows.select("i0", F.transform("value", lambda x: x * F.lit(alpha)).alias("value")), (m, n)), beta, c)
        if tb and not ta and k <= EDGE < max(m, n) and first.rows is not None and second.rows is not None:  # more than one tile to one
            return _plus(outer(first, second).frame(alpha), beta, c)
        one, two = Tiles.of(first), Tiles.of(second)
        return _plus((one.transposed() if ta else one).dot(two.transposed() if tb else two).frame(alpha), beta, c)
    left = (a.hinted() if a.size < b.size else a.df).select("i0", F.col("i1").alias("k"), F.col("v").cast(wide).alias("x"))
    right = (b.df if a.size < b.size else b.hinted()).select(F.col("i0").alias("k"), "i1", F.col("v").cast(wide).alias("y"))
    if not small:  # integers, which products of doubles would round
        left, right = _tiled(left, "i0", m, "i1", n), _tiled(right, "i1", n, "i0", m)
    df = left.join(right, [c for c in left.columns if c in right.columns]).groupBy("i0", "i1").agg((F.sum(F.col("x") * F.col("y")) * F.lit(int(alpha) if wide == "long" and float(alpha).is_integer() else alpha)).cast(wide).alias("v"))
    out = TensorFrame(df.select("i0", "i1", "v"), (m, n), "f64" if wide == "double" else "i64")
    return _plus(out, beta, c)


def _tiled(side: DataFrame, own: str, size: int, other: str, count: int) -> DataFrame:
    """A side with the tile of the output that its cells meet the other's in: its own range, and each of the other's.

    With n by n tiles a cell is sent n times, and as many tasks share the pairs of an index.
    """
    n = TILES
    mine = F.expr(f"{own} * {n} div {max(size, 1)}")
    theirs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    return side.withColumn(f"t_{own}", mine).withColumn(f"t_{other}", theirs)


def _plus(out: TensorFrame, beta: float, c: TensorFrame | None) -> TensorFrame:
    if c is None or not beta:
        return out
    from tensorframe.operators.elementwise import scaled_add

    return scaled_add(out, beta, c)
