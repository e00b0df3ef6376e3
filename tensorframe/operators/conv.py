"""Convolution and pooling over cells.

An input cell is sent to the output positions whose windows hold it (a generate
over the filter's taps with index arithmetic), so no padding is stored and no
patch matrix is needed for convolution: taps join the weights, and an aggregate
sums.  Images that are row blocks, with weights at the driver, take none of this:
see blocks.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorframe import types as K
from tensorframe.frame import TensorFrame
from tensorframe.operators import blocks
from tensorframe.operators.shape import index_axis, reshape


def _span(n: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _taps(x: TensorFrame, kernel, padding, stride, dilation) -> tuple[DataFrame, tuple[int, int]]:
    """Rows (b, c, h, w, fi, fj, y, x, v) of each cell in each window that holds it."""
    x.require(ndim=4)
    oh, ow = K.conv_shape(x.shape[2:], kernel, padding, stride, dilation)
    df = x.df.select(*[F.col(f"i{k}").alias(n) for k, n in enumerate("bchw")], "v")
    for pos, tap, out, axis, n in (("h", "fi", "y", 0, oh), ("w", "fj", "x", 1, ow)):
        df = df.withColumn(tap, _span(kernel[axis])).withColumn("_r", F.col(pos) + padding[axis] - F.col(tap) * dilation[axis])
        df = df.filter((F.col("_r") >= 0) & (F.col("_r") % stride[axis] == 0)).withColumn(out, F.expr(f"_r div {stride[axis]}")).filter(F.col(out) < n).drop("_r")
    return df, (oh, ow)


def _options(padding, stride, dilation):
    return K.pair(padding), K.pair(stride), K.pair(dilation)


def _filled(df: DataFrame, shape, dtype: str = "f64") -> TensorFrame:
    """All cells of a shape of weights' size: those of df (lin, v), else 0."""
    spark = df.sparkSession
    grid = spark.range(K.size(tuple(shape))).select(F.col("id").alias("lin"))
    return TensorFrame.from_linear(grid.join(df, "lin", "left").select("lin", F.coalesce("v", F.lit(0)).cast(K.spark_type(dtype)).alias("v")), shape, dtype)


def _met(place: str, size: int, kernel: int, padding: int, stride: int, dilation: int) -> str:
    """SQL: whether some window of a row of `size` windows holds the input place."""
    taps = [f"{place} + {padding - f * dilation}" for f in range(kernel)]
    return "(" + " OR ".join(f"({t} >= 0 AND ({t}) % {stride} = 0 AND ({t}) div {stride} < {size})" for t in taps) + ")"


def _holds(window: str, size: int, kernel: int, padding: int, stride: int, dilation: int) -> str:
    """SQL: whether a window holds some place of an input of this size."""
    return "(" + " OR ".join(f"({window} * {stride} + {f * dilation - padding} BETWEEN 0 AND {size - 1})" for f in range(kernel)) + ")"


def _completed(df: DataFrame, shape, dtype: str, names: list[str], found: str) -> TensorFrame:
    """df (lin, v), which has each cell for which the condition on named indices holds, with 0 for the others.

    The missing cells come from index arithmetic, so nothing is joined or shuffled for them.
    """
    shape = tuple(shape)
    grid = df.sparkSession.range(K.size(shape)).select(F.col("id").alias("lin"))
    grid = grid.select("lin", *[F.expr(f"lin div {s} % {max(d, 1)}").alias(n) for n, d, s in zip(names, shape, K.strides(shape), strict=True)])
    rest = grid.filter(~F.expr(found)).select("lin", F.lit(0).cast(K.spark_type(dtype)).alias("v"))
    return TensorFrame.from_linear(df.select("lin", F.col("v").cast(K.spark_type(dtype)).alias("v")).unionByName(rest), shape, dtype)


def _lin(shape, names) -> str:
    return " + ".join(f"{n} * {s}L" for n, s in zip(names, K.strides(tuple(shape)), strict=True))


def im2col(x: TensorFrame, kernel, padding=0, stride=1, dilation=1) -> TensorFrame:
    """[b, c, h, w] to [b·oh·ow, c·fh·fw], 0 outside the input."""
    kernel = K.pair(kernel)
    p, s, d = _options(padding, stride, dilation)
    taps, (oh, ow) = _taps(x, kernel, p, s, d)
    b, c = x.shape[:2]
    full = (b, oh, ow, c, *kernel)
    cells = taps.select(F.expr(_lin(full, ("b", "y", "x", "c", "fi", "fj"))).alias("lin"), "v")
    # The patch matrix has the same row-major places as the six axes.
    inside = " AND ".join(f"{o} * {s[k]} + {f} * {d[k]} - {p[k]} BETWEEN 0 AND {x.shape[2 + k] - 1}" for k, (o, f) in enumerate((("y", "fi"), ("x", "fj"))))
    six = cells if p == (0, 0) else _completed(cells, full, x.dtype, ["b", "y", "x", "c", "fi", "fj"], inside).df.select(F.expr(_lin(full, [f"i{k}" for k in range(6)])).alias("lin"), "v")
    return TensorFrame.from_linear(six, (b * oh * ow, c * kernel[0] * kernel[1]), x.dtype)


def col2im(cols: TensorFrame, shape, kernel, padding=0, stride=1, dilation=1) -> TensorFrame:
    """The adjoint of im2col: cells added up at the places of [b, c, h, w] that they came from."""
    kernel, shape = K.pair(kernel), tuple(shape)
    p, s, d = _options(padding, stride, dilation)
    oh, ow = K.conv_shape(shape[2:], kernel, p, s, d)
    b, c = shape[:2]
    if cols.shape != (b * oh * ow, c * kernel[0] * kernel[1]):
        raise K.ShapeError(f"{cols.shape} isn't a patch matrix of {shape}")
    df = cols.df.select(
        F.expr(f"i0 div {oh * ow}").alias("b"), F.expr(f"i1 div {kernel[0] * kernel[1]}").alias("c"),
        F.expr(f"i0 div {ow} % {oh} * {s[0]} + i1 div {kernel[1]} % {kernel[0]} * {d[0]} - {p[0]}").alias("h"), F.expr(f"i0 % {ow} * {s[1]} + i1 % {kernel[1]} * {d[1]} - {p[1]}").alias("w"), "v",
    )
    df = df.filter((F.col("h") >= 0) & (F.col("h") < shape[2]) & (F.col("w") >= 0) & (F.col("w") < shape[3]))
    return _summed(df, shape, (oh, ow), kernel, p, s, d)


def _summed(df: DataFrame, shape, out, kernel, p, s, d) -> TensorFrame:
    """Cells (b, c, h, w, v) added up by place, 0 where no window holds a place."""
    met = " AND ".join(_met(n, *x) for n, x in zip("hw", zip(out, kernel, p, s, d, strict=True), strict=True))
    return _completed(df.groupBy(F.expr(_lin(shape, "bchw")).alias("lin")).agg(F.sum("v").alias("v")), shape, "f64", [*"bchw"], met)


def _weights(w: TensorFrame) -> DataFrame:
    return w.require(ndim=4).hinted().select(F.col("i0").alias("o"), F.col("i1").alias("c"), F.col("i2").alias("fi"), F.col("i3").alias("fj"), F.col("v").cast("double").alias("k"))


def _empty_windows(shape, kernel, padding, stride, dilation) -> bool:
    """Whether a window can lie in the padding alone."""
    return any(p > d * (f - 1) or (s > 1 and d > 1) for f, p, s, d in zip(kernel, padding, stride, dilation, strict=True))


def conv2(x: TensorFrame, w: TensorFrame, bias: TensorFrame | None = None, padding=0, stride=1, dilation=1) -> TensorFrame:
    """Y[b,o,y,x] = sum over c, fi, fj of X[b,c,hx,wx] W[o,c,fi,fj], plus a bias for each output channel."""
    if w.shape[1] != x.shape[1]:
        raise K.ShapeError(f"{w.shape[1]} input channels aren't {x.shape[1]}")
    kernel = w.shape[2:]
    p, s, d = _options(padding, stride, dilation)
    if x.require(ndim=4).block is not None and w.local is not None:
        y = blocks.conv2(x.block, w.local.astype(float), p, s, d)
        return _with_bias(TensorFrame.from_block(y, (x.shape[0], *y.inner)), bias)
    taps, (oh, ow) = _taps(x, kernel, p, s, d)
    shape = (x.shape[0], w.shape[0], oh, ow)
    df = taps.join(_weights(w), ["c", "fi", "fj"]).groupBy("b", "o", "y", "x").agg(F.sum(F.col("v") * F.col("k")).alias("v"))
    if _empty_windows(x.shape[2:], kernel, p, s, d):
        held = " AND ".join(_holds(n, *a) for n, a in zip("yx", zip(x.shape[2:], kernel, p, s, d, strict=True), strict=True))
        out = _completed(df.select(F.expr(_lin(shape, "boyx")).alias("lin"), "v"), shape, "f64", [*"boyx"], held)
    else:
        out = TensorFrame(df.select(*[F.col(n).alias(f"i{k}") for k, n in enumerate("boyx")], "v"), shape)
    return _with_bias(out, bias)


def _with_bias(out: TensorFrame, bias: TensorFrame | None) -> TensorFrame:
    if bias is None:
        return out
    from tensorframe.operators.elementwise import add_assign

    return add_assign(out, reshape(bias, (bias.size, 1, 1)))


def conv2_backward_input(dy: TensorFrame, w: TensorFrame, shape, padding=0, stride=1, dilation=1) -> TensorFrame:
    """The gradient of conv2 at its input of this shape."""
    shape = tuple(shape)
    p, s, d = _options(padding, stride, dilation)
    if dy.require(ndim=4).block is not None and w.local is not None:
        return TensorFrame.from_block(blocks.conv2_backward_input(dy.block, w.local.astype(float), shape[1:], p, s, d), shape)
    df = dy.require(ndim=4).df.select(F.col("i0").alias("b"), F.col("i1").alias("o"), F.col("i2").alias("y"), F.col("i3").alias("x"), "v").join(_weights(w), "o")
    df = df.select("b", "c", (F.col("y") * s[0] + F.col("fi") * d[0] - p[0]).alias("h"), (F.col("x") * s[1] + F.col("fj") * d[1] - p[1]).alias("w"), (F.col("v") * F.col("k")).alias("v"))
    df = df.filter((F.col("h") >= 0) & (F.col("h") < shape[2]) & (F.col("w") >= 0) & (F.col("w") < shape[3]))
    return _summed(df, shape, dy.shape[2:], w.shape[2:], p, s, d)


def conv2_backward_weight(x: TensorFrame, dy: TensorFrame, kernel, padding=0, stride=1, dilation=1) -> TensorFrame:
    """The gradient of conv2 at its weights; a map-side sum over the batch, as few rows as weights leave a task."""
    kernel = K.pair(kernel)
    p, s, d = _options(padding, stride, dilation)
    if x.require(ndim=4).block is not None and dy.require(ndim=4).block is not None:
        return TensorFrame.from_block(blocks.conv2_backward_weight(x.block, dy.block, kernel, p, s, d), (dy.shape[1], x.shape[1], *kernel))
    taps, _ = _taps(x, kernel, p, s, d)
    grad = dy.require(ndim=4).hinted().select(F.col("i0").alias("b"), F.col("i1").alias("o"), F.col("i2").alias("y"), F.col("i3").alias("x"), F.col("v").cast("double").alias("g"))
    shape = (dy.shape[1], x.shape[1], *kernel)
    df = taps.join(grad, ["b", "y", "x"]).groupBy("o", "c", "fi", "fj").agg(F.sum(F.col("v") * F.col("g")).alias("v"))
    return _filled(df.select(F.expr(_lin(shape, ("o", "c", "fi", "fj"))).alias("lin"), "v"), shape)


def _as_image(x: TensorFrame) -> TensorFrame:
    return reshape(x, (*x.shape, 1))


def conv1(x: TensorFrame, w: TensorFrame, bias: TensorFrame | None = None, padding: int = 0, stride: int = 1, dilation: int = 1) -> TensorFrame:
    """[b, c, h] by [o, c, f]: a convolution of width 1, unpadded across."""
    return index_axis(conv2(_as_image(x), _as_image(w), bias, (padding, 0), (stride, 1), (dilation, 1)), 3, 0)


def _windows(x: TensorFrame, kernel, stride) -> tuple[DataFrame, tuple[int, int]]:
    """As _taps(), but a cell of windows that don't overlap is in one, which division gives."""
    if stride != kernel:
        return _taps(x, kernel, (0, 0), stride, (1, 1))
    x.require(ndim=4)
    out = K.conv_shape(x.shape[2:], kernel, (0, 0), stride, (1, 1))
    df = x.df.filter((F.col("i2") < out[0] * kernel[0]) & (F.col("i3") < out[1] * kernel[1])).select(*[F.col(f"i{k}").alias(n) for k, n in enumerate("bchw")], "v")
    return df.selectExpr("*", f"h % {kernel[0]} AS fi", f"w % {kernel[1]} AS fj", f"h div {kernel[0]} AS y", f"w div {kernel[1]} AS x"), out


def _winner(taps: DataFrame) -> DataFrame:
    """(b, c, y, x, m): the value and tap that win each window, from the first tap by strict >.

    NaN wins only as the first tap; else the greatest of the others, and of equal ones the first.
    """
    first_nan = F.bool_or((F.col("fi") == 0) & (F.col("fj") == 0) & F.isnan(F.col("v").cast("double")))
    order = F.struct("v", (-F.col("fi")).alias("fi"), (-F.col("fj")).alias("fj"))
    # An aggregate that combines before the shuffle, where a window function would sort all taps.
    best = taps.groupBy("b", "c", "y", "x").agg(F.max(F.when(~F.isnan(F.col("v").cast("double")), order)).alias("m"), first_nan.alias("nan"), F.max("v").alias("most"))
    zero = F.lit(0).cast("long")
    return best.select("b", "c", "y", "x", F.when(F.col("nan"), F.struct(F.col("most").alias("v"), zero.alias("fi"), zero.alias("fj"))).otherwise(F.col("m")).alias("m"))


def max_pool2(x: TensorFrame, kernel, stride=None) -> TensorFrame:
    """The value that wins each window; the stride is the window unless given."""
    return max_pool2_switches(x, kernel, stride)[0]


def max_pool2_switches(x: TensorFrame, kernel, stride=None) -> tuple[TensorFrame, TensorFrame]:
    """The value that wins each window, and its tap (row-major, from 0) for the way back."""
    kernel = K.pair(kernel)
    stride = kernel if stride is None else K.pair(stride)
    if x.require(ndim=4).block is not None:
        y, won = blocks.max_pool2(x.block, kernel, stride)
        return TensorFrame.from_block(y, (x.shape[0], *y.inner)), TensorFrame.from_block(won, (x.shape[0], *won.inner))
    taps, out = _windows(x, kernel, stride)
    df = _winner(taps).select(*[F.col(n).alias(f"i{k}") for k, n in enumerate("bcyx")], "m")
    shape = (*x.shape[:2], *out)
    won = (-F.col("m.fi") * kernel[1] - F.col("m.fj")).cast("int").alias("v")
    return x.with_df(df.select("i0", "i1", "i2", "i3", F.col("m.v").alias("v")), shape), TensorFrame(df.select("i0", "i1", "i2", "i3", won), shape, "i32")


def max_pool2_backward(x: TensorFrame, dy: TensorFrame, kernel, stride=None, won: TensorFrame | None = None) -> TensorFrame:
    """dy at the cell that won each window, added up where windows overlap, 0 elsewhere.

    won: the taps that the forward pass kept; else they are found again.
    """
    kernel = K.pair(kernel)
    stride = kernel if stride is None else K.pair(stride)
    won = max_pool2_switches(x, kernel, stride)[1] if won is None else won
    if won.block is not None and dy.block is not None:
        return TensorFrame.from_block(blocks.max_pool2_backward(won.block, dy.block, x.shape[1:], kernel, stride), x.shape)
    grad = dy.hinted().select(*[F.col(f"i{k}").alias(n) for k, n in enumerate("bcyx")], F.col("v").alias("g"))
    taps = won.df.select(*[F.col(f"i{k}").alias(n) for k, n in enumerate("bcyx")], F.col("v").alias("tap")).join(grad, ["b", "c", "y", "x"])
    # Each window gives all its cells a number, 0 but for one, so only cells outside all windows are missing.
    taps = taps.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(kernel[0] * kernel[1] - 1))))
    cell = [F.col("b"), F.col("c"), F.expr(f"y * {stride[0]} + t div {kernel[1]}").alias("h"), F.expr(f"x * {stride[1]} + t % {kernel[1]}").alias("w")]
    cells = taps.select(*cell, F.when(F.col("t") == F.col("tap"), F.col("g")).otherwise(F.lit(0.0)).alias("v"))
    out = won.shape[2:]
    if stride != kernel:
        return _summed(cells, x.shape, out, kernel, (0, 0), stride, (1, 1))
    met = f"h < {out[0] * kernel[0]} AND w < {out[1] * kernel[1]}"
    return _completed(cells.select(F.expr(_lin(x.shape, "bchw")).alias("lin"), "v"), x.shape, "f64", [*"bchw"], met)


def max_pool1(x: TensorFrame, kernel: int, stride: int | None = None) -> TensorFrame:
    return index_axis(max_pool2(_as_image(x), (kernel, 1), None if stride is None else (stride, 1)), 3, 0)


