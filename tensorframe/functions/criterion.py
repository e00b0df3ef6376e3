"""Classification losses and metrics over logits [n, classes] and labels [n]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorframe import types as K
from tensorframe.frame import TensorFrame
from tensorframe.operators import blocks


def _rows(x: TensorFrame, target: TensorFrame) -> DataFrame:
    """A row for each sample: logits in class order and a label that is one of the classes."""
    x.require(ndim=2), target.require(ndim=1)
    if target.shape[0] != x.shape[0]:
        raise K.ShapeError(f"{target.shape[0]} labels for {x.shape[0]} rows")
    return _labelled(x.dense("i0", "x").join(target.hinted().select("i0", F.col("v").alias("t")), "i0"), x.shape[1])


def _labelled(rows: DataFrame, classes: int) -> DataFrame:
    """rows (x, t, …) with the label's logit xt; a label outside the classes raises."""
    return rows.withColumn("t", _label_of(F.col("t"), classes)).withColumn("xt", F.get("x", F.col("t")))


#: Rows of more classes are never put together as arrays.
WIDE = 4096
#: Width of a bin of logits: sums of exponentials of one bin neither overflow nor vanish.
BIN = 64.0


def wide_rows(x: TensorFrame, target: TensorFrame) -> DataFrame:
    """(i0, t, xt, m, s, loss, right) of each sample, from cells of any number of classes.

    A row's state is mergeable: the sum of exponentials by bin of its logits, scaled
    by the bin, the largest logit, the label's and the largest of the others; so
    cells are combined before the shuffle, and what is shuffled are a few bins a
    row and task.  A NaN makes the loss NaN and the row wrong.
    """
    x.require(ndim=2), target.require(ndim=1)
    if target.shape[0] != x.shape[0]:
        raise K.ShapeError(f"{target.shape[0]} labels for {x.shape[0]} rows")
    t = _label_of(F.col("t"), x.shape[1])
    cells = x.df.select("i0", "i1", F.col("v").cast("double").alias("v")).join(target.hinted().select("i0", F.col("v").alias("t")), "i0").withColumn("t", t)
    bin_ = F.when(F.isnan("v") | (F.abs("v") == float("inf")), 0.0).otherwise(F.floor(F.col("v") / BIN).cast("double"))
    own = F.col("i1") == F.col("t")
    parts = cells.withColumn("bin", bin_).groupBy("i0", "bin").agg(
        F.first("t").alias("t"), F.max("v").alias("m"), F.sum(F.exp(F.col("v") - F.col("bin") * BIN)).alias("s"), F.max(F.when(own, F.col("v"))).alias("xt"), F.max(F.when(~own, F.col("v"))).alias("rest")
    )
    rows = parts.groupBy("i0").agg(F.first("t").alias("t"), F.max("m").alias("m"), F.max("xt").alias("xt"), F.max("rest").alias("rest"), F.collect_list(F.struct("bin", "s")).alias("bins"))
    rows = rows.withColumn("s", F.aggregate("bins", F.lit(0.0), lambda a, b: a + b["s"] * F.exp(b["bin"] * BIN - F.col("m"))))
    loss = F.log("s") - (F.col("xt") - F.col("m"))
    right = ~F.isnan("xt") & F.coalesce(~F.isnan("rest") & (F.col("xt") > F.col("rest")), F.lit(True))
    return rows.select("i0", "t", "xt", "m", "s", loss.alias("loss"), right.alias("right"))


def _label_of(t, classes: int):
    return F.when((t >= 0) & (t < classes), t.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no such class: "), t.cast("string"))).cast("int"))


def _is_wide(x: TensorFrame) -> bool:
    return x.ndim == 2 and x.shape[1] > WIDE and x.rows is None


def accuracy(x: TensorFrame, target: TensorFrame) -> DataFrame:
    """One row (correct): samples whose label's logit is above every other; ties and NaN are wrong."""
    if _is_wide(x):
        return wide_rows(x, target).agg(F.count_if(F.col("right")).alias("correct"))
    beaten = F.forall("scored", lambda s: (s["c"] == F.col("t")) | (s["v"] < F.col("xt")) & ~F.isnan(s["v"]))
    rows = _rows(x, target).withColumn("scored", F.transform("x", lambda v, c: F.struct(v.alias("v"), c.alias("c"))))
    return rows.agg(F.coalesce(F.sum((beaten & ~F.isnan("xt")).cast("long")), F.lit(0)).alias("correct"))


def cross_entropy_rows(x: TensorFrame, target: TensorFrame) -> DataFrame:
    """(i0, x, t, m, s, loss) of each sample: m the largest logit, s the sum of exp(x - m)."""
    return _scored(_rows(x, target))


def _scored(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("m", F.array_max("x"))
    rows = rows.withColumn("s", F.aggregate("x", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("m"))))
    return rows.withColumn("loss", F.log("s") - (F.col("xt") - F.col("m")))


def _blocks(x: TensorFrame, target: TensorFrame):
    """Loss, being right, and gradient of each row, where logits and labels are row blocks."""
    x.require(ndim=2), target.require(ndim=1)
    if target.shape[0] != x.shape[0]:
        raise K.ShapeError(f"{target.shape[0]} labels for {x.shape[0]} rows")
    return None if x.block is None or target.local is not None or target.numbers() is None else blocks.cross_entropy(x.block, target.numbers())


def cross_entropy(x: TensorFrame, target: TensorFrame) -> TensorFrame:
    """The loss summed over samples as a tensor of rank 0; where rows carry both, a sum that gradients of them share a pass with."""
    if (found := _blocks(x, target)) is not None:
        return TensorFrame.from_block(blocks.total(found[0]), ())
    return TensorFrame(cross_entropy_loss(x, target).withColumnRenamed("loss", "v"), ())


def cross_entropy_loss(x: TensorFrame, target: TensorFrame) -> DataFrame:
    """One row (loss): the sum over samples."""
    rows = wide_rows(x, target) if _is_wide(x) else cross_entropy_rows(x, target)
    return rows.agg(F.coalesce(F.sum("loss"), F.lit(0.0)).alias("loss"))


def cross_entropy_backward(x: TensorFrame, target: TensorFrame, dy: float = 1.0) -> TensorFrame:
    """The gradient of the mean loss: dy / n * (softmax - one hot)."""
    n = x.shape[0]
    if (found := _blocks(x, target)) is not None:
        return TensorFrame.from_block(found[2].then("scale", x.shape[1:], dy / n), x.shape)
    if _is_wide(x):
        rows = x.df.withColumnRenamed("i1", "c").join(wide_rows(x, target).select("i0", "t", "m", "s").hint("merge"), "i0")
    else:
        rows = cross_entropy_rows(x, target).select("i0", "t", "m", "s", F.posexplode("x").alias("c", "v"))
    g = (F.exp(F.col("v") - F.col("m")) / F.col("s") - (F.col("c") == F.col("t")).cast("double")) * F.lit(dy / n)
    return TensorFrame(rows.select("i0", F.col("c").cast("long").alias("i1"), g.alias("v")), x.shape)


def epoch_stats(x: TensorFrame, target: TensorFrame) -> DataFrame:
    """One row (count, loss, mean_loss, correct, accuracy in percent) in a single pass."""
    if _is_wide(x):
        sums = wide_rows(x, target).agg(F.count(F.lit(1)).alias("count"), F.sum("loss").alias("loss"), F.count_if(F.col("right")).alias("correct"))
        return _means(sums)
    return _stats(cross_entropy_rows(x, target))


def row_stats(rows: DataFrame, classes: int, logits: str = "logits", label: str = "label") -> DataFrame:
    """epoch_stats() of rows that have logits and label side by side: no join, and no shuffle but the last sum's."""
    return _stats(_scored(_labelled(rows.select(F.col(logits).alias("x"), F.col(label).alias("t")), classes)))


def _stats(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("scored", F.transform("x", lambda v, c: F.struct(v.alias("v"), c.alias("c"))))
    beaten = F.forall("scored", lambda s: (s["c"] == F.col("t")) | (s["v"] < F.col("xt")) & ~F.isnan(s["v"])) & ~F.isnan("xt")
    sums = rows.agg(F.count(F.lit(1)).alias("count"), F.sum("loss").alias("loss"), F.sum(beaten.cast("long")).alias("correct"))
    return _means(sums)


def _means(sums: DataFrame) -> DataFrame:
    return sums.select("count", "loss", (F.col("loss") / F.col("count")).alias("mean_loss"), "correct", (100.0 * F.col("correct") / F.col("count")).alias("accuracy"))
