"""The tensor operators over the driver's tables, each beside the SQL that says the same.

Vectors of `embeddings` are rows of 64, or images of 8 by 8; weights come from
integer formulas, so that both engines make the same.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorframe import operators as O
from tensorframe import types as K
from tensorframe.frame import TensorFrame
from tensorframe.functions import accuracy, cross_entropy_backward, cross_entropy_rows, epoch_stats, row_stats
from tensorframe.functions.criterion import wide_rows
from tensorframe.operators.tiles import Tiles
from tensorframe.plans import SGD, Checkpoints, Conv1, Conv2, Dense, Flatten, Identity, Layer, MaxPool1, MaxPool2, OneOf, Optimizer, Optional, Parameter, Relu, Sequential, Variable, load_model, save_model
from tensorframe.plans.sharded import ShardedMatrix, softmax_step
from tensorframe.plans.train import Net, evaluate, gradients, predict, train
from tensorframe.scratch import make_folder, scratch_path
from tensorframe.sources import Permutation, batched, digits, iris, sequential, shuffled, write_idx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _WITH + sql
        return f

    return add


# --- Inputs ------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str, shape: tuple[int, ...] = (64,)) -> TensorFrame:
    """[n, 64], or [n, 1, 8, 8]; the count comes from the file's footer."""
    return TensorFrame.from_column(table(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding").cast("array<double>"), shape)


def labels(spark: SparkSession, sf_dir: str) -> TensorFrame:
    e = table(spark, sf_dir, "embeddings")
    return TensorFrame(e.select(F.col("vec_id").cast("long").alias("i0"), F.col("label").alias("v")), (e.count(),), "i32")


def images_and_labels(spark: SparkSession, sf_dir: str) -> list[TensorFrame]:
    """[n, 1, 8, 8] and [n] as columns of one frame."""
    return TensorFrame.from_columns(table(spark, sf_dir, "embeddings"), "vec_id", {"embedding": (1, 8, 8), "label": ()})


def formula(spark: SparkSession, shape: tuple[int, ...], *factors: int, mod: int = 11, less: int = 5, by: float = 10.0) -> TensorFrame:
    """((sum of index * factor) % mod - less) / by."""
    index = np.indices(shape).reshape(len(shape), -1)
    values = ((np.array(factors) @ index) % mod - less) / by
    return TensorFrame.from_numpy(spark, values.reshape(shape))


def weight(spark: SparkSession) -> TensorFrame:
    return formula(spark, (64, 10), 7, 3)


def kernel(spark: SparkSession, out: int = 2, size: int = 3) -> TensorFrame:
    return formula(spark, (out, 1, size, size), 5, 1, 3, 7, mod=7, less=3)


def bias(spark: SparkSession, n: int) -> TensorFrame:
    return formula(spark, (n,), 3, mod=5, less=2)


_WITH = """
WITH x AS (SELECT vec_id AS i0, unnest(range(64)) AS i1, unnest(embedding)::DOUBLE AS v FROM embeddings),
img AS (SELECT i0 AS b, 0::BIGINT AS c, i1 // 8 AS h, i1 % 8 AS w, v FROM x),
w AS (SELECT k.range AS i0, n.range AS i1, ((k.range * 7 + n.range * 3) % 11 - 5) / 10.0::DOUBLE AS v FROM range(64) k, range(10) n),
y AS (SELECT x.i0, w.i1, sum(x.v * w.v) AS v FROM x JOIN w ON x.i1 = w.i0 GROUP BY ALL),
lab AS (SELECT vec_id AS i0, label AS t FROM embeddings),
ker AS (SELECT o.range AS o, fi.range AS fi, fj.range AS fj, ((o.range * 5 + fi.range * 3 + fj.range * 7) % 7 - 3) / 10.0::DOUBLE AS k FROM range(2) o, range(3) fi, range(3) fj),
bia AS (SELECT range AS o, ((range * 3) % 5 - 2) / 10.0::DOUBLE AS k FROM range(10)),
ce AS (SELECT y.i0, max(y.v) AS m FROM y GROUP BY y.i0),
cs AS (SELECT y.i0, any_value(ce.m) AS m, sum(exp(y.v - ce.m)) AS s FROM y JOIN ce USING (i0) GROUP BY y.i0),
loss AS (SELECT cs.i0, lab.t, ln(cs.s) - (y.v - cs.m) AS loss FROM cs JOIN lab USING (i0) JOIN y ON y.i0 = cs.i0 AND y.i1 = lab.t),
hit AS (SELECT lab.i0, bool_and(y.i1 = lab.t OR y.v < g.v) AS hit FROM lab JOIN y g ON g.i0 = lab.i0 AND g.i1 = lab.t JOIN y ON y.i0 = lab.i0 GROUP BY lab.i0),
dl AS (SELECT y.i0, y.i1, (exp(y.v - cs.m) / cs.s - CASE WHEN y.i1 = lab.t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / (SELECT count(*) FROM lab) AS v FROM y JOIN cs USING (i0) JOIN lab USING (i0)),
dw AS (SELECT x.i1 AS i0, dl.i1, sum(x.v * dl.v) AS v FROM x JOIN dl ON x.i0 = dl.i0 GROUP BY ALL)
"""


def shown(x: TensorFrame | DataFrame, digits: int = DIGITS) -> DataFrame:
    """Floats rounded, and never -0."""
    df = x.df if isinstance(x, TensorFrame) else x
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def rounded(c: str, digits: int) -> Column:
    """As F.round, which goes by the decimal text of each number: only numbers near a tie, or large or none, need that."""
    scaled = F.col(c) * F.lit(10.0**digits)
    whole = F.rint(scaled)
    sure = (F.abs(scaled) < 2.0**40) & (F.abs(F.abs(scaled - whole) - 0.5) > 0.001)
    return F.when(sure, whole / F.lit(10.0**digits)).otherwise(F.round(c, digits))


_V = "round(v, 6) + 0.0 AS v"


# --- Loss and accuracy of a dense layer ---------------------------------------------------------


@query("SELECT (SELECT count(*) FROM loss) AS count, (SELECT round(sum(loss), 4) FROM loss) AS loss, (SELECT round(avg(loss), 6) FROM loss) AS mean_loss, (SELECT count(*) FROM hit WHERE hit) AS correct, (SELECT round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 6) FROM hit) AS accuracy")
def q_dense_loss_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row by row: the weights stand in the plan, and only sums are shuffled."""
    w = weight(spark).local
    rows = table(spark, sf_dir, "embeddings").select(O.row_product("embedding", w).alias("logits"), "label")
    stats = row_stats(rows, w.shape[1])
    return stats.select("count", F.round("loss", 4).alias("loss"), F.round("mean_loss", 6).alias("mean_loss"), "correct", F.round("accuracy", 6).alias("accuracy"))


@query("SELECT i0, round(loss, 6) + 0.0 AS loss FROM loss")
def q_cross_entropy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cross_entropy_rows(O.dot(vectors(spark, sf_dir), weight(spark)), labels(spark, sf_dir)).select("i0", "loss"))


@query(f"SELECT i0, i1, {_V} FROM dl")
def q_cross_entropy_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(cross_entropy_backward(O.dot(vectors(spark, sf_dir), weight(spark)), labels(spark, sf_dir)))


@query("SELECT count(*) FILTER (hit) AS correct FROM hit")
def q_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy(O.dot(vectors(spark, sf_dir), weight(spark)), labels(spark, sf_dir))


@query("SELECT count(*) AS count, round(sum(loss) / count(*), 6) AS mean_loss, (SELECT round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 6) FROM hit) AS accuracy FROM loss")
def q_epoch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(epoch_stats(O.dot(vectors(spark, sf_dir), weight(spark)), labels(spark, sf_dir)).select("count", "mean_loss", "accuracy"))


# --- Sums ---------------------------------------------------------------------------------------


@query("SELECT round(sum(v), 4) AS v FROM x")
def q_sum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.sum_all(vectors(spark, sf_dir)), 4)


@query("SELECT i1 AS i0, round(sum(v), 5) + 0.0 AS v FROM x GROUP BY i1")
def q_sum_axis0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.sum_axis(vectors(spark, sf_dir), 0), 5)


@query("SELECT i0, round(sum(v), 6) + 0.0 AS v FROM x GROUP BY i0")
def q_sum_axis1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.sum_axis(vectors(spark, sf_dir), 1))


@query("SELECT i0, round(sum(v) + 0.5 * max(CASE WHEN i1 = 3 THEN v END), 6) + 0.0 AS v FROM x GROUP BY i0")
def q_sum_axis_with_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return shown(O.sum_axis(x, 1, 0.5, O.index_axis(x, 1, 3)))


# --- Shapes -------------------------------------------------------------------------------------


@query(f"SELECT (i0 * 64 + i1) // 16 AS i0, (i0 * 64 + i1) // 4 % 4 AS i1, (i0 * 64 + i1) % 4 AS i2, {_V} FROM x")
def q_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return shown(O.reshape(x, (x.shape[0] * 4, 4, 4)))


@query(f"SELECT b AS i0, h * 8 + w AS i1, {_V} FROM img")
def q_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.flatten(vectors(spark, sf_dir, (1, 8, 8))))


@query(f"SELECT h AS i0, b AS i1, w AS i2, c AS i3, {_V} FROM img")
def q_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.permute(vectors(spark, sf_dir, (1, 8, 8)), (2, 0, 3, 1)))


@query(f"SELECT i1 AS i0, i0 AS i1, {_V} FROM x")
def q_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.transpose(vectors(spark, sf_dir)))


@query(f"SELECT r.range AS i0, x.i0 AS i1, x.i1 AS i2, {_V} FROM x, range(3) r")
def q_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return shown(O.broadcast(x, (3, *x.shape)))


@query("SELECT 0::BIGINT AS i0, i1, round(sum(v), 5) + 0.0 AS v FROM x GROUP BY i1")
def q_broadcast_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.broadcast_backward(vectors(spark, sf_dir), (1, 64)), 5)


@query(f"SELECT i0, {_V} FROM x WHERE i1 = 3")
def q_index_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.index_axis(vectors(spark, sf_dir), 1, 3))


@query(f"SELECT i0, 0::BIGINT AS i1, {_V} FROM x WHERE i1 = 3")
def q_collapse_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.collapse_axis(vectors(spark, sf_dir), 1, 3))


# --- Elementwise --------------------------------------------------------------------------------


@query("SELECT i0, i1, trunc(greatest(least(v * 100, 255), 0))::SMALLINT AS v FROM x")
def q_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.cast(O.scaled_cast(vectors(spark, sf_dir), 100, "f64"), "u8", "saturate").df


@query("SELECT i0, i1, round(v * 0.25, 6) + 0.0 AS v FROM x")
def q_scaled_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.scaled_cast(vectors(spark, sf_dir), 0.25, "f64"))


@query("SELECT i0, i1, round(v + 2 * v, 6) + 0.0 AS v FROM x")
def q_scaled_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return shown(O.scaled_add(x, 2.0, x))


@query("SELECT y.i0, y.i1, round(y.v + 2 * bia.k, 6) + 0.0 AS v FROM y JOIN bia ON bia.o = y.i1")
def q_scaled_add_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.scaled_add(O.dot(vectors(spark, sf_dir), weight(spark)), 2.0, bias(spark, 10)))


@query("SELECT y.i0, y.i1, round(bia.k, 6) + 0.0 AS v FROM y JOIN bia ON bia.o = y.i1")
def q_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    return shown(O.assign(TensorFrame.zeros(spark, (n, 10)), bias(spark, 10)))


@query("SELECT i0, i1, 1.5::DOUBLE AS v FROM x")
def q_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.fill(vectors(spark, sf_dir), 1.5))


@query("SELECT y.i0, y.i1, round(0.5 * bia.k - y.v, 6) + 0.0 AS v FROM y JOIN bia ON bia.o = y.i1")
def q_binary_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.binary("sub", 0.5, bias(spark, 10), O.dot(vectors(spark, sf_dir), weight(spark))))


@query("SELECT i0, c.range AS i1, (c.range = t)::INTEGER::DOUBLE AS v FROM lab, range(10) c")
def q_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.one_hot(labels(spark, sf_dir), 10).df


@query("SELECT i0, i1, round(greatest(v, 0), 6) + 0.0 AS v FROM x")
def q_relu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.relu(vectors(spark, sf_dir)))


@query("SELECT i0, i1, round(CASE WHEN v >= 0 THEN 2 * v + 1 ELSE 0 END, 6) + 0.0 AS v FROM x")
def q_relu_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return shown(O.relu_backward(x, x.with_df(x.df.withColumn("v", 2 * F.col("v") + 1))))


# --- Products -----------------------------------------------------------------------------------


@query(f"SELECT i0, i1, {_V} FROM y")
def q_dot_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.dot(vectors(spark, sf_dir), weight(spark)))


@query("SELECT a.i1 AS i0, b.i1, round(sum(a.v * b.v), 4) + 0.0 AS v FROM x a JOIN x b ON a.i0 = b.i0 GROUP BY ALL")
def q_dot_tn(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return shown(O.dot(x, x, ta=True), 4)


@query(f"SELECT i0, i1, {_V} FROM y")
def q_dot_nt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.dot(vectors(spark, sf_dir), O.transpose(weight(spark)), tb=True))


@query(f"SELECT i1 AS i0, i0 AS i1, {_V} FROM y")
def q_dot_tt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.dot(weight(spark), vectors(spark, sf_dir), ta=True, tb=True))


@query("SELECT dl.i0, w.i0 AS i1, round(sum(dl.v * w.v), 6) + 0.0 AS v FROM dl JOIN w ON dl.i1 = w.i1 GROUP BY ALL")
def q_dot_backward_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, w = Variable.leaf(vectors(spark, sf_dir)), Variable(weight(spark))
    x.dot(w).cross_entropy(labels(spark, sf_dir)).backward()
    return shown(x.grad)


@query(f"SELECT i0, i1, {_V} FROM dw")
def q_dot_backward_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, w = Variable(vectors(spark, sf_dir)), Variable.leaf(weight(spark))
    x.dot(w).cross_entropy(labels(spark, sf_dir)).backward()
    return shown(w.grad)


@query("SELECT y.i0, y.i1, round(y.v + bia.k, 6) + 0.0 AS v FROM y JOIN bia ON bia.o = y.i1")
def q_dense_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = Dense(spark, 64, 10, bias=True)
    layer.weight, layer.bias = Parameter(weight(spark)), Parameter(bias(spark, 10))
    return shown(layer(vectors(spark, sf_dir)).value)


# --- Convolution and pooling --------------------------------------------------------------------


def _im2col_sql(oh: int, ow: int, f: int, p: int, s: int, d: int) -> str:
    return f"""SELECT (e.i0 * {oh} + y.range) * {ow} + z.range AS i0, fi.range * {f} + fj.range AS i1, round(coalesce(img.v, 0), 6) + 0.0 AS v
    FROM lab e CROSS JOIN range({oh}) y CROSS JOIN range({ow}) z CROSS JOIN range({f}) fi CROSS JOIN range({f}) fj
    LEFT JOIN img ON img.b = e.i0 AND img.h = y.range * {s} + fi.range * {d} - {p} AND img.w = z.range * {s} + fj.range * {d} - {p}"""


@query(_im2col_sql(6, 6, 3, 0, 1, 1))
def q_im2col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.im2col(vectors(spark, sf_dir, (1, 8, 8)), 3))


@query(_im2col_sql(4, 4, 2, 1, 2, 2))
def q_im2col_strided_padded_dilated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.im2col(vectors(spark, sf_dir, (1, 8, 8)), 2, 1, 2, 2))


@query("SELECT b AS i0, c AS i1, h AS i2, w AS i3, round(v * (least(h, 2) - greatest(h - 5, 0) + 1) * (least(w, 2) - greatest(w - 5, 0) + 1), 6) + 0.0 AS v FROM img")
def q_col2im(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell comes back as often as windows hold it."""
    x = vectors(spark, sf_dir, (1, 8, 8))
    return shown(O.col2im(O.im2col(x, 3), x.shape, 3))


_CONV = "SELECT img.b, ker.o, img.h - ker.fi AS y, img.w - ker.fj AS z, sum(img.v * ker.k) AS v FROM img JOIN ker ON img.h - ker.fi BETWEEN 0 AND 5 AND img.w - ker.fj BETWEEN 0 AND 5 GROUP BY ALL"


@query(f"SELECT b AS i0, o AS i1, y AS i2, z AS i3, {_V} FROM ({_CONV})")
def q_conv2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.conv2(vectors(spark, sf_dir, (1, 8, 8)), kernel(spark)))


@query(f"SELECT b AS i0, q.o AS i1, y AS i2, z AS i3, round(v + bia.k, 6) + 0.0 AS v FROM ({_CONV}) q JOIN bia ON bia.o = q.o")
def q_conv2_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.conv2(vectors(spark, sf_dir, (1, 8, 8)), kernel(spark), bias(spark, 2)))


@query("""SELECT img.b AS i0, ker.o AS i1, (img.h + 1 - ker.fi) // 2 AS i2, (img.w + 1 - ker.fj) // 2 AS i3, round(sum(img.v * ker.k), 6) + 0.0 AS v FROM img JOIN ker
    ON img.h + 1 - ker.fi >= 0 AND (img.h + 1 - ker.fi) % 2 = 0 AND (img.h + 1 - ker.fi) // 2 < 4 AND img.w + 1 - ker.fj >= 0 AND (img.w + 1 - ker.fj) % 2 = 0 AND (img.w + 1 - ker.fj) // 2 < 4 GROUP BY ALL""")
def q_conv2_strided_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.conv2(vectors(spark, sf_dir, (1, 8, 8)), kernel(spark), None, 1, 2))


@query("""SELECT x.i0, k.o AS i1, x.i1 - k.f AS i2, round(sum(x.v * k.k), 6) + 0.0 AS v FROM x
    JOIN (SELECT o.range AS o, f.range AS f, ((o.range * 5 + f.range * 3) % 7 - 3) / 10.0::DOUBLE AS k FROM range(2) o, range(5) f) k ON x.i1 - k.f BETWEEN 0 AND 59 GROUP BY ALL""")
def q_conv1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.conv1(vectors(spark, sf_dir, (1, 64)), formula(spark, (2, 1, 5), 5, 1, 3, mod=7, less=3)))


_DY = f"SELECT b, o, y, z, v FROM ({_CONV})"


@query(f"SELECT img.b AS i0, img.c AS i1, img.h AS i2, img.w AS i3, round(coalesce(sum(dy.v * ker.k), 0), 6) + 0.0 AS v FROM img LEFT JOIN (SELECT dy.b, dy.y + ker.fi AS h, dy.z + ker.fj AS w, dy.v, ker.k FROM ({_DY}) dy JOIN ker ON ker.o = dy.o) AS j ON j.b = img.b AND j.h = img.h AND j.w = img.w GROUP BY ALL".replace("dy.v * ker.k), 0", "j.v * j.k), 0"))
def q_conv2_backward_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, w = vectors(spark, sf_dir, (1, 8, 8)), kernel(spark)
    return shown(O.conv2_backward_input(O.conv2(x, w), w, x.shape))


@query(f"SELECT dy.o AS i0, 0::BIGINT AS i1, fi.range AS i2, fj.range AS i3, round(sum(img.v * dy.v), 3) + 0.0 AS v FROM ({_DY}) dy CROSS JOIN range(3) fi CROSS JOIN range(3) fj JOIN img ON img.b = dy.b AND img.h = dy.y + fi.range AND img.w = dy.z + fj.range GROUP BY ALL")
def q_conv2_backward_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, w = vectors(spark, sf_dir, (1, 8, 8)), kernel(spark)
    return shown(O.conv2_backward_weight(x, O.conv2(x, w), 3), 3)


@query("SELECT b AS i0, c AS i1, h // 2 AS i2, w // 2 AS i3, round(max(v), 6) + 0.0 AS v FROM img GROUP BY ALL")
def q_max_pool2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.max_pool2(vectors(spark, sf_dir, (1, 8, 8)), 2))


_WINDOWS = "SELECT img.*, fi.range AS fi, fj.range AS fj, img.h - fi.range AS y, img.w - fj.range AS z FROM img, range(3) fi, range(3) fj WHERE img.h - fi.range BETWEEN 0 AND 5 AND img.w - fj.range BETWEEN 0 AND 5"


@query(f"SELECT b AS i0, c AS i1, y AS i2, z AS i3, round(max(v), 6) + 0.0 AS v FROM ({_WINDOWS}) GROUP BY ALL")
def q_max_pool2_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.max_pool2(vectors(spark, sf_dir, (1, 8, 8)), 3, 1))


@query("SELECT i0, 0::BIGINT AS i1, i1 // 4 AS i2, round(max(v), 6) + 0.0 AS v FROM x GROUP BY i0, i1 // 4")
def q_max_pool1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.max_pool1(vectors(spark, sf_dir, (1, 64)), 4))


@query(f"""SELECT img.b AS i0, img.c AS i1, img.h AS i2, img.w AS i3, round(coalesce(sum(f.v), 0), 6) + 0.0 AS v FROM img
    LEFT JOIN (SELECT * FROM ({_WINDOWS}) QUALIFY row_number() OVER (PARTITION BY b, c, y, z ORDER BY v DESC, fi, fj) = 1) f ON f.b = img.b AND f.h = img.h AND f.w = img.w GROUP BY ALL""")
def q_max_pool2_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir, (1, 8, 8))
    return shown(O.max_pool2_backward(x, O.max_pool2(x, 3, 1), 3, 1))


# --- Steps --------------------------------------------------------------------------------------


@query("SELECT w.i0, w.i1, round(w.v - 0.1 * dw.v, 6) + 0.0 AS v FROM w JOIN dw USING (i0, i1)")
def q_sgd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Parameter(weight(spark))
    p.init_grad()
    Variable(vectors(spark, sf_dir)).dot(p.to_variable()).cross_entropy(labels(spark, sf_dir)).backward()
    SGD().update(0.1, p)
    return shown(p.value)


@query("SELECT w.i0, w.i1, round(w.v - 0.1 * dw.v - 0.1 * (0.9 * dw.v + dw.v), 6) + 0.0 AS v FROM w JOIN dw USING (i0, i1)")
def q_sgd_momentum_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same gradient twice."""
    x, p, optimizer = Variable(vectors(spark, sf_dir)), Parameter(weight(spark)), SGD(0.9)
    w = Variable.leaf(p.value)
    x.dot(w).cross_entropy(labels(spark, sf_dir)).backward()
    for _ in range(2):
        p.init_grad()
        p.to_variable().backward(w.grad)
        optimizer.update(0.1, p)
    return shown(p.value)


@query("SELECT vec_id, vec_id // 100 AS batch_id FROM embeddings")
def q_batches_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential(table(spark, sf_dir, "embeddings").select("vec_id"), 100, "vec_id")


def _feistel_sql(seed: int, walks: int = 6) -> str:
    """SQL of the keyed permutation of 0 … n-1: grid (a, b), rounds, and walks for places that aren't below n."""
    p, keys = 2**31 - 1, Permutation(1, seed).keys
    steps = ["g AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM embeddings))", "s0 AS (SELECT vec_id, vec_id AS x, n, a, b FROM embeddings, g)"]
    for w in range(walks + 1):
        inner = f"SELECT *, x // b AS l, x % b AS r FROM s{w}"
        for k, (multiplier, summand, other) in enumerate(keys):
            t = f"SELECT *, ({'l' if k % 2 else 'r'} % {p} * {multiplier} + {summand}) % {p} AS t FROM ({inner})"
            inner = f"SELECT vec_id, x, n, a, b, {f'l, (r + (t * t + {other}) % {p}) % b AS r' if k % 2 else f'(l + (t * t + {other}) % {p}) % a AS l, r'} FROM ({t})"
        steps.append(f"s{w + 1} AS (SELECT vec_id, {'l * b + r' if not w else 'CASE WHEN x >= n THEN l * b + r ELSE x END'} AS x, n, a, b FROM ({inner}))")
    return f", {', '.join(steps)} SELECT vec_id, x AS place, x // 100 AS batch_id FROM s{walks + 1}"


@query(_feistel_sql(13))
def q_batches_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    return shuffled(e, 100, e.count(), 13, "vec_id")


@query("SELECT o_orderkey, c_name, row_number() OVER (ORDER BY c_name, o_orderkey) - 1 AS row_id, (row_number() OVER (ORDER BY c_name, o_orderkey) - 1) // 1000 AS batch_id FROM orders JOIN customer ON o_custkey = c_custkey")
def q_batches_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in batches by their customers' names, which are strings that repeat: numbered without a global window."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
    return batched(o, 1000, ["c_name", "o_orderkey"])


_LX = "(SELECT l_quantity / 50 AS x0, l_extendedprice / 100000 AS x1, l_discount AS x2, l_tax AS x3, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS t FROM lineitem)"


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, F.col("l_discount"), F.col("l_tax")).alias("value"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"),
    )


@query(f"""SELECT k.range AS i0, j.range AS i1, round(((k.range * 2 + j.range * 3) % 5 - 2) / 10.0::DOUBLE - 0.5 * g.v, 6) + 0.0 AS v
    FROM range(4) k, range(3) j, LATERAL (SELECT sum((CASE k.range WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END) * (exp(CASE j.range WHEN 0 THEN y0 WHEN 1 THEN y1 ELSE y2 END) / (exp(y0) + exp(y1) + exp(y2)) - (t = j.range)::INTEGER)) / count(*) AS v
      FROM (SELECT *, {", ".join(" + ".join(f"x{k} * {((2 * k + 3 * j) % 5 - 2) / 10}::DOUBLE" for k in range(4)) + f" AS y{j}" for j in range(3))} FROM {_LX})) g""")
def q_lineitem_softmax_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of softmax regression over line items, by Arrow batches."""
    rows = _line_items(spark, sf_dir)
    layer = Dense(spark, 4, 3)
    layer.weight = Parameter(formula(spark, (4, 3), 2, 3, mod=5, less=2))
    net = Net(Sequential(layer), np.float64)
    grads, _ = gradients(rows, net, (4,))
    net.step(grads, 0.5)
    return shown(TensorFrame.from_numpy(spark, net.params["layers.0.weight"]))


def cnn(spark: SparkSession) -> Sequential:
    """conv 3x3 to 2 channels, relu, pool 2, flatten, dense to 10 with bias, over 8 by 8 images."""
    conv, dense = Conv2(spark, 1, 2, 3), Dense(spark, 18, 10, bias=True)
    conv.weight, dense.weight, dense.bias = Parameter(kernel(spark)), Parameter(formula(spark, (18, 10), 7, 3)), Parameter(bias(spark, 10))
    return Sequential(conv, Relu(), MaxPool2(2), Flatten(), dense)


_CNN = f"""SELECT p.b AS i0, n.range AS i1, sum(p.v * (((p.o * 9 + p.y * 3 + p.z) * 7 + n.range * 3) % 11 - 5) / 10.0::DOUBLE) + any_value(bia.k) AS v
    FROM (SELECT b, o, y // 2 AS y, z // 2 AS z, max(greatest(v, 0)) AS v FROM ({_CONV}) GROUP BY ALL) p CROSS JOIN range(10) n JOIN bia ON bia.o = n.range GROUP BY ALL"""


@query(f"SELECT i0, i1, {_V} FROM ({_CNN})")
def q_cnn_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer by layer as relational plans."""
    return shown(cnn(spark)(vectors(spark, sf_dir, (1, 8, 8))).value)


@query(f"SELECT i0, i1, {_V} FROM ({_CNN})")
def q_cnn_forward_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same network by Arrow batches."""
    logits = predict(table(spark, sf_dir, "embeddings"), Net(cnn(spark), np.float64), (1, 8, 8), 1.0, "embedding", "vec_id")
    return shown(logits.select(F.col("row_id").alias("i0"), F.posexplode("logits").alias("i1", "v")).select("i0", F.col("i1").cast("long").alias("i1"), "v"))


@query(f"""SELECT count(*) AS count, round(sum(ln(s) - (q.v - m)), 4) AS loss FROM lab JOIN (SELECT i0, max(v) AS m FROM ({_CNN}) GROUP BY i0) a USING (i0)
    JOIN (SELECT i0, sum(exp(v)) * exp(-max(v)) AS s FROM ({_CNN}) GROUP BY i0) b USING (i0) JOIN ({_CNN}) q ON q.i0 = lab.i0 AND q.i1 = lab.t""")
def q_cnn_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = evaluate(table(spark, sf_dir, "embeddings"), Net(cnn(spark), np.float64), (1, 8, 8), 1.0, "embedding")
    return stats.select("count", F.round("loss", 4).alias("loss"))


def _cnn_step(k: int) -> str:
    """SQL of step k: forward, loss and gradients of cnn() from its parameters ker<k>, den<k>, off<k>."""
    return f"""
con{k} AS MATERIALIZED (SELECT img.b, q.o, img.h - q.fi AS y, img.w - q.fj AS z, sum(img.v * q.k) AS v FROM img JOIN ker{k} q ON img.h - q.fi BETWEEN 0 AND 5 AND img.w - q.fj BETWEEN 0 AND 5 GROUP BY ALL),
poo{k} AS MATERIALIZED (SELECT b, o, o * 9 + y // 2 * 3 + z // 2 AS i, y, z, v, greatest(v, 0) AS r FROM con{k} QUALIFY row_number() OVER (PARTITION BY b, o, y // 2, z // 2 ORDER BY greatest(v, 0) DESC, y, z) = 1),
log{k} AS MATERIALIZED (SELECT b, n, sum(r * w) + any_value(off{k}.v) AS v FROM poo{k} JOIN den{k} USING (i) JOIN off{k} USING (n) GROUP BY b, n),
top{k} AS (SELECT b, max(v) AS m FROM log{k} GROUP BY b),
exp{k} AS MATERIALIZED (SELECT b, n, t, v, m, exp(v - m) AS e, sum(exp(v - m)) OVER (PARTITION BY b) AS s FROM log{k} JOIN top{k} USING (b) JOIN lab ON lab.i0 = b),
sta{k} AS (SELECT {k} AS step, count(*) AS count, round(sum(ln(s) - (v - m)), 4) AS loss, (SELECT count(*) FROM (SELECT b FROM exp{k} GROUP BY b HAVING max(CASE WHEN n = t THEN v END) > max(CASE WHEN n <> t THEN v END))) AS correct FROM exp{k} WHERE n = t),
gra{k} AS MATERIALIZED (SELECT b, n, (e / s - CASE WHEN n = t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / (SELECT count(*) FROM lab) AS g FROM exp{k}),
gde{k} AS MATERIALIZED (SELECT i, n, sum(r * g) AS g FROM poo{k} JOIN gra{k} USING (b) GROUP BY i, n),
gof{k} AS MATERIALIZED (SELECT n, sum(g) AS g FROM gra{k} GROUP BY n),
bac{k} AS MATERIALIZED (SELECT b, i, sum(g * w) AS g FROM gra{k} JOIN den{k} USING (n) GROUP BY b, i),
gke{k} AS MATERIALIZED (SELECT p.o, fi.range AS fi, fj.range AS fj, sum(CASE WHEN p.v >= 0 THEN bac{k}.g ELSE 0 END * img.v) AS g
  FROM poo{k} p JOIN bac{k} USING (b, i) CROSS JOIN range(3) fi CROSS JOIN range(3) fj JOIN img ON img.b = p.b AND img.h = p.y + fi.range AND img.w = p.z + fj.range GROUP BY ALL)"""


_CNN_START = """
ker0 AS (SELECT o, fi, fj, k FROM ker), den0 AS (SELECT i.range AS i, n.range AS n, ((i.range * 7 + n.range * 3) % 11 - 5) / 10.0::DOUBLE AS w FROM range(18) i, range(10) n), off0 AS (SELECT o AS n, k AS v FROM bia),"""


_CNN_GRADIENTS = "SELECT 'layers.0.weight' AS param, o * 9 + fi * 3 + fj AS idx, round(g, 4) + 0.0 AS v FROM gke0 UNION ALL SELECT 'layers.4.weight', i * 10 + n, round(g, 4) + 0.0 FROM gde0 UNION ALL SELECT 'layers.4.bias', n, round(g, 4) + 0.0 FROM gof0"


def _cnn_update(k: int, rate: float, momentum: float) -> str:
    """SQL of the parameters and velocities after step k."""
    of = {"ker": ("o, fi, fj", "k", "gke"), "den": ("i, n", "w", "gde"), "off": ("n", "v", "gof")}
    out = []
    for name, (keys, v, grad) in of.items():
        before = f"{momentum}::DOUBLE * u.v + " if k else ""
        join = f" JOIN v{name}{k} u USING ({keys})" if k else ""
        out.append(f"v{name}{k + 1} AS MATERIALIZED (SELECT {keys}, {before}d.g AS v FROM {grad}{k} d{join})")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {keys}, p.{v} - {rate}::DOUBLE * q.v AS {v} FROM {name}{k} p JOIN (SELECT {keys}, v FROM v{name}{k + 1}) q USING ({keys}))")
    return ",\n".join(out)


@query(f""", {_CNN_START} {_cnn_step(0)}
{_CNN_GRADIENTS}""")
def q_cnn_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients of all parameters of the network, by the tape: one pass over the rows."""
    model = cnn(spark)
    model.init_parameter_grads()
    x, t = images_and_labels(spark, sf_dir)
    model(x).cross_entropy(t).backward()
    return shown(model.gradients(), 4)


@query(f""", {_CNN_START} {_cnn_step(0)}, {_cnn_update(0, 0.05, 0.9)}, {_cnn_step(1)}, {_cnn_update(1, 0.05, 0.9)}, {_cnn_step(2)}
SELECT * FROM sta0 UNION ALL SELECT * FROM sta1 UNION ALL SELECT * FROM sta2""")
def q_cnn_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics before each of three steps of gradient descent with momentum."""
    stats = train(table(spark, sf_dir, "embeddings"), Net(cnn(spark), np.float64), (1, 8, 8), 0.05, 0.9, steps=3, value="embedding")
    return spark.createDataFrame([(k, x["count"], round(float(x["loss"]), 4), x["correct"]) for k, x in enumerate(stats)], "step int, count long, loss double, correct long")


@query(f""", {_CNN_START} {_cnn_step(0)}
{_CNN_GRADIENTS}""")
def q_cnn_backward_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by relational plans over cells, with activations and gradients written as they come and removed after use."""
    model = cnn(spark)
    model.init_parameter_grads()
    x = vectors(spark, sf_dir, (1, 8, 8))
    with Checkpoints():
        model(TensorFrame(x.df, x.shape)).cross_entropy(labels(spark, sf_dir)).backward()
    return shown(model.gradients(), 4)


@query(f""", {_CNN_START} {_cnn_step(0)}, {_cnn_update(0, 0.05, 0.9)}, {_cnn_step(1)}, {_cnn_update(1, 0.05, 0.9)}, {_cnn_step(2)}
SELECT step, loss FROM sta0 UNION ALL SELECT step, loss FROM sta1 UNION ALL SELECT step, loss FROM sta2""")
def q_cnn_train_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss before each of three steps of momentum, by the tape; a step is one pass over the rows."""
    x, t = images_and_labels(spark, sf_dir)
    model, optimizer, losses = cnn(spark), SGD(0.9), []
    for k in range(3):
        model.init_parameter_grads()
        loss = model(x).cross_entropy(t)
        losses.append(loss.value.df.select(F.lit(k).alias("step"), F.round("v", 4).alias("loss")))
        if k < 2:
            loss.backward()
            model.update(optimizer, 0.05)
    return reduce(DataFrame.unionByName, losses)


_NAN = """nimg AS (SELECT b, h, w, CASE WHEN (b * 64 + h * 8 + w) % 7 = 3 THEN 'NaN'::DOUBLE ELSE v END AS v FROM img),
win AS (SELECT b, h // 2 AS y, w // 2 AS z, max(v) FILTER (h % 2 = 0 AND w % 2 = 0) AS v0, max(v) FILTER (h % 2 = 0 AND w % 2 = 1) AS v1, max(v) FILTER (h % 2 = 1 AND w % 2 = 0) AS v2, max(v) FILTER (h % 2 = 1 AND w % 2 = 1) AS v3 FROM nimg GROUP BY ALL),
on1 AS (SELECT *, CASE WHEN NOT isnan(v1) AND NOT isnan(v0) AND v1 > v0 THEN 1 ELSE 0 END AS t1, CASE WHEN NOT isnan(v1) AND NOT isnan(v0) AND v1 > v0 THEN v1 ELSE v0 END AS m1 FROM win),
on2 AS (SELECT *, CASE WHEN NOT isnan(v2) AND NOT isnan(m1) AND v2 > m1 THEN 2 ELSE t1 END AS t2, CASE WHEN NOT isnan(v2) AND NOT isnan(m1) AND v2 > m1 THEN v2 ELSE m1 END AS m2 FROM on1),
won AS (SELECT *, CASE WHEN NOT isnan(v3) AND NOT isnan(m2) AND v3 > m2 THEN 3 ELSE t2 END AS t, CASE WHEN NOT isnan(v3) AND NOT isnan(m2) AND v3 > m2 THEN v3 ELSE m2 END AS m FROM on2)"""


def _images_with_nan(spark: SparkSession, sf_dir: str) -> list[TensorFrame]:
    e = table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v, j: F.when((F.col("vec_id") * 64 + j) % 7 == 3, float("nan")).otherwise(v.cast("double"))).alias("x")
    dy = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: k.cast("double")).alias("dy")
    return TensorFrame.from_columns(e.select("vec_id", x, dy), "vec_id", {"x": (1, 8, 8), "dy": (1, 4, 4)})


@query(f", {_NAN} SELECT b AS i0, 0::BIGINT AS i1, y AS i2, z AS i3, CASE WHEN isnan(m) THEN -999.0::DOUBLE ELSE round(m, 6) + 0.0 END AS v FROM won")
def q_max_pool2_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN wins a window only as its first tap."""
    x, _ = _images_with_nan(spark, sf_dir)
    return shown(O.max_pool2(x, 2)).withColumn("v", F.when(F.isnan("v"), F.lit(-999.0)).otherwise(F.col("v")))


@query(f", {_NAN} SELECT nimg.b AS i0, 0::BIGINT AS i1, h AS i2, w AS i3, CASE WHEN won.t = h % 2 * 2 + w % 2 THEN y * 4 + z + 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM nimg JOIN won ON won.b = nimg.b AND won.y = h // 2 AND won.z = w // 2")
def q_max_pool2_nan_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, dy = _images_with_nan(spark, sf_dir)
    _, won = O.max_pool2_switches(x, 2)
    return shown(O.max_pool2_backward(x, dy, 2, won=won))


# --- What the others leave out --------------------------------------------------------------------


@query("SELECT round(sum(v) + 0.25 * (SELECT v FROM x WHERE i0 = 3 AND i1 = 5), 4) AS v FROM x")
def q_sum_with_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors(spark, sf_dir)
    return shown(O.sum_all(x, 0.25, O.index_axis(O.index_axis(x, 0, 3), 0, 5)), 4)


@query("SELECT y.i0, y.i1, round(0.5 * y.v + 2 * bia.k, 6) + 0.0 AS v FROM y JOIN bia ON bia.o = y.i1")
def q_gemm_alpha_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(O.dot(vectors(spark, sf_dir), weight(spark), alpha=0.5, beta=2.0, c=bias(spark, 10)))


_CLASSES = "cls AS (SELECT t AS i1, x.i1 AS k, sum(v) AS v FROM x JOIN lab USING (i0) GROUP BY ALL)"


@query("SELECT a.i0, b.i0 AS i1, round(sum(a.v * b.v), 4) + 0.0 AS v FROM x a JOIN x b ON a.i1 = b.i1 GROUP BY a.i0, b.i0")
def q_dot_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors by one another: a number for each pair, no side of which is driver data."""
    x = vectors(spark, sf_dir)
    return O.dot(x, x, tb=True).df.withColumn("v", rounded("v", 4) + F.lit(0.0))


@query(f", {_CLASSES} SELECT x.i0, cls.i1::BIGINT AS i1, round(sum(x.v * cls.v), 3) + 0.0 AS v FROM x JOIN cls ON cls.k = x.i1 GROUP BY ALL")
def q_dot_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors by the sums of each class's: no side is driver data, and the output has a column for each class."""
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: (c == F.col("label")).cast("double")).alias("hot")
    x, hot = TensorFrame.from_columns(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", one_hot), "vec_id", {"embedding": (64,), "hot": (10,)})
    return shown(O.dot(x, O.dot(hot, x, ta=True), tb=True), 3)


@query("SELECT a.i1 AS i0, b.i1, round(sum(a.v * b.v), 4) + 0.0 AS v FROM x a JOIN x b ON a.i0 = b.i0 GROUP BY ALL")
def q_dot_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products of all pairs of coordinates, by dense tiles of 16 by 16 and stretches of the long inner axis."""
    x = Tiles.of(vectors(spark, sf_dir), 16)
    return shown(x.transposed().dot(x, group=2).frame(), 4)


_BIN = "SELECT y.i0, y.i1, round({}, 6) + 0.0 AS v FROM y JOIN bia ON bia.o = y.i1"


def _binary(op: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(O.binary(op, 0.5, bias(spark, 10), O.dot(vectors(spark, sf_dir), weight(spark))))

    run.__name__ = f"q_binary_{op}"
    return run


for _op, _sql in (("add", "0.5 * bia.k + y.v"), ("mul", "0.5 * bia.k * y.v"), ("identity", "0.5 * bia.k")):
    query(_BIN.format(_sql))(_binary(_op))


@query("SELECT y.i0, y.i1, round(0.5 * bia.k / (y.v * y.v + 1), 6) + 0.0 AS v FROM y JOIN bia ON bia.o = y.i1")
def q_binary_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = O.dot(vectors(spark, sf_dir), weight(spark))
    return shown(O.binary("div", 0.5, bias(spark, 10), y.with_df(y.df.withColumn("v", F.col("v") * F.col("v") + 1))))


@query(f"SELECT i0, i1, {_V} FROM x")
def q_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tensor written with its shape and type, and read back."""
    path = scratch_path(spark, "tensor")
    vectors(spark, sf_dir).save(path)
    return shown(TensorFrame.load(spark, path))


@query("""SELECT a.range AS axis, CASE a.range WHEN 0 THEN 64 ELSE n END AS length, CASE a.range WHEN 0 THEN n ELSE 1 END AS stride, 64 * n AS size, true AS standard, 2 AS rank, 'f32' AS dtype, CASE a.range WHEN 0 THEN 63 ELSE n - 1 END AS last
    FROM range(2) a, (SELECT count(*) AS n FROM embeddings)""")
def q_inspectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tensor says of itself, beside the last index along each axis that its cells have."""
    x = O.cast(O.standard_layout(O.transpose(vectors(spark, sf_dir))).require(ndim=2), "f32").require(dtype="f32")
    said = [F.struct(F.lit(k).cast("long").alias("axis"), *[F.lit(v).cast("long").alias(c) for c, v in (("length", n), ("stride", s), ("size", x.size))], F.lit(x.is_standard_layout()).alias("standard"), F.lit(x.ndim).alias("rank"), F.lit(x.dtype).alias("dtype"), F.col(f"m{k}").alias("last")) for k, (n, s) in enumerate(zip(x.shape, x.strides, strict=True))]
    return x.df.agg(F.max("i0").alias("m0"), F.max("i1").alias("m1")).select(F.inline(F.array(*said)))


@query("""SELECT f.range AS kernel, p.range AS padding, s.range AS stride, d.range AS dilation, (8 + 2 * p.range - d.range * (f.range - 1) - 1) // s.range + 1 AS output,
    d.range * (f.range - 1) + 1 + s.range * ((8 + 2 * p.range - d.range * (f.range - 1) - 1) // s.range) - 2 * p.range AS input, ((8 + 2 * p.range - d.range * (f.range - 1) - 1) // s.range + 1) * ((8 + 2 * p.range - d.range * (f.range - 1) - 1) // s.range + 1) * n AS cells
    FROM range(1, 4) f, range(2) p, range(1, 3) s, range(1, 3) d, (SELECT count(*) AS n FROM embeddings)""")
def q_conv_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output lengths of convolutions of the images, the input lengths that these need, and the cells that there are."""
    x, found = vectors(spark, sf_dir, (1, 8, 8)), []
    for f, p, s, d in product(range(1, 4), range(2), range(1, 3), range(1, 3)):
        y = O.conv2(x, TensorFrame.from_numpy(spark, np.ones((1, 1, f, f))), None, p, s, d)
        said = {"kernel": f, "padding": p, "stride": s, "dilation": d, "output": K.conv_output(8, f, p, s, d), "input": K.conv_input(K.conv_output(8, f, p, s, d), f, p, s, d)}
        found.append(y.rows.agg(F.sum(F.size("value")).alias("cells")).select(*[F.lit(v).cast("long").alias(c) for c, v in said.items()], "cells"))
    return reduce(DataFrame.unionByName, found)


@query("SELECT i0, i1, CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE round_even(v * 2.0::DOUBLE ^ (7 - floor(log2(abs(v)))), 0) / 2.0::DOUBLE ^ (7 - floor(log2(abs(v)))) END AS v FROM x")
def q_half_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded to eight significant bits."""
    x = O.cast(vectors(spark, sf_dir), "bf16")
    return O.cast(x, "f64").df


@query("SELECT i0, i1, round(2 * CASE WHEN v >= 0 THEN v ELSE 0 END, 6) + 0.0 AS v FROM x")
def q_own_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of one's own by the order of its fields, with layers that are optional, chosen by name, or do nothing."""

    class Doubled(Layer):
        def forward(self, x: Variable) -> Variable:
            return Variable.custom(O.scaled_add(x.value, 1.0, x.value), [(x, lambda g: O.scaled_add(g, 1.0, g))])

    class Model(Layer):
        def __init__(self) -> None:
            self.first = Optional(None)
            self.nothing = None
            self.act = OneOf("relu", relu=Relu(), identity=Identity())
            self.rest = [Identity(), Doubled()]

    return shown(Model()(vectors(spark, sf_dir)).value)


@query("SELECT i0, i1, round(6 * (3 * v - 1) , 6) + 0.0 AS v FROM x")
def q_custom_operator_and_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of sum((3 x - 1)^2), both an operator and a loss of one's own."""
    x = Variable.leaf(vectors(spark, sf_dir))
    tripled = Variable.custom(O.scaled_cast(x.value, 3.0, "f64"), [(x, lambda g: O.scaled_cast(g, 3.0, "f64"))])
    less = tripled.value.with_df(tripled.value.df.withColumn("v", F.col("v") - 1))
    squares = O.sum_all(less.with_df(less.df.withColumn("v", F.col("v") * F.col("v"))))
    loss = Variable.custom(squares, [(tripled, lambda g: O.elementwise.zipped(less, g, lambda v, dy: 2 * v * dy))])
    loss.backward()
    return shown(x.grad)


@query("SELECT w.i0, w.i1, round(0.9 * w.v - 0.1 * 2 * dw.v, 6) + 0.0 AS v FROM w JOIN dw USING (i0, i1)")
def q_custom_optimizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An optimizer of one's own with a scalar and a tensor as state, saved after a step and resumed for another."""

    class Decay(Optimizer):
        def update(self, learning_rate: float, parameter: Parameter) -> None:
            if parameter.state_of != "decay":
                parameter.state, parameter.state_of = {"steps": 0.0, "sum": TensorFrame.zeros(spark, parameter.value.shape)}, "decay"
            grad = parameter.take_grad()
            parameter.state = {"steps": parameter.state["steps"] + 1, "sum": O.add_assign(parameter.state["sum"], grad)}
            if parameter.state["steps"] == 2:
                parameter.value = O.scaled_add(O.scaled_cast(parameter.value, 0.9, "f64"), -learning_rate, parameter.state["sum"])

    w = Variable.leaf(weight(spark))
    Variable(vectors(spark, sf_dir)).dot(w).cross_entropy(labels(spark, sf_dir)).backward()
    grad = TensorFrame.from_numpy(spark, w.grad.to_numpy())
    layer = Dense(spark, 64, 10)
    layer.weight = Parameter(weight(spark))
    for _ in range(2):
        layer.init_parameter_grads()
        layer.weight.to_variable().backward(grad)
        layer.update(Decay(), 0.1)
        save_model(layer, path := scratch_path(spark, "model"))
        layer = load_model(spark, path)
    return shown(layer.weight.value)


@query("""SELECT 'without' AS param, i1 AS i0, round(sum(v), 4) + 0.0 AS v, 0.0::DOUBLE AS velocity FROM x GROUP BY i1
    UNION ALL SELECT 'with', i1, round(sum(v) - 0.1 * any_value(n), 4) + 0.0, any_value(n)::DOUBLE FROM x, (SELECT count(*) AS n FROM embeddings) GROUP BY i1""")
def q_optimizer_without_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parameters of sums of the vectors' coordinates, one with the gradient of adding it to all vectors; the other's value stays, though its state is made."""
    x = vectors(spark, sf_dir)
    found = []
    for name in ("without", "with"):
        p = Parameter(O.sum_axis(x, 0))
        if name == "with":
            p.init_grad()
            Variable(x).add(p.to_variable()).backward()
        SGD(0.9).update(0.1, p)
        found.append(p.value.df.join(p.state["velocity"].df.withColumnRenamed("v", "velocity"), "i0").select(F.lit(name).alias("param"), "i0", "v", "velocity"))
    return shown(reduce(DataFrame.unionByName, found), 4)


@query("SELECT o AS i0, round((SELECT count(*) FROM embeddings) * 1.0::DOUBLE + k * 0, 6) AS v FROM bia")
def q_add_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of a bias that is broadcast and added; nothing flows to a value that isn't differentiated."""
    b, y = Variable.leaf(bias(spark, 10)), Variable(O.dot(vectors(spark, sf_dir), weight(spark)))
    y.add(b).backward()
    return shown(b.grad)


@query("SELECT i0, i1, round(i1 // 8 * 8 + i1 % 8 + i0, 6) * 1.0::DOUBLE AS v FROM x")
def q_reshape_permute_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gradient's way back through reshape and permute; each cell's is its own place."""
    x = Variable.leaf(vectors(spark, sf_dir))
    y = x.reshape((x.shape[0], 8, 8)).permute((2, 0, 1))
    y.backward(y.value.with_df(y.value.df.withColumn("v", (F.col("i2") * 8 + F.col("i0") + F.col("i1")).cast("double"))))
    return shown(x.grad)


_PIXEL = "greatest(least(trunc(v * 60 + 128), 255), 0)::SMALLINT"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixel = lambda v: F.greatest(F.least((v.cast("double") * 60 + 128).cast("long"), F.lit(255)), F.lit(0)).cast("smallint")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", pixel).alias("value"), F.array(F.col("label").cast("smallint")).alias("label"))


@query(f"SELECT i0 AS row_id, 'train' AS split, i1, {_PIXEL} AS v, t::SMALLINT AS label FROM x JOIN lab USING (i0)")
def q_digit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All images and labels written as IDX files, each by many tasks, and read back by ranges of bytes."""
    folder = scratch_path(spark, "digits")
    rows = _pixels(spark, sf_dir)
    n = rows.count()
    make_folder(spark, folder)
    write_idx(rows, f"{folder}/train-images-idx3-ubyte", (n, 8, 8))
    write_idx(rows, f"{folder}/train-labels-idx1-ubyte", (n,), value="label")
    found = digits(spark, folder, suffix="", shape=(8, 8))
    return found.select("row_id", "split", F.posexplode("value").alias("i1", "v"), "label").withColumn("i1", F.col("i1").cast("long"))


@query(f"SELECT (row_number() OVER (ORDER BY i0) - 1) AS row_id, (t % 3)::SMALLINT AS label, v::FLOAT AS v FROM (SELECT x.i0, t, {_PIXEL} AS v FROM x JOIN lab USING (i0) WHERE i1 = 0)")
def q_iris_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four measures and a named class a line, written from the first numbers of all vectors."""
    path = scratch_path(spark, "iris")
    names = F.lit(["Iris-setosa", "Iris-versicolor", "Iris-virginica"])
    rows = _pixels(spark, sf_dir).select("row_id", F.concat_ws(",", *[F.get("value", F.lit(k)).cast("string") for k in range(4)], F.get(names, (F.get("label", F.lit(0)) % 3).cast("int"))).alias("line"))
    rows.orderBy("row_id").select("line").write.text(path)
    return iris(spark, path).select("row_id", "label", F.get("value", F.lit(0)).alias("v"))


# --- Models and sums of any size ------------------------------------------------------------------


@query("SELECT i1 AS i0, round(sum((v * 1152921504606846976)::HUGEINT)::DOUBLE / 1152921504606846976, 9) + 0.0 AS v FROM x GROUP BY i1")
def q_sum_axis0_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that are rounded once, and the same under any partitioning."""
    return shown(O.sum_axis(vectors(spark, sf_dir), 0, exact=True), 9)


@query("SELECT w.i0, w.i1, round(w.v - 0.1 * dw.v, 6) + 0.0 AS v FROM w JOIN dw USING (i0, i1)")
def q_sharded_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of momentum of parameters that are tiles of a bucketed table, and never at the driver."""
    w = ShardedMatrix.of(weight(spark), edge=16, buckets=8)
    x, t = TensorFrame.from_columns(table(spark, sf_dir, "embeddings"), "vec_id", {"embedding": (64,), "label": ()})
    after, _ = softmax_step(x, t, w, 0.1, 0.9)
    return shown(after.frame())


@query("""SELECT i1 AS i0, t, round(ln(sum(exp(v - m))) - (max(v) FILTER (i0 = t) - any_value(m)), 6) + 0.0 AS loss, max(v) FILTER (i0 = t) > max(v) FILTER (i0 <> t) AS "right"
    FROM (SELECT x.i0, x.i1, v, ((x.i1 * 7919) % n)::INTEGER AS t, max(v) OVER (PARTITION BY x.i1) AS m FROM x, (SELECT count(*) AS n FROM embeddings)) GROUP BY i1, t""")
def q_wide_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates as samples and vectors as classes, as many as the table has: no row of them is put together."""
    x = vectors(spark, sf_dir)
    t = TensorFrame.from_numpy(spark, (np.arange(64) * 7919) % x.shape[0], "i32")
    return shown(wide_rows(O.transpose(x), t).select("i0", "t", "loss", "right"))


_BF16 = "CASE WHEN {0} = 0 THEN 0.0::DOUBLE ELSE round_even({0} * 2.0::DOUBLE ^ (7 - floor(log2(abs({0})))), 0) / 2.0::DOUBLE ^ (7 - floor(log2(abs({0})))) END"
_HX = f"hx AS (SELECT {', '.join(f'{_BF16.format(f"x{k}::DOUBLE")} AS x{k}' for k in range(4))}, t FROM {_LX})"
_HW = [[float(K.rounded_array(np.array(((2 * k + 3 * j) % 5 - 2) / 10), "bf16")) for j in range(3)] for k in range(4)]


@query(f""", {_HX}, hy AS (SELECT *, {", ".join(_BF16.format("(" + " + ".join(f"x{k} * {_HW[k][j]}::DOUBLE" for k in range(4)) + ")") + f" AS y{j}" for j in range(3))} FROM hx),
hg AS (SELECT *, {", ".join(_BF16.format(f"(exp(y{j}) / (exp(y0) + exp(y1) + exp(y2)) - (t = {j})::INTEGER)") + f" AS g{j}" for j in range(3))} FROM hy),
hd AS (SELECT {", ".join(f"sum(x{k} * g{j}) / count(*) AS d{k}{j}" for k in range(4) for j in range(3))} FROM hg),
hs AS ({" UNION ALL ".join(f"SELECT {k}::BIGINT AS i0, {j}::BIGINT AS i1, {_HW[k][j]}::DOUBLE - 0.5::DOUBLE * {_BF16.format(f'd{k}{j}')} AS s FROM hd" for k in range(4) for j in range(3))})
SELECT i0, i1, round({_BF16.format("s")}, 6) + 0.0 AS v FROM hs""")
def q_bf16_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of softmax regression over line items, all that is stored rounded to eight significant bits."""
    layer = Dense(spark, 4, 3, dtype="bf16")
    layer.weight = Parameter(O.cast(formula(spark, (4, 3), 2, 3, mod=5, less=2), "bf16"))
    net = Net(Sequential(layer))
    grads, _ = gradients(_line_items(spark, sf_dir), net, (4,))
    net.step(grads, 0.5)
    return shown(TensorFrame.from_numpy(spark, net.params["layers.0.weight"]))


@query("""SELECT x.i0, n.range AS i1, round(sum(p.v * (((p.o * 15 + p.q) * 7 + n.range * 3) % 11 - 5) / 10.0::DOUBLE), 6) + 0.0 AS v FROM lab x
    JOIN (SELECT i0, o, y // 4 AS q, max(greatest(v, 0)) AS v FROM (SELECT x.i0, k.o, x.i1 - k.f AS y, sum(x.v * k.k) AS v FROM x
      JOIN (SELECT o.range AS o, f.range AS f, ((o.range * 5 + f.range * 3) % 7 - 3) / 10.0::DOUBLE AS k FROM range(2) o, range(5) f) k ON x.i1 - k.f BETWEEN 0 AND 59 GROUP BY ALL) GROUP BY ALL) p USING (i0) CROSS JOIN range(10) n GROUP BY ALL""")
def q_fields_forward_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model by the order of its fields, of layers of one spatial axis, compiled for Arrow batches."""

    class Model(Layer):
        def __init__(self) -> None:
            self.conv, self.nothing = Conv1(spark, 1, 2, 5), None
            self.steps = [Relu(), [MaxPool1(4), Identity()]]
            self.flat = OneOf("flat", flat=Flatten())
            self.head = Dense(spark, 30, 10)

    model = Model()
    model.conv.weight, model.head.weight = Parameter(formula(spark, (2, 1, 5), 5, 1, 3, mod=7, less=3)), Parameter(formula(spark, (30, 10), 7, 3))
    logits = predict(table(spark, sf_dir, "embeddings"), Net(model, np.float64), (1, 64), 1.0, "embedding", "vec_id")
    return shown(logits.select(F.col("row_id").alias("i0"), F.posexplode("logits").alias("i1", "v")).select("i0", F.col("i1").cast("long").alias("i1"), "v"))
