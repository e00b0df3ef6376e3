"""Parameters that are never at the driver, nor whole in any task.

A matrix of parameters is a bucketed table of dense tiles with the optimizer's
state beside them: (ti, tj, value, velocity), in BUCKETS buckets by place.  The
gradient of a step comes as tiles, shuffled by place into as many partitions, so
value, state and gradient of a tile meet by a merge join that shuffles neither
table; the result is the next version of the table, and the one before goes.

softmax_step() is a step of a linear classifier of any size: logits are a product
of tiles, a row's loss is merged from the blocks of classes that its logits are
spread over (largest logit, scaled sum, label's logit), the logits' gradient is
made tile by tile, and the weights' is a product of tiles again.  What a task
holds are tiles; what reaches the driver are the step's three sums.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorframe import kernels
from tensorframe import types as K
from tensorframe.frame import TensorFrame
from tensorframe.operators import tiles as tile_module
from tensorframe.operators.tiles import EDGE, Tiles
from tensorframe.scratch import discard, materialize, scratch_path

for _module in (kernels, tile_module, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

BUCKETS = 32
_META = "shape.json"


class ShardedMatrix:
    """[m, n] of parameters and, with momentum, their velocities, as a bucketed table."""

    def __init__(self, spark: SparkSession, name: str, shape: tuple[int, int], edge: int, buckets: int) -> None:
        self.spark, self.name, self.shape, self.edge, self.buckets = spark, name, tuple(shape), edge, buckets

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    @classmethod
    def _write(cls, df: DataFrame, shape, edge: int, buckets: int) -> ShardedMatrix:
        spark, name = df.sparkSession, f"tensorframe_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, "ti", "tj").sortBy("ti", "tj").option("path", scratch_path(spark, "parameters")).saveAsTable(name)
        return cls(spark, name, shape, edge, buckets)

    @classmethod
    def of(cls, x: Tiles | TensorFrame, edge: int = EDGE, buckets: int = BUCKETS) -> ShardedMatrix:
        """From values that are somewhere already."""
        x = x if isinstance(x, Tiles) else Tiles.of(x, edge)
        df = x.df.select("ti", "tj", F.col("tile").alias("value"), F.lit(None).cast("array<double>").alias("velocity"))
        return cls._write(df.repartition(buckets, "ti", "tj"), x.shape, x.edge, buckets)

    @classmethod
    def uniform(cls, spark: SparkSession, shape: tuple[int, int], seed: int = 0, edge: int = EDGE, buckets: int = BUCKETS) -> ShardedMatrix:
        """U[-a, a) with a = sqrt(2 / inputs), each tile from a generator of its own: made where it is."""
        m, n = shape
        a, rows, columns = np.sqrt(2 / max(m, 1)), -(-m // edge), -(-n // edge)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    ti, tj = divmod(k, columns)
                    tile = np.random.default_rng((seed, ti, tj)).uniform(-a, a, min(edge, m - ti * edge) * min(edge, n - tj * edge))
                    yield tile_module._tile(ti, tj, tile).to_batches()[0]

        tiles = spark.range(rows * columns).mapInArrow(run, "ti long, tj long, tile array<double>")
        return cls.of(Tiles(tiles, (m, n), edge), edge, buckets)

    def tiles(self, slot: str = "value") -> Tiles:
        return Tiles(self.df.select("ti", "tj", F.col(slot).alias("tile")), self.shape, self.edge)

    def frame(self, slot: str = "value") -> TensorFrame:
        return self.tiles(slot).frame()

    def stepped(self, grad: Tiles, learning_rate: float, momentum: float | None = None) -> DataFrame:
        """The next version's rows.  A tile without a gradient keeps its value and state."""
        if grad.shape != self.shape or grad.edge != self.edge:
            raise K.ShapeError(f"a gradient of {grad.shape} for parameters of {self.shape}")
        g = grad.df.select("ti", "tj", F.col("tile").alias("g")).repartition(self.buckets, "ti", "tj").hint("merge")
        joined = self.df.join(g, ["ti", "tj"], "left")
        plus = lambda x, y, by: F.zip_with(x, y, lambda a, b: a + b * F.lit(float(by)))
        if momentum is None:
            step, velocity = F.col("g"), F.col("velocity")
        else:
            step = velocity = F.when(F.col("g").isNull(), F.col("velocity")).when(F.col("velocity").isNull(), F.col("g")).otherwise(plus("g", "velocity", momentum))
        moved = joined.withColumn("_v", step).withColumn("value", F.when(F.col("g").isNull(), F.col("value")).otherwise(plus("value", "_v", -learning_rate)))
        return moved.select("ti", "tj", "value", (F.col("velocity") if momentum is None else F.col("_v")).alias("velocity"))

    def step(self, grad: Tiles, learning_rate: float, momentum: float | None = None) -> ShardedMatrix:
        """w -= lr·g; with momentum v = m·v + g and w -= lr·v.  This version's table goes."""
        out = self._write(self.stepped(grad, learning_rate, momentum), self.shape, self.edge, self.buckets)
        self.drop()
        return out

    def drop(self) -> None:
        files = self.df.inputFiles()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        for folder in {p.rpartition("/")[0] for p in files}:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def save(self, path: str) -> None:
        """Values and state, with the shape beside them: training goes on from there."""
        self.df.write.mode("overwrite").parquet(f"{path}/tiles")
        meta = json.dumps({"shape": self.shape, "edge": self.edge, "buckets": self.buckets})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{_META}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ShardedMatrix:
        meta = json.loads(spark.read.text(f"{path}/{_META}").first()[0])
        return cls._write(spark.read.parquet(f"{path}/tiles").repartition(meta["buckets"], "ti", "tj"), meta["shape"], meta["edge"], meta["buckets"])


def _labels(target: TensorFrame, edge: int) -> DataFrame:
    """(ti, at, labels): those of each row of tiles."""
    rows = target.df.groupBy(F.expr(f"i0 div {edge}L").alias("ti")).agg(F.sort_array(F.collect_list(F.struct((F.col("i0") % edge).cast("int").alias("at"), F.col("v").cast("double").alias("v")))).alias("l"))
    return rows.select("ti", F.transform("l", lambda x: x["v"]).alias("labels"))


def class_states(logits: Tiles, target: TensorFrame) -> DataFrame:
    """(ti, m, s, xt, rest, labels): for the rows of each row of tiles, largest logit, sum of exponentials scaled by it, label's logit, largest of the others.

    Each tile gives the state of its block of classes; states are merged one after another.
    """
    (n, classes), edge = logits.shape, logits.edge

    def of_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ti, tj = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                labels = kernels.checked(b.column(3)[r].values.to_numpy(), classes)
                x = b.column(2)[r].values.to_numpy().reshape(len(labels), -1)
                own = labels - tj * edge
                mine = (own >= 0) & (own < x.shape[1])
                at = np.flatnonzero(mine), own[mine]
                m = x.max(axis=1)
                s = np.exp(x - m[:, None]).sum(axis=1)
                xt = np.full(len(x), -np.inf)
                xt[mine] = x[at]
                others = x.copy()
                others[at] = -np.inf
                yield _state(ti, m, s, xt, others.max(axis=1), labels)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ti, state = None, None
        for b in batches:
            for r in range(b.num_rows):
                new = [b.column(k)[r].values.to_numpy() for k in range(1, 6)]
                if b.column(0)[r].as_py() != ti:
                    if ti is not None:
                        yield _state(ti, *state)
                    ti, state = b.column(0)[r].as_py(), new
                    continue
                m = np.maximum(state[0], new[0])
                s = state[1] * np.exp(state[0] - m) + new[1] * np.exp(new[0] - m)
                state = [m, s, np.maximum(state[2], new[2]), np.maximum(state[3], new[3]), state[4]]
        if ti is not None:
            yield _state(ti, *state)

    schema = "ti long, m array<double>, s array<double>, xt array<double>, rest array<double>, labels array<double>"
    parts = logits.df.join(_labels(target, edge), "ti").select("ti", "tj", "tile", "labels").mapInArrow(of_tile, schema)
    return parts.repartition("ti").sortWithinPartitions("ti").mapInArrow(merged, schema)


def _state(ti: int, *arrays: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(np.asarray(a, np.float64))) for a in arrays]
    return pa.RecordBatch.from_arrays([pa.array([ti], pa.int64()), *lists], names=["ti", "m", "s", "xt", "rest", "labels"])


def state_stats(states: DataFrame) -> DataFrame:
    """One row: count, loss, correct."""
    rows = states.select(F.inline(F.arrays_zip("m", "s", "xt", "rest")))
    right = (F.col("xt") > F.col("rest")) & ~F.isnan("xt") & ~F.isnan("rest")
    return rows.agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(F.log("s") - (F.col("xt") - F.col("m"))), F.lit(0.0)).alias("loss"), F.count_if(right).alias("correct"))


def logits_gradient(logits: Tiles, states: DataFrame) -> Tiles:
    """Of the mean loss, tile by tile."""
    n, edge = logits.shape[0], logits.edge

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ti, tj = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                m, s, labels = (b.column(k)[r].values.to_numpy() for k in (3, 4, 5))
                g = np.exp(b.column(2)[r].values.to_numpy().reshape(len(m), -1) - m[:, None]) / s[:, None]
                own = labels.astype(np.int64) - tj * edge
                mine = (own >= 0) & (own < g.shape[1])
                g[np.flatnonzero(mine), own[mine]] -= 1
                yield tile_module._tile(ti, tj, g / n).to_batches()[0]

    joined = logits.df.join(states.select("ti", "m", "s", "labels").hint("merge"), "ti").select("ti", "tj", "tile", "m", "s", "labels")
    return Tiles(joined.mapInArrow(run, "ti long, tj long, tile array<double>"), logits.shape, edge)


def softmax_step(x: TensorFrame, target: TensorFrame, w: ShardedMatrix, learning_rate: float, momentum: float | None = None) -> tuple[ShardedMatrix, dict[str, float]]:
    """A step of softmax regression over all rows, and the statistics before it.

    Logits and states are written to the shared folder, as both are read twice.
    """
    rows = Tiles.of(x, w.edge)
    logits_table = materialize(rows.dot(w.tiles()).df, "logits")
    logits = Tiles(logits_table, (x.shape[0], w.shape[1]), w.edge)
    states = materialize(class_states(logits, target), "states")
    stats = state_stats(states).first().asDict()
    after = w.step(rows.transposed().dot(logits_gradient(logits, states)), learning_rate, momentum)
    discard(logits_table), discard(states)
    return after, stats
