"""Training and evaluation over dense rows by Arrow batches.

Rows are (row_id, value array, label).  Parameters travel to the executors with
the task (their size is the model's); each partition adds up its gradients, and
one aggregate by parameter adds the partitions up, so what reaches the driver has
the model's size whatever the data's.  The gradient of a batch's mean loss is the
sum over its rows divided by their number, so a batch may be any part of the data.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorframe import kernels as array_kernels
from tensorframe import types as K
from tensorframe.frame import TensorFrame
from tensorframe.plans import kernels, layers
from tensorframe.plans.autograd import Parameter
from tensorframe.plans.layers import Layer, Sequential
from tensorframe.scratch import materialize

cloudpickle.register_pickle_by_value(array_kernels)
cloudpickle.register_pickle_by_value(kernels)
cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: Rows that go through the layers at a time: few enough for a core's caches.
ROWS = 128
#: Numbers in a piece of a partition's gradients.
PIECE = 8192


#: Layer type: what its kernels are, as (kernel, options) from a layer; kernels of one's own are added by compiled().
_COMPILERS: dict[type, Callable[[Layer], list[tuple]]] = {}
_SLOTS = ("weight", "bias")


def compiled(kind: type, kernel: tuple[Callable, Callable], options: Callable[[Layer], object] = lambda layer: None) -> None:
    """From now on layers of a type run by a pair of NumPy functions (see kernels.py); their parameters come in the order of their attributes."""
    _COMPILERS[kind] = lambda layer: [(kernel, options(layer), True)]


def _window(layer) -> tuple:
    kernel = K.pair(layer.kernel)
    return kernel, kernel if layer.stride is None else K.pair(layer.stride)


def _conv_options(layer) -> tuple:
    return tuple(K.pair(layer.conv[o]) for o in ("padding", "stride", "dilation"))


compiled(layers.Dense, kernels.DENSE)
compiled(layers.Conv2, kernels.CONV, _conv_options)
compiled(layers.MaxPool2, kernels.POOL, _window)
compiled(layers.Relu, kernels.RELU)
compiled(layers.Flatten, kernels.FLATTEN)
_COMPILERS[layers.Conv1] = lambda layer: [(kernels.WIDEN, None, False), (kernels.CONV, _conv_options(layer), True), (kernels.NARROW, None, False)]
_COMPILERS[layers.MaxPool1] = lambda layer: [(kernels.WIDEN, None, False), (kernels.POOL, _window(layer), False), (kernels.NARROW, None, False)]
_COMPILERS[layers.Identity] = lambda layer: []


class Net:
    """A model as kernels: plan, parameters, velocities.

    Layers of types that compiled() knows become kernels; any other layer is gone
    through by the order of its fields (lists too; None is left out), unless it
    has a forward() of its own, which only the tape can run.  dtype "bf16" (the
    default if a parameter has it): parameters, velocities, values and gradients
    are numbers of bfloat16, sums and updates are computed in 32 bits; with
    master, parameters and velocities keep 32 bits, and layers see them rounded.
    """

    def __init__(self, model: Layer, dtype=None, master: bool = False) -> None:
        self.plan: list = []
        self.params: dict[str, np.ndarray] = {}
        self.velocity: dict[str, np.ndarray] = {}
        if dtype is None:
            dtype = "bf16" if any(p.dtype == "bf16" for _, p in model.parameters()) else np.float32
        self.half, self.dtype = dtype == "bf16", np.float32 if dtype == "bf16" else dtype
        self.rounded = self.half and not master
        self._compile("", model)

    def _stored(self, a: np.ndarray) -> np.ndarray:
        return array_kernels.to_bf16(a) if self.rounded else np.asarray(a, self.dtype)

    def seen(self) -> dict[str, np.ndarray]:
        """The parameters as layers see them."""
        return {n: array_kernels.to_bf16(p) for n, p in self.params.items()} if self.half and not self.rounded else self.params

    def _compile(self, path: str, layer: Layer) -> None:
        make = next((_COMPILERS[t] for t in type(layer).__mro__ if t in _COMPILERS and (t is type(layer) or t.forward is type(layer).forward)), None)
        if make is not None:
            names = []
            own = [(s, getattr(layer, s, None)) for s in _SLOTS] if any(hasattr(layer, s) for s in _SLOTS) else []
            own += [(s, p) for s, p in vars(layer).items() if s not in _SLOTS]
            for slot, p in own:
                if isinstance(p, Parameter):
                    names.append(f"{path}{slot}")
                    self.params[names[-1]] = self._stored(p.value.to_numpy())
            self.plan += [(kernel, options, names if has else []) for kernel, options, has in make(layer)]
        elif type(layer).forward in (Layer.forward, Sequential.forward):
            for name, x in vars(layer).items():
                if isinstance(x, Layer):
                    self._compile(f"{path}{name}.", x)
                elif isinstance(x, list | tuple):
                    self._listed(f"{path}{name}.", x)
        else:
            raise TypeError(f"{type(layer).__name__} has no kernel; give it one by compiled(), or train it on the tape")

    def _listed(self, path: str, parts) -> None:
        for k, x in enumerate(x for x in parts if x is not None):
            if isinstance(x, list | tuple):
                self._listed(f"{path}{k}.", x)
            elif isinstance(x, Layer):
                self._compile(f"{path}{k}.", x)

    def frames(self, spark) -> dict[str, TensorFrame]:
        return {n: TensorFrame.from_numpy(spark, p) for n, p in self.params.items()}

    def step(self, grads: dict[str, np.ndarray], learning_rate: float, momentum: float | None = None) -> None:
        for n, g in grads.items():
            if self.half:
                g = array_kernels.to_bf16(g)
            if momentum is not None:
                g = momentum * self.velocity.get(n, 0) + g
                self.velocity[n] = self._stored(g) if self.half else g
            self.params[n] = self._stored(self.params[n] - learning_rate * g)

    def save(self, spark, path: str) -> None:
        """The parameter table: values and velocities."""
        rows = [(n, slot, i, float(v)) for slot, arrays in (("value", self.params), ("velocity", self.velocity)) for n, a in arrays.items() for i, v in enumerate(np.ravel(a))]
        spark.createDataFrame(rows, "param string, slot string, idx long, v double").coalesce(1).write.mode("overwrite").parquet(path)

    def load(self, spark, path: str) -> None:
        t = spark.read.parquet(path).filter(F.col("slot").isin("value", "velocity")).toPandas().sort_values(["param", "slot", "idx"])
        for (n, slot), g in t.groupby(["param", "slot"]):
            (self.params if slot == "value" else self.velocity)[n] = g.v.to_numpy().astype(self.dtype).reshape(self.params[n].shape)


def _arrays(b: pa.RecordBatch, shape: tuple[int, ...], dtype, scale: float, half: bool) -> np.ndarray:
    values = b.column(0).flatten().to_numpy(zero_copy_only=False)
    x = values.astype(dtype).reshape(b.num_rows, *shape)
    x = x if scale == 1 else x * dtype(scale)
    return array_kernels.to_bf16(x) if half else x


def predict(rows: DataFrame, net: Net, shape: tuple[int, ...], scale: float = 1.0, value: str = "value", row_id: str = "row_id") -> DataFrame:
    """(row_id, logits)."""
    plan, params, dtype, half = net.plan, net.seen(), net.dtype, net.half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                y = kernels.forward(plan, params, _arrays(part, shape, dtype, scale, half), half=half).astype(np.float64)
                ends = np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(y.reshape(-1)))], names=["row_id", "logits"])

    return rows.select(value, F.col(row_id).cast("long")).mapInArrow(run, "row_id long, logits array<double>")


def evaluate(rows: DataFrame, net: Net, shape: tuple[int, ...], scale: float = 1.0, value: str = "value", label: str = "label") -> DataFrame:
    """One row: count, loss, mean_loss, correct, accuracy in percent."""
    plan, params, dtype, half = net.plan, net.seen(), net.dtype, net.half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                total, correct, _ = kernels.loss(kernels.forward(plan, params, _arrays(part, shape, dtype, scale, half), half=half), part.column(1).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_pydict({"n": [part.num_rows], "loss": [total], "correct": [correct]})

    sums = rows.select(value, F.col(label).cast("int")).mapInArrow(run, "n long, loss double, correct long").agg(F.sum("n").alias("count"), F.sum("loss").alias("loss"), F.sum("correct").alias("correct"))
    return sums.select("count", "loss", (F.col("loss") / F.col("count")).alias("mean_loss"), "correct", (100.0 * F.col("correct") / F.col("count")).alias("accuracy"))


def _pieces(flat: np.ndarray, piece: int) -> Iterator[pa.RecordBatch]:
    """(piece, values) of a vector."""
    for k, at in enumerate(range(0, len(flat), piece)):
        part = flat[at : at + piece]
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))], names=["piece", "v"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one piece added up, one after another."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            v = v.values.to_numpy()
            sums[k] = sums[k] + v if k in sums else v
    for k, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))], names=["piece", "v"])


def gradients(rows: DataFrame, net: Net, shape: tuple[int, ...], scale: float = 1.0, value: str = "value", label: str = "label") -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Gradient of the mean loss over the rows, and their stats.

    A partition's sums leave it as a few pieces of one vector, which meet by piece.
    """
    plan, params, dtype, half = net.plan, net.seen(), net.dtype, net.half
    names, piece = list(params), PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros(params[n].size, np.float64) for n in names}
        stats = np.zeros(3)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                kept: list = []
                logits = kernels.forward(plan, params, _arrays(part, shape, dtype, scale, half), kept, half)
                total, correct, g = kernels.loss(logits, part.column(1).to_numpy(zero_copy_only=False))
                for n, d in kernels.backward(plan, params, kept, array_kernels.to_bf16(g) if half else g, half).items():
                    sums[n] += d.reshape(-1)
                stats += (part.num_rows, total, correct)
        if stats[0]:
            yield from _pieces(np.concatenate([stats, *sums.values()]), piece)

    n = -(-(3 + sum(p.size for p in params.values())) // piece)
    width = min(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "piece int, v array<double>"
    t = rows.select(value, F.col(label).cast("int")).mapInArrow(run, schema).repartition(width, "piece").mapInArrow(_added, schema).toArrow().sort_by("piece")
    flat = np.concatenate([x.values.to_numpy() for c in t.column("v").chunks for x in c]) if t.num_rows else np.zeros(3 + sum(p.size for p in params.values()))
    count, at, grads = flat[0], 3, {}
    for name, p in params.items():
        grads[name] = (flat[at : at + p.size] / max(count, 1)).reshape(p.shape)
        at += p.size
    return grads, {"count": int(count), "loss": float(flat[1]), "correct": int(flat[2])}


def train(rows: DataFrame, net: Net, shape: tuple[int, ...], learning_rate: float, momentum: float | None = None, steps: int = 1, scale: float = 1.0, value: str = "value", label: str = "label") -> list[dict[str, float]]:
    """Steps of gradient descent, each over all rows; the stats before each."""
    out = []
    for _ in range(steps):
        grads, stats = gradients(rows, net, shape, scale, value, label)
        net.step(grads, learning_rate, momentum)
        out.append(stats)
    return out


def train_batches(batched: DataFrame, net: Net, shape: tuple[int, ...], learning_rate: float, momentum: float | None = None, **options) -> list[dict[str, float]]:
    """An epoch of steps over a frame with a batch_id.

    The rows are laid out by batch once, so that a step reads its own batch only.
    """
    laid = materialize(batched, "batches", by="batch_id")
    most = laid.agg(F.max("batch_id")).first()[0]
    out = []
    for k in range(-1 if most is None else int(most) + 1):
        out += train(laid.filter(F.col("batch_id") == k), net, shape, learning_rate, momentum, **options)
    return out
