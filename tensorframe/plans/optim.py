"""Optimizers, and the parameter table that keeps a model and its state."""

from __future__ import annotations

import json
from functools import reduce
from importlib import import_module

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorframe import types as K
from tensorframe.frame import TensorFrame
from tensorframe.operators import scaled_add
from tensorframe.plans.autograd import Parameter
from tensorframe.plans.layers import Layer


def zeros_like(x: TensorFrame) -> TensorFrame:
    """Zeros of a shape, at the driver if x is there."""
    return TensorFrame.zeros(x.spark, x.shape) if x.local is None else TensorFrame.from_numpy(x.spark, np.zeros(x.shape))


class Optimizer:
    def update(self, learning_rate: float, parameter: Parameter) -> None:
        raise NotImplementedError


class SGD(Optimizer):
    """w -= lr * g; with momentum v = m * v + g and w -= lr * v."""

    def __init__(self, momentum: float | None = None) -> None:
        self.momentum = momentum

    def update(self, learning_rate: float, parameter: Parameter) -> None:
        """Take the gradient; without one the value stays, though the state is made."""
        kind = f"sgd:{self.momentum is not None}"
        if parameter.state_of != kind:
            parameter.state = {} if self.momentum is None else {"velocity": zeros_like(parameter.value)}
            parameter.state_of = kind
        grad = parameter.take_grad()
        if grad is None:
            return
        if self.momentum is not None:
            grad = scaled_add(grad, self.momentum, parameter.state["velocity"])
            parameter.state["velocity"] = grad
        parameter.value = scaled_add(parameter.value, -learning_rate, grad)


def parameter_table(parameters: dict[str, Parameter]) -> DataFrame:
    """(param, slot, idx, v, text): values and state tensors row-major, scalars of the state, and the kind of state as text."""
    spark = next(iter(parameters.values())).value.spark
    frames, plain = [], []
    for name, p in parameters.items():
        plain.append((name, "state_of", 0, None, p.state_of))
        for slot, x in {"value": p.value, **p.state}.items():
            if isinstance(x, TensorFrame):
                frames.append(x.df.select(F.lit(name).alias("param"), F.lit(slot).alias("slot"), x.linear().alias("idx"), F.col("v").cast("double").alias("v"), F.lit(None).cast("string").alias("text")))
            else:
                plain.append((name, f"scalar:{slot}", 0, float(x), None))
    return reduce(DataFrame.unionByName, frames, spark.createDataFrame(plain, "param string, slot string, idx long, v double, text string"))


def save(parameters: dict[str, Parameter], path: str) -> None:
    parameter_table(parameters).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, parameters: dict[str, Parameter], path: str) -> None:
    """Put saved values and state back, so that training goes on as if it had not stopped, whatever the optimizer."""
    table = spark.read.parquet(path)
    plain = (F.col("slot") == "state_of") | F.startswith("slot", F.lit("scalar:"))
    slots = {(r.param, r.slot) for r in table.filter(~plain).select("param", "slot").distinct().collect()}
    # A few rows a parameter.
    kept = {(r.param, r.slot): r.text if r.slot == "state_of" else r.v for r in table.filter(plain).collect()}
    for name, p in parameters.items():
        of = lambda slot, n=name, shape=p.value.shape, dtype="f64": TensorFrame.from_linear(table.filter((F.col("param") == n) & (F.col("slot") == slot)).select(F.col("idx").alias("lin"), F.col("v").cast(K.spark_type(dtype)).alias("v")), shape, dtype)
        p.value = of("value", dtype=p.value.dtype)
        p.state = {s: of(s) for n, s in slots if n == name and s != "value"} | {s.removeprefix("scalar:"): v for (n, s), v in kept.items() if n == name and s != "state_of"}
        p.state_of = kept.get((name, "state_of"))


def _described(layer: Layer) -> dict:
    parts: dict = {}
    for name, x in vars(layer).items():
        if isinstance(x, Parameter):
            parts[name] = {"parameter": [list(x.value.shape), x.value.dtype]}
        elif isinstance(x, Layer):
            parts[name] = _described(x)
        elif isinstance(x, list | tuple) and any(isinstance(y, Layer) for y in x):
            parts[name] = [_described(y) if isinstance(y, Layer) else None for y in x]
    return {"class": [type(layer).__module__, type(layer).__qualname__], "options": layer.options(), "parts": parts, "order": list(vars(layer))}


def _rebuilt(spark: SparkSession, d: dict) -> Layer:
    kind = import_module(d["class"][0])
    for part in d["class"][1].split("."):
        kind = getattr(kind, part)
    if not (isinstance(kind, type) and issubclass(kind, Layer)):
        raise TypeError(f"{d['class']} is no layer")
    layer = kind.__new__(kind)
    for name in d["order"]:
        x = d["options"].get(name)
        if name in d["parts"]:
            x = d["parts"][name]
            if isinstance(x, list):
                x = [y and _rebuilt(spark, y) for y in x]
            elif "parameter" in x:
                x = Parameter(TensorFrame.zeros(spark, *x["parameter"]))
            else:
                x = _rebuilt(spark, x)
        setattr(layer, name, tuple(x) if isinstance(x, list) and name not in d["parts"] else x)
    return layer


def save_model(model: Layer, path: str) -> None:
    """Layers with their options (as JSON), parameters, and the optimizer's state."""
    parameters = dict(model.parameters())
    if parameters:
        save(parameters, f"{path}/parameters")
    spark = next(iter(parameters.values())).value.spark if parameters else SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(_described(model)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> Layer:
    """A model as save_model() left it; classes of one's own must be importable."""
    model = _rebuilt(spark, json.loads(spark.read.text(f"{path}/model").first()[0]))
    parameters = dict(model.parameters())
    if parameters:
        load(spark, parameters, f"{path}/parameters")
    return model
