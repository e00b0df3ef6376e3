"""Layers: composable pieces with parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tensorframe import types as K
from tensorframe.frame import TensorFrame
from tensorframe.plans.autograd import Parameter, Variable, gradient_table


def run_through(parts, x: Variable) -> Variable:
    """x through the layers among parts (and in lists), in order; None, for a layer that is not there, passes it on."""
    for part in parts:
        if isinstance(part, list | tuple):
            x = run_through(part, x)
        elif isinstance(part, Layer):
            x = part(x)
    return x


class Layer:
    """Attributes that are parameters or layers (also in lists, or None) are found by themselves.

    A model without a forward() of its own passes its input through the layers
    among its attributes, in the order in which they were set; None is left out.
    """

    def forward(self, x: Variable) -> Variable:
        return run_through(vars(self).values(), x)

    def __call__(self, x: Variable | TensorFrame) -> Variable:
        return self.forward(x if isinstance(x, Variable) else Variable(x))

    def parameters(self, prefix: str = "") -> Iterator[tuple[str, Parameter]]:
        for name, x in vars(self).items():
            for k, y in enumerate(x) if isinstance(x, list | tuple) else [(None, x)]:
                path = f"{prefix}{name}" if k is None else f"{prefix}{name}.{k}"
                if isinstance(y, Parameter):
                    yield path, y
                elif isinstance(y, Layer):
                    yield from y.parameters(f"{path}.")

    def for_each_parameter(self, f: Callable[[Parameter], None]) -> None:
        for _, p in self.parameters():
            f(p)

    def try_for_each_parameter(self, f: Callable[[str, Parameter], None]) -> None:
        """f of each path and parameter, until one fails: that one is named, and what follows isn't visited."""
        for path, p in self.parameters():
            try:
                f(path, p)
            except Exception as e:
                e.add_note(f"at parameter {path}")
                raise

    def edit_parameters(self, f: Callable[[str, TensorFrame], TensorFrame | None]) -> None:
        """New values from f of each path and value (None: as it is), all of them or, if one fails or doesn't fit, none."""
        new: list[tuple[Parameter, TensorFrame]] = []

        def visit(path: str, p: Parameter) -> None:
            value = f(path, p.value)
            if value is not None:
                p.check(value)
                new.append((p, value))

        self.try_for_each_parameter(visit)
        for p, value in new:
            p.assign(value)

    def init_parameter_grads(self) -> None:
        self.for_each_parameter(Parameter.init_grad)

    def gradients(self) -> DataFrame:
        """(param, idx, v) of all parameters with a gradient."""
        return gradient_table(self.parameters())

    def update(self, optimizer, learning_rate: float) -> None:
        """A step of each parameter.

        Parameters at the driver whose gradients are sums over row blocks get them
        there, all in one pass over the rows, and stay at the driver; other steps
        only make plans longer.
        """
        own = {name: p for name, p in self.parameters() if p.value.local is not None and p.grad is not None and p.grad.sums is not None}
        if own:
            found = gradient_table(own.items()).toArrow().to_pandas().set_index("idx")
            for name, p in own.items():
                g = found.v[found.param == name].sort_index()
                p.set_grad(TensorFrame.from_numpy(p.value.spark, g.to_numpy().reshape(p.shape)))
        for _, p in self.parameters():
            optimizer.update(learning_rate, p)

    def cast(self, dtype: str) -> None:
        for _, p in self.parameters():
            p.cast(dtype)

    def options(self) -> dict:
        """What a saved model needs besides parameters and inner layers: plain attributes."""
        return {k: v for k, v in vars(self).items() if isinstance(v, str | int | float | bool | None | dict) or (isinstance(v, list | tuple) and not any(isinstance(y, Layer | Parameter) for y in v))}


class Optional(Layer):
    """A layer or None, which passes the input on."""

    def __init__(self, layer: Layer | None) -> None:
        self.layer = layer


class OneOf(Layer):
    """The one of several layers, by name, that is chosen; only its parameters are the model's."""

    def __init__(self, chosen: str, **layers: Layer) -> None:
        self.chosen, self.layer = chosen, layers[chosen]


def _uniform(spark: SparkSession, shape: tuple[int, ...], inputs: int, seed: int, dtype: str = "f64") -> Parameter:
    a = np.sqrt(2 / inputs)
    return Parameter(TensorFrame.from_numpy(spark, np.random.default_rng(seed).uniform(-a, a, shape), dtype))


class Dense(Layer):
    """x·W (+ b), W of [inputs, outputs]."""

    def __init__(self, spark: SparkSession, inputs: int, outputs: int, bias: bool = False, seed: int = 0, dtype: str = "f64") -> None:
        self.weight = _uniform(spark, (inputs, outputs), inputs, seed, dtype)
        self.bias = _uniform(spark, (outputs,), inputs, seed + 1, dtype) if bias else None

    def forward(self, x: Variable) -> Variable:
        y = x.dot(self.weight.to_variable())
        return y.add(self.bias.to_variable()) if self.bias else y


class Conv2(Layer):
    """W of [outputs, inputs, fh, fw]; the bias is one for each output channel."""

    def __init__(self, spark: SparkSession, inputs: int, outputs: int, kernel, padding=0, stride=1, dilation=1, bias: bool = False, seed: int = 0, dtype: str = "f64") -> None:
        kernel = K.pair(kernel)
        self.conv = {"padding": padding, "stride": stride, "dilation": dilation}
        self.weight = _uniform(spark, (outputs, inputs, *kernel), inputs * kernel[0] * kernel[1], seed, dtype)
        self.bias = _uniform(spark, (outputs,), inputs * kernel[0] * kernel[1], seed + 1, dtype) if bias else None

    def forward(self, x: Variable) -> Variable:
        y = x.conv2(self.weight.to_variable(), **self.conv)
        return y.add(self.bias.to_variable().reshape((y.shape[1], 1, 1))) if self.bias else y


class Conv1(Layer):
    """W of [outputs, inputs, f] over [n, c, h]."""

    def __init__(self, spark: SparkSession, inputs: int, outputs: int, kernel: int, padding: int = 0, stride: int = 1, dilation: int = 1, bias: bool = False, seed: int = 0, dtype: str = "f64") -> None:
        self.conv = {"padding": (padding, 0), "stride": (stride, 1), "dilation": (dilation, 1)}
        self.weight = _uniform(spark, (outputs, inputs, kernel), inputs * kernel, seed, dtype)
        self.bias = _uniform(spark, (outputs,), inputs * kernel, seed + 1, dtype) if bias else None

    def forward(self, x: Variable) -> Variable:
        w = self.weight.to_variable()
        y = x.reshape((*x.shape, 1)).conv2(w.reshape((*w.shape, 1)), **self.conv)
        y = y.reshape(y.shape[:3])
        return y.add(self.bias.to_variable().reshape((y.shape[1], 1))) if self.bias else y


class MaxPool2(Layer):
    def __init__(self, kernel, stride=None) -> None:
        self.kernel, self.stride = kernel, stride

    def forward(self, x: Variable) -> Variable:
        return x.max_pool2(self.kernel, self.stride)


class MaxPool1(Layer):
    def __init__(self, kernel: int, stride: int | None = None) -> None:
        self.kernel, self.stride = (kernel, 1), None if stride is None else (stride, 1)

    def forward(self, x: Variable) -> Variable:
        y = x.reshape((*x.shape, 1)).max_pool2(self.kernel, self.stride)
        return y.reshape(y.shape[:3])


class Flatten(Layer):
    def forward(self, x: Variable) -> Variable:
        return x.flatten()


class Identity(Layer):
    def forward(self, x: Variable) -> Variable:
        return x


class Relu(Layer):
    def forward(self, x: Variable) -> Variable:
        return x.relu()


class Sequential(Layer):
    """Layers in order; None among them passes its input on."""

    def __init__(self, *layers: Layer | None) -> None:
        self.layers = list(layers)

    def forward(self, x: Variable) -> Variable:
        return run_through(self.layers, x)


def lenet5(spark: SparkSession, seed: int = 0) -> Sequential:
    """For [n, 1, 28, 28] images and ten classes."""
    return Sequential(
        Conv2(spark, 1, 6, 5, seed=seed), Relu(), MaxPool2(2), Conv2(spark, 6, 16, 5, seed=seed + 2), Relu(), MaxPool2(2), Flatten(),
        Dense(spark, 256, 128, seed=seed + 4), Relu(), Dense(spark, 128, 84, seed=seed + 6), Relu(), Dense(spark, 84, 10, bias=True, seed=seed + 8),
    )


