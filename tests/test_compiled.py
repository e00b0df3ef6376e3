"""Models of all kinds as kernels for Arrow batches, and bfloat16."""

import numpy as np
import pytest

from tensorframe import operators as O
from tensorframe import types as K
from tensorframe.frame import TensorFrame
from tensorframe.kernels import to_bf16
from tensorframe.plans import Conv1, Conv2, Dense, Flatten, Identity, Layer, MaxPool1, OneOf, Optional, Parameter, Relu, Sequential, Variable
from tensorframe.plans.train import Net, compiled, evaluate, gradients, predict, train


def rows(spark, a, t):
    return spark.createDataFrame([(i, v.reshape(-1).tolist(), int(c)) for i, (v, c) in enumerate(zip(a, t, strict=True))], "row_id long, value array<double>, label int").repartition(3)


class Fields(Layer):
    """By the order of its fields, with lists, choices and nothing among them."""

    def __init__(self, spark):
        self.conv = Conv1(spark, 1, 2, 3, bias=True, seed=1)
        self.nothing = None
        self.steps = [Relu(), None, [MaxPool1(2), Identity()]]
        self.act = OneOf("flat", flat=Flatten(), other=Relu())
        self.maybe = Optional(None)
        self.head = Sequential(Dense(spark, 8, 3, bias=True, seed=3))


def tape_gradients(model, a, t, spark):
    model.init_parameter_grads()
    x = TensorFrame.from_rows(spark.createDataFrame([(i, v.reshape(-1).tolist()) for i, v in enumerate(a)], "i0 long, value array<double>"), a.shape)
    model(x).cross_entropy(TensorFrame.from_numpy(spark, t, "i32")).backward()
    return {name: p.grad.to_numpy() for name, p in model.parameters()}


def test_a_model_by_fields_trains_by_batches(spark):
    r = np.random.default_rng(0)
    a, t = r.normal(size=(20, 1, 10)), r.integers(0, 3, 20)
    model = Fields(spark)
    net = Net(model, np.float64)
    assert sorted(net.params) == ["conv.bias", "conv.weight", "head.layers.0.bias", "head.layers.0.weight"]
    got, _ = gradients(rows(spark, a, t), net, (1, 10))
    want = tape_gradients(model, a, t, spark)
    assert want.keys() == got.keys() and all(np.allclose(got[n], want[n]) for n in want)
    stats = train(rows(spark, a, t), net, (1, 10), 0.2, 0.9, steps=4)
    assert stats[-1]["loss"] < stats[0]["loss"]


class Scaled(Layer):
    """x times a number for each column: a layer of one's own, with a kernel of its own."""

    def __init__(self, spark, n):
        self.by = Parameter(TensorFrame.from_numpy(spark, np.linspace(0.5, 2, n)))

    def forward(self, x: Variable) -> Variable:
        by = self.by.to_variable()
        return Variable.custom(O.elementwise.zipped(x.value, by.value, lambda v, s: v * s), [(x, lambda g: O.elementwise.zipped(g, by.value, lambda v, s: v * s)), (by, lambda g: O.sum_axis(O.elementwise.zipped(x.value, g, lambda v, d: v * d), 0))])


def scaled_back(g, saved, options, params, first):
    return g * params[0], [(saved * g).sum(axis=0)]


def test_a_kernel_of_ones_own(spark):
    r = np.random.default_rng(1)
    a, t = r.normal(size=(15, 4)), r.integers(0, 3, 15)
    model = Sequential(Scaled(spark, 4), Dense(spark, 4, 3, seed=2))
    with pytest.raises(TypeError, match="no kernel"):
        Net(model)
    compiled(Scaled, (lambda x, options, params: (x * params[0], x), scaled_back))
    net = Net(model, np.float64)
    got, _ = gradients(rows(spark, a, t), net, (4,))
    want = tape_gradients(model, a, t, spark)
    assert all(np.allclose(got[n], want[n]) for n in want)

    class Twice(Scaled):
        def forward(self, x):
            return super().forward(super().forward(x))

    with pytest.raises(TypeError):  # another forward isn't what the kernel does
        Net(Twice(spark, 4))


def test_bad_labels_raise_in_batches(spark):
    model = Sequential(Dense(spark, 4, 3))
    bad = rows(spark, np.ones((3, 4)), [0, -1, 2])
    for run in (lambda: evaluate(bad, Net(model), (4,)).collect(), lambda: gradients(bad, Net(model), (4,)), lambda: evaluate(rows(spark, np.ones((2, 4)), [3, 0]), Net(model), (4,)).collect()):
        with pytest.raises(Exception, match="no such class"):
            run()


def test_rounding_to_bf16():
    r = np.random.default_rng(2)
    a = np.concatenate([r.normal(size=500), r.normal(size=500) * 1e-39, [0.0, -0.0, np.inf, 1.00390625, 1.01171875, 3.4e38]]).astype(np.float32)
    assert np.array_equal(to_bf16(a), K.rounded_array(a, "bf16")) and np.isnan(to_bf16(np.array([np.nan], np.float32)))[0]


@pytest.mark.parametrize("master", [False, True])
def test_training_in_bf16(spark, master):
    """All that is stored has eight significant bits; sums are of 32; an update is rounded once."""
    r = np.random.default_rng(3)
    a, t = r.normal(size=(40, 6)).astype(np.float32), r.integers(0, 3, 40)
    model = Sequential(Dense(spark, 6, 3, bias=True, seed=1, dtype="bf16"))
    net = Net(model, master=master)
    assert net.half and all(np.array_equal(p, to_bf16(p)) for p in net.params.values())
    w, b = net.params["layers.0.weight"], net.params["layers.0.bias"]
    vw = np.zeros_like(w)
    for _ in range(2):
        x = to_bf16(a)
        y = to_bf16(x @ to_bf16(w) + to_bf16(b))
        e = np.exp(y - y.max(1, keepdims=True))
        g = to_bf16(e / e.sum(1, keepdims=True) - np.eye(3, dtype=np.float32)[t])
        dw, db = to_bf16((x.T @ g) / 40), to_bf16(g.sum(0) / 40)
        store = (lambda v: v.astype(np.float32)) if master else to_bf16
        vw = 0.9 * vw + dw
        w, vw = store(w - 0.5 * vw), store(vw)
        grads, _ = gradients(rows(spark, a, t), net, (6,))
        net.step(grads, 0.5, 0.9)
        assert np.allclose(net.params["layers.0.weight"], w, atol=1e-2) and np.allclose(net.velocity["layers.0.weight"], vw, atol=1e-2)
        b = net.params["layers.0.bias"]
        assert np.isfinite(db).all() and all(np.array_equal(p, to_bf16(p)) for p in net.params.values()) is not master
    logits = [x.logits for x in predict(rows(spark, a, t), net, (6,)).collect()]
    assert np.array_equal(np.array(logits), to_bf16(np.array(logits)))


def test_conv2_in_bf16_learns(spark):
    r = np.random.default_rng(4)
    t = r.integers(0, 2, 60)
    a = r.normal(size=(60, 1, 6, 6)) * 0.1 + t[:, None, None, None]
    model = Sequential(Conv2(spark, 1, 2, 3, seed=1, dtype="bf16"), Relu(), Flatten(), Dense(spark, 32, 2, seed=2, dtype="bf16"))
    half, whole = (train(rows(spark, a, t), Net(model, dtype), (1, 6, 6), 0.1, steps=8) for dtype in (None, np.float32))
    assert half[-1]["loss"] < half[0]["loss"] and all(abs(p["loss"] / q["loss"] - 1) < 0.05 for p, q in zip(half, whole, strict=True))
