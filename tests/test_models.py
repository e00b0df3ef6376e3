"""Saved models, 16-bit floats, own models, tiles and batches laid out by number."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorframe import operators as O
from tensorframe import types as K
from tensorframe.frame import TensorFrame
from tensorframe.functions import epoch_stats, row_stats
from tensorframe.operators import linalg
from tensorframe.plans import SGD, Conv2, Dense, Flatten, Layer, MaxPool2, OneOf, Optimizer, Optional, Relu, Sequential, Variable, load_model, save_model
from tensorframe.plans.train import Net, train, train_batches
from tensorframe.scratch import materialize
from tensorframe.sources import digits, read_idx


class Scaled(Layer):
    """A layer of one's own with an option and an inner layer."""

    def __init__(self, spark, by):
        self.by, self.inner, self.maybe = by, Dense(spark, 6, 3, bias=True), None

    def forward(self, x):
        y = self.inner(x)
        return Variable.custom(O.scaled_cast(y.value, self.by, "f64"), [(y, lambda g: O.scaled_cast(g, self.by, "f64"))])


class Counting(Optimizer):
    """State of a scalar and a tensor."""

    def update(self, learning_rate, parameter):
        if parameter.state_of != "counting":
            parameter.state, parameter.state_of = {"n": 0.0, "seen": TensorFrame.zeros(parameter.value.spark, parameter.value.shape)}, "counting"
        grad = parameter.take_grad()
        parameter.state["n"] += 1
        parameter.state["seen"] = O.add_assign(parameter.state["seen"], grad)
        parameter.value = O.scaled_add(parameter.value, -learning_rate * parameter.state["n"], grad)


@pytest.mark.parametrize("optimizer", [SGD(), SGD(0.9), Counting()])
def test_a_saved_model_goes_on_as_if_it_had_not_stopped(spark, tmp_path, optimizer):
    x = TensorFrame.from_numpy(spark, np.random.default_rng(1).normal(size=(5, 6)))
    labels = TensorFrame.from_numpy(spark, np.array([0, 1, 2, 1, 0]), "i32")

    def step(model):
        model.init_parameter_grads()
        model(x).cross_entropy(labels).backward()
        model.update(optimizer, 0.1)

    kept = Sequential(Scaled(spark, 0.5), None, Relu())
    step(kept)
    save_model(kept, f"{tmp_path}/m")
    back = load_model(spark, f"{tmp_path}/m")
    assert isinstance(back.layers[0], Scaled) and back.layers[0].by == 0.5 and back.layers[1] is None
    step(kept), step(back)
    for (n, p), (m, q) in zip(kept.parameters(), back.parameters(), strict=True):
        assert n == m and p.state_of == q.state_of and set(p.state) == set(q.state)
        assert np.allclose(p.value.to_numpy(), q.value.to_numpy())
        assert p.state.get("n") == q.state.get("n")


def test_options_are_saved(spark, tmp_path):
    model = Sequential(Conv2(spark, 1, 2, 3, padding=(1, 0), stride=2, dilation=1, bias=True, dtype="f32"), MaxPool2(2, 1), Optional(None), OneOf("b", a=Relu(), b=Flatten()))
    save_model(model, f"{tmp_path}/m")
    back = load_model(spark, f"{tmp_path}/m")
    conv, pool, none, chosen = back.layers
    assert K.pair(conv.conv["padding"]) == (1, 0) and conv.conv["stride"] == 2 and conv.weight.value.dtype == "f32" and (pool.kernel, pool.stride) == (2, 1)
    assert none.layer is None and isinstance(chosen.layer, Flatten) and chosen.chosen == "b"
    x = TensorFrame.from_numpy(spark, np.random.default_rng(2).normal(size=(2, 1, 6, 6)), "f32")
    assert np.allclose(model(x).value.to_numpy(), back(x).value.to_numpy())


VALUES = [0.0, -0.0, 1.0, 1.00390625, 1.01171875, 1 / 3, -2.7e-3, 1e-40, 6.1e-5, 5.9e-8, 2.9e-8, 65504.0, 65519.9, 65520.0, 7e4, 3.4e38, float("inf"), float("-inf"), float("nan"), *np.random.default_rng(0).normal(size=200).tolist()]


@pytest.mark.parametrize("dtype", ["f16", "bf16"])
def test_16_bit_floats_are_rounded(spark, dtype):
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.array(VALUES, np.float32)
        want = K.rounded_array(x, dtype)
    got = O.cast(TensorFrame.from_numpy(spark, x, "f32"), dtype).to_numpy()
    assert np.array_equal(got.astype(np.float32), want, equal_nan=True)
    rows = spark.createDataFrame([(0, [float(v) for v in x])], "i int, v array<float>")
    assert np.array_equal(TensorFrame.from_column(rows, "i", "v", (len(x),), dtype).to_numpy()[0].astype(np.float32), want, equal_nan=True)
    halves = TensorFrame.from_numpy(spark, np.array([1 / 3, 2.0]), dtype)
    total = O.add_assign(halves, halves).to_numpy()
    assert np.array_equal(total.astype(np.float32), K.rounded_array(2 * K.rounded_array(np.array([1 / 3, 2.0]), dtype), dtype))


def test_bf16_agrees_with_truncation_tables():
    # 1 + 1/256 is halfway between 1 and 1 + 1/128: to even; 3/256 more is halfway the other way.
    assert K.rounded_array(np.array([1 + 1 / 256, 1 + 3 / 256, 1 + 1 / 256 + 1e-6]), "bf16").tolist() == [1.0, 1 + 2 / 128, 1 + 1 / 128]


def test_a_model_by_the_order_of_its_fields(spark):
    class Model(Layer):
        def __init__(self):
            self.a, self.gone, self.rest = Dense(spark, 4, 3), None, [Relu(), Optional(Dense(spark, 3, 2, seed=4))]

    model = Model()
    x = np.random.default_rng(3).normal(size=(5, 4))
    want = np.maximum(x @ model.a.weight.value.to_numpy(), 0) @ model.rest[1].layer.weight.value.to_numpy()
    assert np.allclose(model(TensorFrame.from_numpy(spark, x)).value.to_numpy(), want)
    assert [n for n, _ in model.parameters()] == ["a.weight", "rest.1.layer.weight"]


def test_a_gradient_of_another_kind_of_number_raises(spark):
    x = Variable.leaf(TensorFrame.from_numpy(spark, np.zeros(3)))
    with pytest.raises(TypeError):
        x.backward(TensorFrame.from_numpy(spark, np.zeros(3, int), "i32"))


def test_products_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(linalg, "BROADCAST_CELLS", 0)
    r = np.random.default_rng(5)
    a, b = r.normal(size=(13, 7)), r.normal(size=(7, 10))
    frames = [TensorFrame.from_numpy(spark, v) for v in (a, b)]
    assert np.allclose(O.dot(*frames).to_numpy(), a @ b)
    rows = TensorFrame.from_rows(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "i0 long, value array<double>"), a.shape)
    assert np.allclose(O.dot(rows, frames[1], alpha=2.0).to_numpy(), 2 * a @ b)
    assert np.allclose(O.dot(rows, TensorFrame.from_numpy(spark, b.T), tb=True).to_numpy(), a @ b)


def test_no_join_for_rows_with_labels(spark):
    r = np.random.default_rng(6)
    x, w, t = r.normal(size=(20, 4)), r.normal(size=(4, 3)), r.integers(0, 3, 20)
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, t, strict=True))], "i0 long, value array<double>, label int")
    got = row_stats(rows.select(O.row_product("value", w).alias("logits"), "label"), 3)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = epoch_stats(O.dot(TensorFrame.from_numpy(spark, x), TensorFrame.from_numpy(spark, w)), TensorFrame.from_numpy(spark, t, "i32")).first()
    assert np.allclose(tuple(got.first()), tuple(want))


def test_large_sides_are_never_broadcast(spark, monkeypatch):
    from tensorframe import frame

    monkeypatch.setattr(frame, "BROADCAST_CELLS", 0)
    x = TensorFrame.from_rows(spark.range(30).select(F.col("id").alias("i0"), F.array_repeat(F.lit(1.0), 64).alias("value")), (30, 64))
    image = TensorFrame(O.reshape(x, (30, 1, 8, 8)).df, (30, 1, 8, 8))  # cells; as row blocks they aren't joined at all
    w = TensorFrame.from_numpy(spark, np.ones((2, 1, 3, 3)))
    dy = O.conv2(image, w)
    for out in (O.conv2_backward_weight(image, dy, 3), O.max_pool2_backward(image, O.max_pool2(image, 2), 2)):
        plan = out.df._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan and "strategy=broadcast" not in plan


def test_batches_are_read_one_at_a_time(spark):
    r = np.random.default_rng(7)
    x, t = r.normal(size=(40, 4)), r.integers(0, 3, 40)
    rows = spark.createDataFrame([(i, v.tolist(), int(c), i // 10) for i, (v, c) in enumerate(zip(x, t, strict=True))], "row_id long, value array<double>, label int, batch_id int")
    model = Sequential(Dense(spark, 4, 3))
    one, other = Net(model, np.float64), Net(model, np.float64)
    stats = train_batches(rows, one, (4,), 0.1, 0.9)
    assert [s["count"] for s in stats] == [10] * 4
    for k in range(4):
        train(rows.filter(F.col("batch_id") == k), other, (4,), 0.1, 0.9)
    assert all(np.allclose(one.params[n], other.params[n]) for n in one.params)
    laid = materialize(rows, "batches", by="batch_id")
    assert "PartitionFilters: [isnotnull(batch_id" in laid.filter("batch_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert train_batches(rows.limit(0), one, (4,), 0.1) == []


def test_images_of_another_shape_raise(spark, tmp_path):
    import gzip

    def put(name, magic, data):
        (tmp_path / name).write_bytes(gzip.compress(np.array([magic, *data.shape], ">i4").tobytes() + data.tobytes()))

    put("train-images-idx3-ubyte.gz", 2051, np.zeros((2, 5, 5), np.uint8))
    put("train-labels-idx1-ubyte.gz", 2049, np.zeros(2, np.uint8))
    assert read_idx(spark, f"{tmp_path}/train-images-idx3-ubyte.gz").count() == 2
    with pytest.raises(Exception, match="aren't"):
        digits(spark, str(tmp_path)).collect()
    assert digits(spark, str(tmp_path), shape=(5, 5)).count() == 2


def test_parameters_are_visited_cast_and_assigned(spark):
    model = Sequential(Dense(spark, 3, 2, bias=True), None)
    seen = []
    model.for_each_parameter(lambda p: seen.append(p.shape))
    assert seen == [(3, 2), (2,)]
    weight = model.layers[0].weight
    model.init_parameter_grads()
    SGD(0.5).update(0.1, weight)
    model.cast("bf16")
    assert weight.dtype == "bf16" and weight.state["velocity"].dtype == "bf16"
    new = TensorFrame.from_numpy(spark, np.ones((3, 2)), "bf16")
    weight.assign(new)
    assert weight.value is new
    with pytest.raises(K.ShapeError):
        weight.assign(TensorFrame.from_numpy(spark, np.ones((2, 3)), "bf16"))
    with pytest.raises(TypeError):
        weight.assign(TensorFrame.from_numpy(spark, np.ones((3, 2))))


def test_fallible_visits_and_edits(spark):
    model = Sequential(Dense(spark, 3, 2, bias=True, seed=1), Relu(), Dense(spark, 2, 2, seed=3))
    seen = []

    def stop(path, p):
        seen.append(path)
        if path == "layers.0.bias":
            raise RuntimeError("enough")

    with pytest.raises(RuntimeError) as e:
        model.try_for_each_parameter(stop)
    assert seen == ["layers.0.weight", "layers.0.bias"] and e.value.__notes__ == ["at parameter layers.0.bias"]
    before = {path: p.value.to_numpy() for path, p in model.parameters()}
    with pytest.raises(K.ShapeError):
        model.edit_parameters(lambda path, v: O.scaled_cast(v, 2.0, "f64") if path != "layers.2.weight" else O.flatten(O.sum_axis(v, 0)))
    assert all(np.array_equal(p.value.to_numpy(), before[path]) for path, p in model.parameters())
    model.edit_parameters(lambda path, v: O.scaled_cast(v, 2.0, "f64") if path.endswith("weight") else None)
    assert all(np.allclose(p.value.to_numpy(), (2 if path.endswith("weight") else 1) * before[path]) for path, p in model.parameters())
