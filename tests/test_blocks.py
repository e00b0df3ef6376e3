"""Row blocks: images as rows, whose operators are joined to one pass."""

import numpy as np
import pytest

from tensorframe import kernels
from tensorframe import operators as O
from tensorframe.frame import TensorFrame
from tensorframe.functions import cross_entropy_loss
from tensorframe.operators import blocks
from tensorframe.plans import SGD, Conv1, Conv2, Dense, Flatten, MaxPool1, MaxPool2, Parameter, Relu, Sequential, Variable


def images(spark, a, t=None):
    """[n, *inner] as row blocks of one frame, with labels if given."""
    rows = [(i, v.reshape(-1).tolist(), None if t is None else int(t[i])) for i, v in enumerate(a)]
    df = spark.createDataFrame(rows, "id long, x array<double>, t int").repartition(3)
    return TensorFrame.from_columns(df, "id", {"x": a.shape[1:], **({} if t is None else {"t": ()})}, len(a))


def cells(x):
    return TensorFrame(x.df, x.shape)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


OPTIONS = [((3, 3), (0, 0), (1, 1), (1, 1)), ((2, 3), (1, 0), (2, 1), (1, 2)), ((1, 1), (1, 2), (1, 1), (1, 1)), ((3, 2), (2, 1), (1, 2), (2, 1))]


@pytest.mark.parametrize("kernel,p,s,d", OPTIONS)
def test_convolution_equals_that_of_cells(spark, kernel, p, s, d):
    r = np.random.default_rng(0)
    (x,) = images(spark, r.normal(size=(5, 2, 7, 6)))
    w = TensorFrame.from_numpy(spark, r.normal(size=(3, 2, *kernel)))
    y, wide = O.conv2(x, w, None, p, s, d), O.conv2(cells(x), w, None, p, s, d)
    assert y.block is not None and y.shape == wide.shape and np.allclose(y.to_numpy(), wide.to_numpy())
    dy = O.relu(y)
    assert np.allclose(O.conv2_backward_input(dy, w, x.shape, p, s, d).to_numpy(), O.conv2_backward_input(cells(dy), w, x.shape, p, s, d).to_numpy())
    dw = O.conv2_backward_weight(x, dy, kernel, p, s, d)
    assert np.allclose(dw.to_numpy(), O.conv2_backward_weight(cells(x), cells(dy), kernel, p, s, d).to_numpy())
    for q in (y.df, dw.df):
        assert "Join" not in plan(q)
    assert plan(dw.df).count("MapInArrow") == 2 and "Exchange" not in plan(y.rows) and "posexplode" not in plan(dw.df).partition("RepartitionByExpression")[2]


def strict(window):
    best = 0
    for k, v in enumerate(window):
        if v > window[best]:
            best = k
    return best


@pytest.mark.parametrize("kernel,stride", [((2, 2), (2, 2)), ((3, 2), (1, 1)), ((2, 2), (3, 3)), ((2, 3), (1, 2))])
def test_pooling_with_nan_and_ties(spark, kernel, stride):
    """Block, cells and kernels against the rule: from the first tap, a later one wins only if it is greater."""
    r = np.random.default_rng(1)
    a = r.integers(0, 4, (4, 2, 7, 8)).astype(float)
    a[r.random(a.shape) < 0.3] = np.nan
    a[0, 0, :2, :2] = [[1, np.nan], [0, 3]]
    oh, ow = (7 - kernel[0]) // stride[0] + 1, (8 - kernel[1]) // stride[1] + 1
    want, back = np.zeros((4, 2, oh, ow)), np.zeros(a.shape)
    g = r.normal(size=want.shape)
    for n, c, y, x in np.ndindex(want.shape):
        window = a[n, c, y * stride[0] : y * stride[0] + kernel[0], x * stride[1] : x * stride[1] + kernel[1]].reshape(-1)
        k = strict(window)
        want[n, c, y, x] = window[k]
        back[n, c, y * stride[0] + k // kernel[1], x * stride[1] + k % kernel[1]] += g[n, c, y, x]
    (x,), (dy,) = images(spark, a), images(spark, g)
    for form in (lambda v: v, cells):
        y, won = O.max_pool2_switches(form(x), kernel, stride)
        assert np.array_equal(y.to_numpy(), want, equal_nan=True)
        assert np.allclose(O.max_pool2_backward(form(x), form(dy), kernel, stride, won).to_numpy(), back)
        assert np.allclose(O.max_pool2_backward(form(x), form(dy), kernel, stride).to_numpy(), back)
    assert kernels.pooled(a, kernel, stride)[1].dtype == np.uint8 and np.array_equal(kernels.maxima(a, kernel, stride), want, equal_nan=True)
    assert np.array_equal(kernels.maxima(np.nan_to_num(a), kernel, stride), kernels.pooled(np.nan_to_num(a), kernel, stride)[0])
    assert O.max_pool2(cells(x), (2, 2)).to_numpy()[0, 0, 0, 0] == 3


def model(spark):
    return Sequential(Conv2(spark, 1, 2, 3, padding=1, stride=2, bias=True, seed=1), Relu(), MaxPool2(2), Flatten(), Dense(spark, 8, 3, bias=True, seed=3))


def test_gradients_in_one_pass(spark):
    """All gradients of a network: one scan, no join, and equal to those by cells."""
    r = np.random.default_rng(2)
    a, t = r.normal(size=(40, 1, 8, 8)), r.integers(0, 3, 40)
    x, target = images(spark, a, t)
    net, other = model(spark), model(spark)
    for m, rows, labels in ((net, x, target), (other, cells(x), cells(target))):
        m.init_parameter_grads()
        loss = m(rows).cross_entropy(labels)
        loss.backward()
        m.loss = loss
    table = net.gradients()
    text = plan(table)
    assert text.count("LogicalRDD") == 1 and "Join" not in text and text.count("MapInArrow") == 2
    got = table.toPandas()
    for name, p in other.parameters():
        v = got[got.param == name].sort_values("idx").v.to_numpy().reshape(p.shape)
        assert np.allclose(v, p.grad.to_numpy())
    assert np.isclose(float(net.loss.value.to_numpy()), cross_entropy_loss(cells(net(x).value), cells(target)).first()[0])


def test_labels_of_another_frame(spark):
    """Bases meet once, by a join of dense rows."""
    r = np.random.default_rng(3)
    a, t = r.normal(size=(20, 1, 8, 8)), r.integers(0, 3, 20)
    (x,), apart = images(spark, a), TensorFrame(TensorFrame.from_numpy(spark, t, "i32").df, (20,), "i32")
    both = images(spark, a, t)
    grads = []
    for rows, labels in ((x, apart), both):
        m = model(spark)
        m.init_parameter_grads()
        m(rows).cross_entropy(labels).backward()
        grads.append(m.gradients())
    assert plan(grads[0]).count("Join") == 1
    one, two = (g.toPandas().sort_values(["param", "idx"]).v.to_numpy() for g in grads)
    assert np.allclose(one, two)


def test_steps_of_the_tape_stay_at_the_driver(spark):
    """Training by tape over row blocks equals training by tape over cells; each step is one pass."""
    r = np.random.default_rng(4)
    a, t = r.normal(size=(30, 1, 8, 8)), r.integers(0, 3, 30)
    x, target = images(spark, a, t)
    net, other = model(spark), model(spark)
    optimizer, losses = SGD(0.9), []
    for _ in range(3):
        net.init_parameter_grads()
        loss = net(x).cross_entropy(target)
        losses.append(float(loss.value.to_numpy()))
        loss.backward()
        net.update(optimizer, 0.05)
        assert all(p.value.local is not None and p.state["velocity"].local is not None for _, p in net.parameters())
    other.init_parameter_grads()
    other(cells(x)).cross_entropy(cells(target)).backward()
    other.update(SGD(0.9), 0.05)
    assert losses[2] < losses[1] < losses[0]
    first = model(spark)
    first.init_parameter_grads()
    first(x).cross_entropy(target).backward()
    first.update(SGD(0.9), 0.05)
    for (_, p), (_, q) in zip(first.parameters(), other.parameters(), strict=True):
        assert np.allclose(p.value.to_numpy(), q.value.to_numpy())


def test_one_dimensional_layers(spark):
    r = np.random.default_rng(5)
    a, t = r.normal(size=(12, 2, 9)), r.integers(0, 3, 12)
    x, target = images(spark, a, t)
    make = lambda: Sequential(Conv1(spark, 2, 3, 2, bias=True, seed=1), Relu(), MaxPool1(2), Flatten(), Dense(spark, 12, 3, seed=2))
    got, want = make(), make()
    for m, rows, labels in ((got, x, target), (want, cells(x), cells(target))):
        m.init_parameter_grads()
        m(rows).cross_entropy(labels).backward()
    assert "Join" not in plan(got.gradients())
    for (_, p), (_, q) in zip(got.parameters(), want.parameters(), strict=True):
        assert np.allclose(p.grad.to_numpy(), q.grad.to_numpy())


def test_bad_labels_raise(spark):
    x, target = images(spark, np.ones((3, 4)), np.array([0, -1, 2]))
    p = Parameter(TensorFrame.from_numpy(spark, np.ones((4, 3))))
    p.init_grad()
    Variable(x).dot(p.to_variable()).cross_entropy(target).backward()
    with pytest.raises(Exception, match="no such class"):
        p.grad.to_numpy()
    for labels in ([0, -1], [0, 3], [0, 0.5], [0, np.nan]):
        with pytest.raises(ValueError, match="no such class"):
            kernels.scored(np.ones((2, 3)), np.array(labels))


def test_equal_parts_run_once(spark):
    (x,) = images(spark, np.ones((2, 1, 4, 4)))
    y, won = O.max_pool2_switches(O.relu(x), 2)
    back = O.max_pool2_backward(O.relu(x), y, 2)
    steps, _ = blocks._ordered([back.block.op, won.block.op])
    assert sorted(kind for kind, *_ in steps) == ["part", "part", "pool_back", "pooled", "relu", "source"]


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, x array<double>, t int")
    x, target = TensorFrame.from_columns(df, "id", {"x": (4,), "t": ()})
    w = TensorFrame.from_numpy(spark, np.ones((4, 3)))
    assert O.dot(x, w).shape == (0, 3) and O.dot(x, w).to_numpy().shape == (0, 3)
    assert float(Variable(O.dot(x, w)).cross_entropy(target).value.to_numpy()) == 0
