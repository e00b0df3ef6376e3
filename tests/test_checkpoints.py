"""Cut points of the tape over cells."""

from pathlib import Path

import numpy as np
import pytest

from tensorframe.frame import TensorFrame
from tensorframe.operators import linalg
from tensorframe.plans import Checkpoints, Conv2, Dense, Flatten, MaxPool2, Relu, Sequential, Variable
from tensorframe.scratch import shared_dir


def inputs(spark, n=12):
    r = np.random.default_rng(1)
    x = TensorFrame.from_numpy(spark, r.normal(size=(n, 1, 8, 8)))
    return TensorFrame(x.df.repartition(2), x.shape), TensorFrame.from_numpy(spark, r.integers(0, 3, n), "i32")


def model(spark):
    return Sequential(Conv2(spark, 1, 2, 3, padding=1, stride=2, bias=True, seed=1), Relu(), MaxPool2(2), Flatten(), Dense(spark, 8, 3, bias=True, seed=3))


def tables(spark):
    return set(Path(shared_dir(spark).removeprefix("file:")).glob("tensorframe/activation-*"))


def scans(df):
    """Leaves of a plan."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return text.count("LogicalRDD") + text.count("Relation [") + text.count("LocalRelation") + text.count("Range (")


@pytest.mark.parametrize("most", [1 << 40, 20_000, 0])
def test_gradients_are_the_same_and_plans_are_short(spark, most):
    x, t = inputs(spark)
    want, got = model(spark), model(spark)
    want.init_parameter_grads()
    want(x).cross_entropy(t).backward()
    before = tables(spark)
    got.init_parameter_grads()
    with Checkpoints(most) as cuts:
        got(x).cross_entropy(t).backward()
    for (name, p), (_, q) in zip(want.parameters(), got.parameters(), strict=True):
        assert np.allclose(p.grad.to_numpy(), q.grad.to_numpy()), name
        assert scans(q.grad.df) == 1
    assert sum(scans(p.grad.df) for _, p in want.parameters()) > 20
    left = len(tables(spark) - before)
    if most == 1 << 40:  # gradients of four parameters, and the loss
        assert left == 5 and cuts.held < cuts.peak <= most
    elif not most:
        assert left == 4
    else:
        assert cuts.peak <= most + sum(Checkpoints.size(p.value) for _, p in got.parameters())
    assert Checkpoints.active is None


def test_a_value_with_two_readers(spark):
    """x + x·w + relu(x·w): gradients of several edges are complete before they are written."""
    r = np.random.default_rng(2)
    a, w = r.normal(size=(5, 4)), r.normal(size=(4, 4))
    grads = []
    for cuts in (None, Checkpoints()):
        x = Variable.leaf(TensorFrame(TensorFrame.from_numpy(spark, a).df, a.shape))
        v = Variable.leaf(TensorFrame.from_numpy(spark, w))

        def run(x=x, v=v):
            y = x.dot(v)
            y.add(y.relu()).add(x).backward(TensorFrame.ones(spark, a.shape))

        if cuts is None:
            run()
        else:
            with cuts:
                run()
        grads.append((x.grad.to_numpy(), v.grad.to_numpy()))
    mask = 1.0 + (a @ w >= 0)
    assert np.allclose(grads[0][1], a.T @ mask) and np.allclose(grads[0][0], mask @ w.T + 1)
    assert all(np.allclose(p, q) for p, q in zip(*grads, strict=True))


@pytest.mark.parametrize("most", [1 << 40, 2_000, 0])
@pytest.mark.parametrize("gram_cells", [0, 1 << 20])
def test_products_of_large_matrices_are_written(spark, monkeypatch, most, gram_cells):
    """They are rows that come of tables which go; what reads them later must not miss those."""
    monkeypatch.setattr(linalg, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(linalg, "GRAM_CELLS", gram_cells)
    x, t = inputs(spark)
    m = model(spark)
    m.init_parameter_grads()
    with Checkpoints(most) as cuts:
        loss = m(x).cross_entropy(t)
        loss.backward()
    got = {name: p.grad.to_numpy() for name, p in m.parameters()}
    assert len(got) == m.gradients().select("param").distinct().count() == 4
    assert cuts.peak <= most + sum(Checkpoints.size(p.grad) for _, p in m.parameters())
    monkeypatch.undo()
    want = model(spark)
    want.init_parameter_grads()
    want(x).cross_entropy(t).backward()
    for name, p in want.parameters():
        assert np.allclose(p.grad.to_numpy(), got[name]), name


def test_a_chain_over_such_rows_is_written(spark, monkeypatch):
    monkeypatch.setattr(linalg, "BROADCAST_CELLS", 0)
    r = np.random.default_rng(4)
    a, b, c = (r.normal(size=s) for s in ((6, 5), (5, 4), (4, 3)))
    x, v, w = (Variable.leaf(TensorFrame(TensorFrame.from_numpy(spark, y).df, y.shape)) for y in (a, b, c))
    with Checkpoints():
        y = x.dot(v).relu().dot(w)
        y.backward(TensorFrame.ones(spark, y.shape))
    hidden, ones = np.maximum(a @ b, 0), np.ones((6, 3))
    down = (ones @ c.T) * (a @ b >= 0)
    assert all(np.allclose(n.grad.to_numpy(), g) for n, g in ((w, hidden.T @ ones), (v, a.T @ down), (x, down @ b.T)))


def test_row_blocks_are_not_cut(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(6)], "id long, x array<double>, t int")
    x, t = TensorFrame.from_columns(df, "id", {"x": (2,), "t": ()})
    w = Variable.leaf(TensorFrame.from_numpy(spark, np.ones((2, 2))))
    before = tables(spark)
    with Checkpoints():
        Variable(x).dot(w).cross_entropy(t).backward()
    assert tables(spark) == before and w.grad.sums is not None
