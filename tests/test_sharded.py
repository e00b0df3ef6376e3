"""Parameters in bucketed tables, and losses over wide class axes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorframe.frame import TensorFrame
from tensorframe.functions import accuracy, cross_entropy_backward, cross_entropy_loss, criterion, epoch_stats
from tensorframe.operators.tiles import Tiles
from tensorframe.plans.sharded import ShardedMatrix, class_states, softmax_step, state_stats


def rows(spark, a):
    return TensorFrame.from_rows(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "i0 long, value array<double>").repartition(3), a.shape)


def softmax(y, t):
    p = np.exp(y - y.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return -np.log(p[np.arange(len(t)), t]).sum(), p - np.eye(y.shape[1])[t]


@pytest.mark.parametrize("momentum", [None, 0.9])
def test_steps_equal_numpy(spark, tmp_path, momentum):
    """Two steps, saved and loaded between them."""
    r = np.random.default_rng(0)
    a, t = r.normal(size=(37, 11)), r.integers(0, 13, 37)
    x, target = rows(spark, a), TensorFrame.from_numpy(spark, t, "i32")
    w = ShardedMatrix.uniform(spark, (11, 13), seed=3, edge=4, buckets=3)
    value, velocity = w.frame().to_numpy(), np.zeros((11, 13))
    assert np.abs(value).max() <= np.sqrt(2 / 11) and np.array_equal(value, ShardedMatrix.uniform(spark, (11, 13), seed=3, edge=4, buckets=5).frame().to_numpy())
    for k in range(2):
        loss, g = softmax(a @ value, t)
        velocity = a.T @ g / 37 + (0 if momentum is None else momentum * velocity)
        y = a @ value
        right = sum(y[i, t[i]] > np.delete(y[i], t[i]).max() for i in range(37))
        value = value - 0.5 * velocity
        name = w.name
        w, stats = softmax_step(x, target, w, 0.5, momentum)
        assert (stats["count"], stats["correct"]) == (37, right) and np.isclose(stats["loss"], loss)
        assert np.allclose(w.frame().to_numpy(), value) and not spark.catalog.tableExists(name)
        if not k:
            w.save(str(tmp_path / "w"))
            w = ShardedMatrix.load(spark, str(tmp_path / "w"))


def test_an_update_shuffles_only_the_gradient(spark):
    r = np.random.default_rng(1)
    a, g = r.normal(size=(9, 10)), r.normal(size=(9, 10))
    w = ShardedMatrix.of(rows(spark, a), edge=4, buckets=4)
    part = Tiles.of(rows(spark, g), 4)
    part.df = part.df.filter("ti < 2")
    out = w.stepped(part, 0.1, 0.5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert "SortMergeJoin" in plan
    scan = plan.partition("FileScan parquet")[0].splitlines()
    depth = len(scan) - 1
    above = [line for line in scan[: depth + 1] if "Exchange" in line]
    assert not above, above
    got = w.step(part, 0.1, 0.5).frame().to_numpy()
    want = a.copy()
    want[:8] -= 0.1 * g[:8]  # no gradient, no change
    assert np.allclose(got, want)


def test_no_parameter_comes_to_the_driver(spark):
    """Steps of 262,144 parameters of which none comes to the driver."""
    n, k, classes = 40, 256, 1024
    r = np.random.default_rng(2)
    t = r.integers(0, classes, n)
    x, target = rows(spark, r.normal(size=(n, k))), TensorFrame.from_numpy(spark, t, "i32")
    w = ShardedMatrix.uniform(spark, (k, classes), edge=128, buckets=4)
    seen = []
    total = TensorFrame.to_numpy
    TensorFrame.to_numpy = lambda self: seen.append(self.size) or total(self)
    try:
        w, first = softmax_step(x, target, w, 20.0)
        w, second = softmax_step(x, target, w, 20.0)
    finally:
        TensorFrame.to_numpy = total
    assert not seen and second["loss"] < first["loss"] and w.df.count() == 16


@pytest.mark.parametrize("spread", [1.0, 400.0])
def test_wide_rows_from_cells(spark, monkeypatch, spread):
    monkeypatch.setattr(criterion, "WIDE", 4)
    r = np.random.default_rng(3)
    y, t = r.normal(size=(20, 9)) * spread, r.integers(0, 9, 20)
    y[4] = 2.0  # ties are wrong
    x, target = TensorFrame(TensorFrame.from_numpy(spark, y).df, y.shape), TensorFrame.from_numpy(spark, t, "i32")
    loss, g = softmax(y, t)
    m = y.max(1)
    loss = (np.log(np.exp(y - m[:, None]).sum(1)) - (y[np.arange(20), t] - m)).sum()
    right = sum(y[i, t[i]] > np.delete(y[i], t[i]).max() for i in range(20))
    assert np.isclose(cross_entropy_loss(x, target).first()[0], loss) and accuracy(x, target).first()[0] == right
    assert np.allclose(cross_entropy_backward(x, target).to_numpy(), g / 20)
    s = epoch_stats(x, target).first()
    assert (s["count"], s["correct"]) == (20, right) and np.isclose(s.loss, loss)
    y[2, 1] = np.nan
    x = TensorFrame(TensorFrame.from_numpy(spark, y).df, y.shape)
    right -= bool(y[2, t[2]] > np.delete(np.nan_to_num(y[2], nan=-np.inf), t[2]).max())
    assert accuracy(x, target).first()[0] == right and np.isnan(cross_entropy_loss(x, target).first()[0])
    with pytest.raises(Exception, match="no such class"):
        cross_entropy_loss(x, TensorFrame.from_numpy(spark, np.full(20, 9), "i32")).collect()


def test_a_hundred_thousand_classes(spark):
    """Cells by formula; no row is an array, and cells are combined before the shuffle."""
    classes, n = 100_000, 4
    df = spark.range(n * classes, numPartitions=4).select(F.expr(f"id div {classes}").alias("i0"), (F.col("id") % classes).alias("i1"), ((F.col("id") * 7919 % 1000) / 100.0).alias("v"))
    x, target = TensorFrame(df, (n, classes)), TensorFrame.from_numpy(spark, np.arange(n) * 31_337, "i32")
    y = ((np.arange(n * classes) * 7919 % 1000) / 100.0).reshape(n, classes)
    out = cross_entropy_loss(x, target)
    assert np.isclose(out.first()[0], softmax_loss(y, np.arange(n) * 31_337))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct" in plan and "MapInArrow" not in plan and "sort_array" not in plan
    stats = state_stats(class_states(Tiles.of(x), target)).first()
    assert np.isclose(stats.loss, out.first()[0])


def softmax_loss(y, t):
    m = y.max(1)
    return (np.log(np.exp(y - m[:, None]).sum(1)) - (y[np.arange(len(t)), t] - m)).sum()
