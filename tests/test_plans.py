import gzip
import struct

import numpy as np
import pytest

from tensorframe import operators as O
from tensorframe import types as K
from tensorframe.frame import TensorFrame
from tensorframe.functions import accuracy, cross_entropy_backward, cross_entropy_loss, epoch_stats
from tensorframe.plans import SGD, Conv1, Conv2, Dense, Flatten, Identity, Layer, MaxPool1, MaxPool2, Node, Parameter, Relu, Sequential, Variable, lenet5
from tensorframe.plans.kernels import backward, forward, loss
from tensorframe.plans.optim import load, save
from tensorframe.plans.train import Net, evaluate, predict, train, train_batches
from tensorframe.sources import digits, iris, read_idx, sequential, shuffled
from tensorframe.sources.idx import decode
from tensorframe.streaming import score_stream


def tf(spark, a, dtype="f64"):
    return TensorFrame.from_numpy(spark, np.asarray(a), dtype)


def small_net(spark):
    return Sequential(Conv2(spark, 1, 2, 3, padding=1, stride=2, bias=True, seed=1), Relu(), None, MaxPool2(2), Flatten(), Dense(spark, 8, 3, bias=True, seed=3))


def test_criterion(spark):
    rng = np.random.default_rng(0)
    x, t = rng.normal(size=(31, 16)), np.arange(31) % 16
    x[3] = 1.0  # ties are wrong
    p = np.exp(x - x.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    want = -np.log(p[np.arange(31), t]).sum()
    X, L = tf(spark, x), tf(spark, t, "u8")
    assert np.isclose(cross_entropy_loss(X, L).first()[0], want)
    correct = sum(x[i, t[i]] > max(np.delete(x[i], t[i])) for i in range(31))
    assert accuracy(X, L).first()[0] == correct
    assert np.allclose(cross_entropy_backward(X, L, 2.0).to_numpy(), 2 * (p - np.eye(16)[t]) / 31)
    s = epoch_stats(X, L).first()
    assert (s["count"], s["correct"]) == (31, correct) and np.isclose(s.mean_loss, want / 31)
    nan = x.copy()
    nan[:, 0] = np.nan
    assert accuracy(tf(spark, nan), L).first()[0] == 0


def test_gradients_by_finite_differences(spark):
    """The tape's and the kernels' gradients against differences of the kernels' loss."""
    rng = np.random.default_rng(4)
    x, t = rng.normal(size=(5, 1, 8, 8)), np.array([0, 1, 2, 1, 0])
    model = small_net(spark)
    net = Net(model, np.float64)
    kept = []
    _, _, g = loss(forward(net.plan, net.params, x, kept), t)
    grads = backward(net.plan, net.params, kept, g / 5)
    for name, p in net.params.items():
        for at in list(np.ndindex(p.shape))[::7]:
            old, side = p[at], []
            for step in (1e-6, -1e-6):
                p[at] = old + step
                side.append(loss(forward(net.plan, net.params, x), t)[0] / 5)
            p[at] = old
            assert np.isclose((side[0] - side[1]) / 2e-6, grads[name][at], atol=1e-5)
    model.init_parameter_grads()
    logits = model(tf(spark, x))
    assert np.allclose(logits.value.to_numpy(), forward(net.plan, net.params, x))
    logits.cross_entropy(tf(spark, t, "u8")).backward()
    of = {"layers.0": "layers.0", "layers.5": "layers.4"}
    for path, p in model.parameters():
        head, _, slot = path.rpartition(".")
        assert np.allclose(p.grad.to_numpy(), grads[f"{of[head]}.{slot}"])


def test_tape(spark):
    x = Variable.leaf(tf(spark, [[1.0, -2.0], [3.0, 4.0]]))
    y = x.t().dot(x).relu()  # x is used twice
    b = Variable.leaf(tf(spark, [1.0, 2.0]))
    z = y.add(b).permute((1, 0)).flatten().reshape((4,))
    z.backward()
    first = x.grad
    z.backward()
    assert x.grad is first
    a = np.array([[1.0, -2.0], [3.0, 4.0]])
    m = (a.T @ a >= 0).astype(float)
    assert np.allclose(x.grad.to_numpy(), a @ (m + m.T)) and np.allclose(b.grad.to_numpy(), [2, 2])
    c = Variable.leaf(tf(spark, [1.0]))
    c.broadcast((3, 2)).backward()
    assert np.allclose(c.grad.to_numpy(), [6])
    square = Variable.custom(O.binary("mul", 1, b.value, b.value), [(c, lambda g: O.broadcast_backward(g, (1,)))])
    assert square.node is not None and Variable.custom(b.value, [(Variable(b.value), lambda g: g)]).node is None
    with pytest.raises(K.ShapeError):
        Node((2,)).add(b.value.with_df(b.value.df.limit(1), (1,)))


def test_layers_1d_and_attributes(spark):
    class Net1(Layer):
        def __init__(self):
            self.conv, self.pool, self.rest = Conv1(spark, 2, 3, 3, padding=1, bias=True), MaxPool1(2), [Identity(), Flatten()]

        def forward(self, x):
            x = self.pool(self.conv(x))
            for layer in self.rest:
                x = layer(x)
            return x

    net = Net1()
    assert [n for n, _ in net.parameters()] == ["conv.weight", "conv.bias"]
    assert net(tf(spark, np.ones((2, 2, 8)))).shape == (2, 12)
    assert sum(p.value.size for _, p in lenet5(spark).parameters()) == 46_920


def test_sgd_and_resume(spark, tmp_path):
    w, g = np.array([1.0, 2.0]), np.array([0.5, -1.0])
    p, sgd = Parameter(tf(spark, w), "w"), SGD(0.9)
    v = np.zeros(2)
    for k in range(3):
        p.init_grad()
        p.to_variable().backward(tf(spark, g))
        sgd.update(0.1, p)
        v = 0.9 * v + g
        w = w - 0.1 * v
        if k == 1:  # the momentum goes on after loading
            save({"w": p}, f"{tmp_path}/p")
            p = Parameter(tf(spark, np.zeros(2)), "w")
            load(spark, {"w": p}, f"{tmp_path}/p")
    assert np.allclose(p.value.to_numpy(), w)
    sgd.update(0.1, p)  # no gradient: no change
    assert np.allclose(p.value.to_numpy(), w)


def rows_of(spark, x, t):
    return spark.createDataFrame([(i, a.reshape(-1).tolist(), int(b)) for i, (a, b) in enumerate(zip(x, t, strict=True))], "row_id long, value array<double>, label int")


def test_training_equals_numpy_and_learns(spark, tmp_path):
    rng = np.random.default_rng(7)
    t = rng.integers(0, 3, 90)
    x = rng.normal(size=(90, 1, 8, 8)) + t[:, None, None, None]
    rows = rows_of(spark, x, t).repartition(3).cache()
    net, own = Net(small_net(spark), np.float64), Net(small_net(spark), np.float64)
    stats = train(rows, net, (1, 8, 8), 0.2, 0.9, steps=4)
    for s in stats:
        kept = []
        total, correct, g = loss(forward(own.plan, own.params, x, kept), t)
        assert (s["count"], s["correct"]) == (90, correct) and np.isclose(s["loss"], total)
        own.step(backward(own.plan, own.params, kept, g / 90), 0.2, 0.9)
    assert all(np.allclose(net.params[n], own.params[n]) for n in own.params)
    net.save(spark, f"{tmp_path}/net")
    again = Net(small_net(spark), np.float64)
    again.load(spark, f"{tmp_path}/net")
    assert all(np.allclose(again.params[n], net.params[n]) and np.allclose(again.velocity[n], net.velocity[n]) for n in net.params)
    last = train_batches(sequential(rows, 30), again, (1, 8, 8), 0.2, 0.9)
    assert len(last) == 3
    e = evaluate(rows, again, (1, 8, 8)).first()
    assert e["count"] == 90 and e.mean_loss < stats[0]["loss"] / 90
    got = {r.row_id: r.logits for r in predict(rows, again, (1, 8, 8)).collect()}
    assert np.allclose([got[i] for i in range(90)], forward(again.plan, again.params, x))


def test_stream_scoring(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20, 1, 8, 8))
    rows = rows_of(spark, x, np.zeros(20))
    rows.write.parquet(f"{tmp_path}/in")
    net = Net(small_net(spark), np.float64)
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = score_stream(stream, net, (1, 8, 8)).writeStream.format("memory").queryName("scored").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r.row_id: r.label for r in spark.table("scored").collect()}
    assert [got[i] for i in range(20)] == forward(net.plan, net.params, x).argmax(1).tolist()


def test_batches(spark):
    rows = spark.range(103).withColumnRenamed("id", "row_id")
    for f in (lambda: sequential(rows, 20), lambda: shuffled(rows, 20, 103)):
        counts = sorted(r["count"] for r in f().groupBy("batch_id").count().collect())
        assert counts == [3, 20, 20, 20, 20, 20]
    a, b = (sorted((r.place, r.row_id) for r in shuffled(rows, 20, 103, seed).collect()) for seed in (1, 2))
    assert [p for p, _ in a] == list(range(103)) and a != b


def test_idx_and_iris(spark, tmp_path):
    images, labels = np.arange(5 * 784).reshape(5, 28, 28).astype(np.uint8), np.arange(5, dtype=np.uint8)
    for name, data in (("train-images-idx3-ubyte.gz", struct.pack(">iiii", 2051, 5, 28, 28) + images.tobytes()), ("train-labels-idx1-ubyte.gz", struct.pack(">ii", 2049, 5) + labels.tobytes())):
        (tmp_path / name).write_bytes(gzip.compress(data))
    got = sorted(digits(spark, str(tmp_path)).collect(), key=lambda r: r.row_id)
    assert [r.label for r in got] == list(range(5)) and np.array_equal([r.value for r in got], images.reshape(5, -1))
    assert read_idx(spark, f"{tmp_path}/train-labels-idx1-ubyte.gz").count() == 5
    for bad in (b"", struct.pack(">ii", 7, 0), struct.pack(">ii", 2049, 5) + b"abc"):
        with pytest.raises(ValueError):
            decode(bad)
    (tmp_path / "iris.csv").write_text('a,b,c,d,class\n5.1,3.5,1.4,0.2,Iris-setosa\n6.0,2.2,4.0,1.0,"versicolor"\n6.3,3.3,6.0,2.5,2\n')
    assert [(r.row_id, r.label, len(r.value)) for r in iris(spark, f"{tmp_path}/iris.csv").collect()] == [(0, 0, 4), (1, 1, 4), (2, 2, 4)]
