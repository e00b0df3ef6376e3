import numpy as np
import pytest

from tensorframe import operators as O
from tensorframe import types as K
from tensorframe.frame import TensorFrame


def cyc(shape, a=1, b=10, dtype=float):
    return np.resize(np.arange(a, b), shape).astype(dtype)


def tf(spark, a, dtype="f64"):
    return TensorFrame.from_numpy(spark, a, dtype)


def same(x, want):
    got = x.to_numpy()
    assert got.shape == np.shape(want) and np.allclose(got.astype(float), np.asarray(want, float), equal_nan=True)


@pytest.mark.parametrize("shape", [(), (3,), (2, 3), (2, 3, 4), (2, 1, 2, 3, 2, 2)])
def test_from_array_and_shape(spark, shape):
    a = np.arange(1, int(np.prod(shape)) + 1, dtype=float).reshape(shape)
    x = tf(spark, a, "u32")
    same(x, a)
    same(O.transpose(x), a.T)
    same(O.flatten(x), a.reshape((shape[0], -1) if shape else (1, 1)))
    if len(shape) > 1:
        same(O.reshape(x, shape[::-1]), a.reshape(shape[::-1]))
        same(O.reshape(x, (a.size,), order="F"), a.reshape(-1, order="F"))
        order = np.roll(range(len(shape)), 1).tolist()
        same(O.permute(x, order), a.transpose(order))
        same(O.index_axis(x, 1, shape[1] - 1), a.take(shape[1] - 1, axis=1))
        same(O.collapse_axis(x, 0, 1), a[1:2])
        assert x.dense().count() == shape[0]


def test_shape_errors(spark):
    x = tf(spark, cyc((2, 3)))
    for f in (lambda: O.reshape(x, (7,)), lambda: O.permute(x, (0, 0)), lambda: O.broadcast(x, (3, 2)), lambda: O.dot(x, x), lambda: x.require(ndim=3)):
        with pytest.raises(K.ShapeError):
            f()
    with pytest.raises(IndexError):
        O.index_axis(x, 0, 2)
    with pytest.raises(OverflowError):
        tf(spark, np.array([256]), "u8")


@pytest.mark.parametrize("a,b", [((2,), (4, 2)), ((3, 2), (2, 4, 3, 2)), ((4, 1, 1, 3), (4, 2, 1, 3)), ((), (2, 2))])
def test_broadcast(spark, a, b):
    x = cyc(a)
    same(O.broadcast(tf(spark, x), b), np.broadcast_to(x, b))
    y = cyc(b)
    extra = tuple(range(len(b) - len(a)))
    want = y.sum(axis=extra)
    want = want.sum(axis=tuple(k for k, n in enumerate(a) if n == 1 and want.shape[k] != 1), keepdims=True) if a else want
    same(O.broadcast_backward(tf(spark, y), a), want.reshape(a))


def test_elementwise(spark):
    x, y = cyc((3, 5)), cyc((3, 5), 11, 20)
    same(O.scaled_add(tf(spark, x), 2, tf(spark, y)), x + 2 * y)
    same(O.scaled_add(tf(spark, x), 2, tf(spark, y[0])), x + 2 * y[0])
    same(O.scaled_add(tf(spark, x), 2, tf(spark, np.array(3.0))), x + 6)
    same(O.assign(tf(spark, x), tf(spark, y[1])), np.broadcast_to(y[1], x.shape))
    same(O.scaled_cast(tf(spark, x, "u8"), 0.5, "f32"), x * 0.5)
    same(O.fill(tf(spark, x), 4), np.full(x.shape, 4))
    for op, want in (("identity", 2 * x), ("add", 2 * x + y), ("sub", 2 * x - y), ("mul", 2 * x * y), ("div", 2 * x / y)):
        same(O.binary(op, 2, tf(spark, x), tf(spark, y)), want)
    same(O.binary("identity", 0, tf(spark, x), tf(spark, y)), np.zeros(x.shape))
    big = np.array([-1.5, 300.0, np.nan, 7.9])
    same(O.cast(tf(spark, big), "u8", "saturate"), [0, 255, 0, 7])
    r = np.array([[-2.0, -1.0, 0.0, 1.0, np.nan]])
    same(O.relu(tf(spark, r)), [[0, 0, 0, 1, 0]])
    same(O.relu_backward(tf(spark, r), tf(spark, np.arange(1.0, 6).reshape(1, 5))), [[0, 0, 3, 4, 0]])


@pytest.mark.parametrize("n,classes", [(1, 1), (7, 5), (64, 10)])
def test_one_hot(spark, n, classes):
    labels = np.arange(n) % classes
    same(O.one_hot(tf(spark, labels, "u8"), classes), np.eye(classes)[labels])


def test_one_hot_out_of_range(spark):
    with pytest.raises(Exception, match="no such class"):
        O.one_hot(tf(spark, np.array([3]), "u8"), 3).to_numpy()


def test_sums(spark):
    a = cyc((3, 4, 5))
    same(O.sum_all(tf(spark, a)), a.sum())
    same(O.sum_all(tf(spark, a), 2, tf(spark, np.array(3.0))), a.sum() + 6)
    for k in range(3):
        same(O.sum_axis(tf(spark, a), k), a.sum(axis=k))
    same(O.sum_axis(tf(spark, a), 1, 0.5, tf(spark, a[:, 0])), a.sum(axis=1) + 0.5 * a[:, 0])
    assert O.sum_all(tf(spark, np.full(300, 127), "i8")).to_numpy() == 300 * 127


@pytest.mark.parametrize("ta,tb", [(False, False), (True, False), (False, True), (True, True)])
def test_dot(spark, ta, tb):
    a, b, c = cyc((4, 7)), cyc((7, 3)), cyc((4, 3))
    x, y = tf(spark, a.T if ta else a), tf(spark, b.T if tb else b)
    same(O.dot(x, y, ta, tb), a @ b)
    same(O.dot(x, y, ta, tb, 2.0, 3.0, tf(spark, c)), 2 * a @ b + 3 * c)


def naive_conv(x, w, p, s, d):
    x = np.pad(x, ((0, 0), (0, 0), (p[0],) * 2, (p[1],) * 2))
    oh, ow = (K.conv_output(x.shape[2 + k], w.shape[2 + k], 0, s[k], d[k]) for k in (0, 1))
    y = np.zeros((x.shape[0], w.shape[0], oh, ow))
    for i in range(oh):
        for j in range(ow):
            part = x[:, :, i * s[0] : i * s[0] + d[0] * (w.shape[2] - 1) + 1 : d[0], j * s[1] : j * s[1] + d[1] * (w.shape[3] - 1) + 1 : d[1]]
            y[:, :, i, j] = np.einsum("bcij,ocij->bo", part, w)
    return y


OPTIONS = [((3, 3), 0, 1, 1), ((1, 1), (0, 1), 1, 1), ((3, 2), 1, (1, 2), 1), ((2, 3), (1, 0), 2, (1, 2)), ((1, 3), 2, 1, 1), ((2, 2), 1, 2, 2)]


@pytest.mark.parametrize("kernel,p,s,d", OPTIONS)
def test_conv(spark, kernel, p, s, d):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(2, 3, 7, 6)), rng.normal(size=(2, 3, *kernel))
    P, S, D = K.pair(p), K.pair(s), K.pair(d)
    want = naive_conv(x, w, P, S, D)
    y = O.conv2(tf(spark, x), tf(spark, w), None, p, s, d)
    same(y, want)
    cols = O.im2col(tf(spark, x), kernel, p, s, d)
    c = cols.to_numpy()
    assert np.allclose((c @ w.reshape(2, -1).T).reshape(2, *want.shape[2:], 2).transpose(0, 3, 1, 2), want)
    # The adjoints: <A x, g> = <x, A' g>.
    g = rng.normal(size=c.shape)
    assert np.isclose((c * g).sum(), (x * O.col2im(tf(spark, g), x.shape, kernel, p, s, d).to_numpy()).sum())
    g = rng.normal(size=want.shape)
    dx, dw = O.conv2_backward_input(tf(spark, g), tf(spark, w), x.shape, p, s, d).to_numpy(), O.conv2_backward_weight(tf(spark, x), tf(spark, g), kernel, p, s, d).to_numpy()
    assert np.isclose((want * g).sum(), (x * dx).sum()) and np.isclose((want * g).sum(), (w * dw).sum())


def test_conv1_and_bias(spark):
    rng = np.random.default_rng(2)
    x, w, b = rng.normal(size=(2, 3, 9)), rng.normal(size=(4, 3, 3)), rng.normal(size=4)
    want = naive_conv(x[..., None], w[..., None], (1, 0), (2, 1), (1, 1))[..., 0] + b[:, None]
    same(O.conv1(tf(spark, x), tf(spark, w), tf(spark, b), 1, 2), want)


@pytest.mark.parametrize("kernel,stride", [(2, None), (3, 1), ((2, 3), (2, 1))])
def test_pool(spark, kernel, stride):
    x = cyc((2, 2, 6, 6), 0, 10)
    k = K.pair(kernel)
    s = k if stride is None else K.pair(stride)
    view = np.lib.stride_tricks.sliding_window_view(x, k, axis=(2, 3))[:, :, :: s[0], :: s[1]]
    want = view.max(axis=(4, 5))
    same(O.max_pool2(tf(spark, x), kernel, stride), want)
    dy = np.arange(want.size, dtype=float).reshape(want.shape)
    dx = np.zeros_like(x)
    for i in np.ndindex(want.shape):
        at = np.unravel_index(view[i].argmax(), k)
        dx[i[0], i[1], i[2] * s[0] + at[0], i[3] * s[1] + at[1]] += dy[i]
    same(O.max_pool2_backward(tf(spark, x), tf(spark, dy), kernel, stride), dx)


def test_save_and_load(spark, tmp_path):
    x = tf(spark, cyc((2, 3)), "f32")
    x.save(f"{tmp_path}/x")
    y = TensorFrame.load(spark, f"{tmp_path}/x")
    assert (y.shape, y.dtype) == ((2, 3), "f32")
    same(y, cyc((2, 3)))
    same(TensorFrame.ones(spark, (2, 2)), np.ones((2, 2)))
    same(TensorFrame.from_column(x.dense(), "row_id", "value", (3, 1)), cyc((2, 3, 1)))
