"""Array kernels of a layer stack, for Arrow batches on executors.

A plan is a list of (kernel, options, parameter names); parameters are arrays by
name.  A kernel is a pair of functions (and perhaps a third, for values alone): forward (x, options, parameters) gives the
value and what the way back needs; backward (g, that, options, parameters, first)
gives the gradient at the input (None will do if the layer is the first) and
those of the parameters.  Only NumPy is used, so executors need nothing of this
library.
"""

from __future__ import annotations

import numpy as np

from tensorframe import kernels as K


def dense(x, options, params):
    y = x @ params[0]
    return (y + params[1] if len(params) > 1 else y), x


def dense_back(g, saved, options, params, first):
    grads = [saved.T @ g]
    if len(params) > 1:
        grads.append(g.sum(axis=0))
    return None if first else g @ params[0].T, grads


def _four(w):
    """Weights of one spatial axis get a second one."""
    return w if w.ndim == 4 else w[..., None]


def conv(x, options, params):
    w = _four(params[0])
    cols, out = K.conv_columns(x, w.shape[2:], *options)
    y = K.conv_product(cols, w, out)
    return (y + params[1][:, None, None] if len(params) > 1 else y), (x.shape, cols)


def conv_back(g, saved, options, params, first):
    (shape, cols), w, flat = saved, _four(params[0]), K.by_channel(g)
    grads = [(flat @ cols.T).reshape(params[0].shape)]
    if len(params) > 1:
        grads.append(flat.sum(axis=1))
    return None if first else K.conv_back(g, w, shape[1:], *options), grads


def pool(x, options, params):
    y, won = K.pooled(x, *options)
    return y, (x.shape[1:], won)


def pool_values(x, options, params):
    return K.maxima(x, *options), None


def pool_back(g, saved, options, params, first):
    shape, won = saved
    return K.pool_back(won, g, shape, *options), []


def relu(x, options, params):
    return np.fmax(x, x.dtype.type(0)), K.passes(x)  # of NaN and 0 it is 0


def relu_values(x, options, params):
    return np.fmax(x, x.dtype.type(0)), None


def relu_back(g, saved, options, params, first):
    return np.where(saved, g, g.dtype.type(0)), []


def flatten(x, options, params):
    return x.reshape(x.shape[0], -1), x.shape


def widen(x, options, params):
    """[n, c, h] to [n, c, h, 1]."""
    return x[..., None], x.shape


def narrow(x, options, params):
    return x[..., 0], x.shape


def shape_back(g, saved, options, params, first):
    return g.reshape(saved), []


DENSE, CONV, POOL, RELU = (dense, dense_back), (conv, conv_back), (pool, pool_back, pool_values), (relu, relu_back, relu_values)
FLATTEN, WIDEN, NARROW = (flatten, shape_back), (widen, shape_back), (narrow, shape_back)


def forward(plan: list, params: dict[str, np.ndarray], x: np.ndarray, keep: list | None = None, half: bool = False) -> np.ndarray:
    """Logits; keep gets what backward() needs of each layer; half: every value is rounded to bfloat16, sums are those of its type."""
    for kernel, options, names in plan:
        run = kernel[2] if keep is None and len(kernel) > 2 else kernel[0]
        x, saved = run(x, options, [params[n] for n in names])
        if half:
            x = K.to_bf16(x)
        if keep is not None:
            keep.append(saved)
    return x


def backward(plan: list, params: dict[str, np.ndarray], kept: list, g: np.ndarray, half: bool = False) -> dict[str, np.ndarray]:
    """Gradients of the parameters from that of the logits."""
    grads: dict[str, np.ndarray] = {}
    for at in range(len(plan) - 1, -1, -1):
        (kernel, options, names), saved = plan[at], kept[at]
        g, own = kernel[1](g, saved, options, [params[n] for n in names], at == 0)
        if half and g is not None:
            g = K.to_bf16(g)
        for n, d in zip(names, own, strict=True):
            grads[n] = grads[n] + d if n in grads else d
    return grads


def loss(logits: np.ndarray, labels: np.ndarray) -> tuple[float, int, np.ndarray]:
    """Summed cross-entropy, correct rows (strictly the largest), and the summed loss's gradient."""
    each, right, g = K.scored(logits, labels)
    return float(each.sum(dtype=np.float64)), int(right.sum()), g
