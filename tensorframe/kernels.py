"""Array kernels of single operators, for Arrow batches on executors: NumPy only.

Arrays have a batch of rows along the first axis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def conv_columns(x: np.ndarray, kernel, padding, stride, dilation) -> tuple[np.ndarray, tuple[int, int]]:
    """[c·fh·fw, n·oh·ow]: a block copy for each tap, so that one product gives all channels."""
    (ph, pw), (sh, sw), (dh, dw) = padding, stride, dilation
    x = np.pad(x, ((0, 0), (0, 0), (ph, ph), (pw, pw))) if ph or pw else x
    n, c, h, w = x.shape
    oh, ow = (h - dh * (kernel[0] - 1) - 1) // sh + 1, (w - dw * (kernel[1] - 1) - 1) // sw + 1
    cols = np.empty((c, *kernel, n, oh, ow), x.dtype)
    by_channel = x.transpose(1, 0, 2, 3)
    for i in range(kernel[0]):
        for j in range(kernel[1]):
            cols[:, i, j] = by_channel[:, :, i * dh : i * dh + sh * (oh - 1) + 1 : sh, j * dw : j * dw + sw * (ow - 1) + 1 : sw]
    return cols.reshape(c * kernel[0] * kernel[1], -1), (oh, ow)


def conv_product(cols: np.ndarray, w: np.ndarray, out: tuple[int, int]) -> np.ndarray:
    """[n, o, oh, ow] from patch columns."""
    return (w.reshape(w.shape[0], -1) @ cols).reshape(w.shape[0], -1, *out).transpose(1, 0, 2, 3)


def by_channel(g: np.ndarray) -> np.ndarray:
    """[o, n·oh·ow] of [n, o, oh, ow]."""
    return g.transpose(1, 0, 2, 3).reshape(g.shape[1], -1)


def conv_back(g: np.ndarray, w: np.ndarray, shape, padding, stride, dilation) -> np.ndarray:
    """The gradient at the input, of inner shape (c, h, w)."""
    (ph, pw), (sh, sw), (dh, dw) = padding, stride, dilation
    n, _, oh, ow = g.shape
    back = (w.reshape(w.shape[0], -1).T @ by_channel(g)).reshape(shape[0], *w.shape[2:], n, oh, ow)
    x = np.zeros((n, shape[0], shape[1] + 2 * ph, shape[2] + 2 * pw), g.dtype)
    for i in range(w.shape[2]):
        for j in range(w.shape[3]):
            x[:, :, i * dh : i * dh + sh * (oh - 1) + 1 : sh, j * dw : j * dw + sw * (ow - 1) + 1 : sw] += back[:, i, j].transpose(1, 0, 2, 3)
    return x[:, :, ph : ph + shape[1], pw : pw + shape[2]]


def taps(shape, kernel, stride) -> Iterator[tuple]:
    """For each tap of a window, the slices of the cells that it meets."""
    oh, ow = (shape[2] - kernel[0]) // stride[0] + 1, (shape[3] - kernel[1]) // stride[1] + 1
    for i in range(kernel[0]):
        for j in range(kernel[1]):
            yield (slice(None), slice(None), slice(i, i + stride[0] * (oh - 1) + 1, stride[0]), slice(j, j + stride[1] * (ow - 1) + 1, stride[1]))


def pooled(x: np.ndarray, kernel, stride) -> tuple[np.ndarray, np.ndarray]:
    """The value that wins each window, and its tap, as a byte (two if there are more taps).

    From the first tap, a later one wins only if it is greater; NaN is greater
    than nothing, and nothing than it, so it wins if it is first and else never.
    """
    best = won = None
    for k, tap in enumerate(taps(x.shape, kernel, stride)):
        v = x[tap]
        if won is None:
            best, won = v.copy(), np.zeros(v.shape, np.uint8 if kernel[0] * kernel[1] <= 256 else np.uint16)
            continue
        with np.errstate(invalid="ignore"):
            better = v > best
        won[better] = k
        np.copyto(best, v, where=better)
    return best, won


def maxima(x: np.ndarray, kernel, stride) -> np.ndarray:
    """The values of pooled() alone: maxima, as long as there is no NaN."""
    best = None
    for tap in taps(x.shape, kernel, stride):
        best = x[tap].copy() if best is None else np.maximum(best, x[tap], out=best)
    return pooled(x, kernel, stride)[0] if np.isnan(best).any() else best


def pool_back(won: np.ndarray, g: np.ndarray, shape, kernel, stride) -> np.ndarray:
    """g at the winning taps of an input of inner shape (c, h, w), added up where windows overlap."""
    x = np.zeros((len(g), *shape), g.dtype)
    for k, tap in enumerate(taps(x.shape, kernel, stride)):
        x[tap] += np.where(won == k, g, g.dtype.type(0))
    return x


def passes(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return x >= 0


def checked(labels: np.ndarray, classes: int) -> np.ndarray:
    """Labels as indices; one that is none of the classes, or missing, raises."""
    at = np.asarray(labels)
    bad = ~((at >= 0) & (at < classes)) | (at != np.floor(at))
    if bad.any():
        raise ValueError(f"no such class: {at[bad][0]}")
    return at.astype(np.int64)


def scored(logits: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's cross-entropy, whether its label's logit is above every other (not if either is NaN), and the gradient."""
    labels = checked(labels, logits.shape[1])
    at = np.arange(len(labels)), labels
    m = logits.max(axis=1, keepdims=True)
    e = np.exp(logits - m)
    s = e.sum(axis=1, keepdims=True)
    loss = np.log(s[:, 0]) - (logits[at] - m[:, 0])
    g = e / s
    g[at] -= 1
    with np.errstate(invalid="ignore"):
        beaten = logits < logits[at][:, None]
    beaten[at] = ~np.isnan(logits[at])
    return loss, beaten.all(axis=1), g


def to_bf16(a: np.ndarray) -> np.ndarray:
    """The nearest numbers with bfloat16's eight significant bits, ties to even, as 32-bit floats; NaN stays."""
    a = np.ascontiguousarray(a, np.float32)
    b = a.view(np.uint32)
    near = (b + np.uint32(0x7FFF) + ((b >> np.uint32(16)) & np.uint32(1))) & np.uint32(0xFFFF0000)
    return np.where(np.isnan(a), a, near.view(np.float32))
