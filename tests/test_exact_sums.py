"""Sums that don't depend on the order of rows."""

import math
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorframe import operators as O
from tensorframe.frame import TensorFrame


def bits(v):
    return struct.pack(">d", v)


def frame(spark, a, parts):
    return TensorFrame(TensorFrame.from_numpy(spark, a).df.repartition(parts, F.rand(parts)), a.shape)


def nearest(values):
    return float(sum(map(Fraction, values), Fraction(0)))


@pytest.mark.parametrize("kind", ["cancelling", "wide", "tiny", "prices"])
def test_equal_bits_under_three_partitionings(spark, kind):
    r = np.random.default_rng(4)
    n = 600
    a = {
        "cancelling": np.concatenate([r.normal(size=n) * 1e16, r.normal(size=n)]), "wide": r.normal(size=2 * n) * 2.0 ** r.integers(-200, 200, 2 * n),
        "tiny": r.normal(size=2 * n) * 2.0 ** r.integers(-1074, -1000, 2 * n), "prices": np.round(r.random(2 * n) * 1e5, 2),
    }[kind].reshape(-1, 4)
    a[3] = -a[2]
    a[:, 1][: len(a) // 2] = -a[:, 1][len(a) // 2 :]
    for sums, want in ((lambda x: O.sum_axis(x, 0, exact=True), [nearest(c) for c in a.T.tolist()]), (lambda x: O.sum_all(x, exact=True), [nearest(a.reshape(-1).tolist())])):
        found = {tuple(bits(v) for v in np.atleast_1d(sums(frame(spark, a, parts)).to_numpy()).tolist()) for parts in (1, 3, 7)}
        assert found == {tuple(bits(v) for v in want)}


def test_odd_numbers(spark):
    a = np.array([[1e308, 1e308], [np.inf, 1.0], [np.inf, -np.inf], [np.nan, 1.0], [0.0, -0.0], [5e-324, 5e-324], [1e308, -1e308]])
    got = O.sum_axis(frame(spark, a, 2), 1, exact=True).to_numpy().tolist()
    assert got[:2] == [math.inf, math.inf] and math.isnan(got[2]) and math.isnan(got[3]) and got[4:] == [0.0, 1e-323, 0.0]
    assert O.sum_axis(TensorFrame.zeros(spark, (0, 3)), 0, exact=True).to_numpy().tolist() == [0, 0, 0]
    assert O.sum_axis(TensorFrame.from_numpy(spark, np.arange(6).reshape(2, 3), "i32"), 0, exact=True).dtype == "i64"
    assert O.sum_all(frame(spark, a[4:], 2), 2.0, TensorFrame.from_numpy(spark, np.array(3.0)), exact=True).to_numpy() == 6.0
