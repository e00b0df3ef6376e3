"""Numbers for any rows, and keyed permutations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorframe.sources import Permutation, batched, dense, sequential, shuffled


def test_numbers_of_any_keys(spark):
    """Gaps, repeats, nulls and strings: numbers are 0 … n-1 in the order of the keys."""
    keys = ["b", None, "a", "zz", "b", "", "é", None] * 5 + ["hot"] * 300
    rows = spark.createDataFrame([(k, i % 3, i) for i, k in enumerate(keys)], "k string, v int, `row.id` int").repartition(7)
    got = dense(rows, "k", "number").collect()
    assert sorted(r.number for r in got) == list(range(len(keys)))
    by = [r.k for r in sorted(got, key=lambda r: r.number)]
    assert by == sorted(keys, key=lambda k: (k is not None, (k or "").encode()))
    assert sorted(r["row.id"] for r in got) == list(range(len(keys)))


def test_rows_of_one_kind_fill_several_ranges(spark):
    rows = spark.range(4000).select(F.lit("x").alias("k")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be one range
    numbered = dense(rows, "k")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.row_id for r in numbered.collect()) == list(range(4000))
    sizes = [r["count"] for r in numbered.withColumn("f", F.input_file_name()).groupBy("f").count().collect()]
    assert max(sizes) < 2500 and "Window" not in numbered._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_stay(spark):
    rows = spark.range(500).select((F.col("id") % 50).alias("k"), F.lit(1).alias("v")).repartition(5)
    numbered = dense(rows, ["k", "v"])
    assert sorted(map(tuple, numbered.collect())) == sorted(map(tuple, numbered.repartition(3).collect()))
    assert dense(rows.limit(0), "k").count() == 0 and dense(rows, "k", "v").columns == ["k", "v"]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 103, 1000, 1024, 9973])
def test_permutations_are_bijections(n):
    for seed in (1, 13):
        p = Permutation(n, seed)
        x = p.once(np.arange(p.n))
        for _ in range(p.walks):
            x = np.where(x >= p.n, p.once(x), x)
        assert sorted(x.tolist()) == list(range(p.n)) and p.walks < 20


def test_neighbours_are_scattered():
    """An affine map keeps a fixed distance between neighbours; here places of neighbours don't tell of one another."""
    n = 20_000
    p = Permutation(n, 5)
    x = p.once(np.arange(n))
    for _ in range(p.walks):
        x = np.where(x >= n, p.once(x), x)
    for lag in (1, 2, 17, p.b):
        assert abs(np.corrcoef(x[:-lag], x[lag:])[0, 1]) < 0.05
    assert len(np.unique(np.diff(x))) > n / 3 and abs(np.corrcoef(np.arange(n), x)[0, 1]) < 0.05
    # The first batch is a sample of all rows.
    first = np.flatnonzero(x < 1000)
    assert abs(first.mean() / n - 0.5) < 0.05


def test_columns_equal_arrays(spark):
    n, seed = 1003, 3
    p = Permutation(n, seed)
    x = p.once(np.arange(n))
    for _ in range(p.walks):
        x = np.where(x >= n, p.once(x), x)
    rows = spark.range(n).withColumnRenamed("id", "a.b")
    got = shuffled(rows, 10, n, seed, "a.b")
    assert "Exchange" not in got._jdf.queryExecution().optimizedPlan().toString()
    got = got.collect()
    assert all(r.place == x[r["a.b"]] and r.batch_id == r.place // 10 for r in got)
    assert [r.batch_id for r in sequential(rows, 250, "a.b").orderBy("`a.b`").collect()] == [i // 250 for i in range(n)]


def test_batches_of_any_rows(spark):
    rows = spark.createDataFrame([(f"id{i * 7}", i) for i in range(95)], "k string, v int").repartition(4)
    for seed in (None, 4):
        got = batched(rows, 20, "k", seed)
        assert sorted(r["count"] for r in got.groupBy("batch_id").count().collect()) == [15, 20, 20, 20, 20]
