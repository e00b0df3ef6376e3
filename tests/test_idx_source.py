"""IDX files that many tasks read and write."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorframe.sources import digits, read_idx, read_split, write_idx
from tensorframe.sources.idx import decode


def test_round_trip_by_many_tasks(spark, tmp_path):
    r = np.random.default_rng(0)
    a, t = r.integers(0, 256, (103, 4, 5)), r.integers(0, 10, 103)
    df = spark.createDataFrame([(i, v.reshape(-1).tolist(), [int(c)]) for i, (v, c) in enumerate(zip(a, t, strict=True))], "row_id long, x array<int>, t array<int>").repartition(7)
    images, labels = (str(tmp_path / n) for n in ("train-images-idx3-ubyte", "train-labels-idx1-ubyte"))
    write_idx(df, images, (103, 4, 5), value="x")
    write_idx(df, "file://" + labels, (103,), value="t")
    assert np.array_equal(decode(open(images, "rb").read()), a) and np.array_equal(decode(open(labels, "rb").read()), t)
    back = read_split(spark, images, split=200)
    assert back.rdd.getNumPartitions() == 11
    rows = back.collect()
    assert [x.row_id for x in sorted(rows)] == list(range(103)) and np.array_equal([x.value for x in sorted(rows)], a.reshape(103, -1))
    assert sorted(map(tuple, read_idx(spark, images).select("row_id", F.hash("value")).collect())) == sorted(map(tuple, back.select("row_id", F.hash("value")).collect()))
    got = digits(spark, str(tmp_path), suffix="", shape=(4, 5)).orderBy("row_id").collect()
    assert [x.label for x in got] == t.tolist() and np.array_equal([x.value for x in got], a.reshape(103, -1))
    with pytest.raises(ValueError):
        digits(spark, str(tmp_path), suffix="", shape=(5, 4))


def test_bad_files_and_rows(spark, tmp_path):
    path = str(tmp_path / "x")
    rows = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "row_id long, value array<int>")
    for shape, bad in (((3, 1, 2), rows), ((2, 1, 3), rows), ((1, 1, 2), rows), ((2, 1, 2), rows.withColumn("value", F.array(F.lit(1), F.lit(256))))):
        with pytest.raises(Exception):
            write_idx(bad, path, shape)
        assert not (tmp_path / "x").exists()
    write_idx(rows.limit(0), path, (0, 2, 2))
    assert read_split(spark, path).count() == 0
    write_idx(rows, path, (2, 1, 2))
    data = open(path, "rb").read()
    for content in (data[:-1], b"\0" * 20, data[:7]):
        open(path, "wb").write(content)
        with pytest.raises(Exception):
            read_split(spark, path).collect()
    with pytest.raises(Exception, match="opened as a file"):
        read_split(spark, "hdfs://there/x").collect()
