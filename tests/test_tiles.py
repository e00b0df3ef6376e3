"""Products of two large matrices."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorframe import operators as O
from tensorframe import types as K
from tensorframe.frame import TensorFrame
from tensorframe.operators import linalg, tiles
from tensorframe.operators.tiles import Tiles, gram, outer
from tensorframe.queries import ORACLES, QUERIES, rounded


def cells(spark, a):
    return TensorFrame(TensorFrame.from_numpy(spark, a).df, a.shape)


def rows(spark, a):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "i0 long, value array<float>").repartition(3)
    return TensorFrame.from_rows(df, a.shape)


def whole(r, *shape):
    return r.integers(-9, 9, shape).astype(float)


@pytest.mark.parametrize("m,k,n", [(1, 1, 1), (7, 9, 4), (13, 8, 11), (3, 20, 3)])
@pytest.mark.parametrize("tasks", [1, 50])
def test_tiles_of_all_shapes(spark, m, k, n, tasks):
    """Tiles of three, groups of two: borders, several groups along each axis, one stretch and many."""
    r = np.random.default_rng(m)
    a, b = whole(r, m, k), whole(r, k, n)
    for one, two in ((rows(spark, a), cells(spark, b)), (cells(spark, a), rows(spark, b))):
        got = Tiles.of(one, 3).dot(Tiles.of(two, 3), group=2, tasks=tasks)
        assert got.grid == (-(-m // 3), -(-n // 3)) and np.array_equal(got.frame(2.0).to_numpy(), 2 * a @ b)


def test_transposed_and_bordered_tiles(spark):
    a = whole(np.random.default_rng(1), 8, 5)
    x = Tiles.of(rows(spark, a), 3)
    assert np.array_equal(x.frame().to_numpy(), a) and np.array_equal(x.transposed().frame().to_numpy(), a.T)
    assert np.array_equal(x.transposed().dot(x, tasks=3).frame().to_numpy(), a.T @ a)
    with pytest.raises(K.ShapeError):
        x.dot(x)


def test_gram(spark):
    r = np.random.default_rng(2)
    a, b = whole(r, 40, 5), whole(r, 40, 3)
    x, y = rows(spark, a), cells(spark, b)
    assert np.array_equal(gram(x, y).to_numpy(), a.T @ b) and np.array_equal(gram(x, x).to_numpy(), a.T @ a)
    assert "Join" not in gram(x, x).df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("ta", [False, True])
@pytest.mark.parametrize("tb", [False, True])
@pytest.mark.parametrize("gram_cells", [0, 1 << 20])
def test_dot_of_large_matrices(spark, monkeypatch, ta, tb, gram_cells):
    monkeypatch.setattr(linalg, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(linalg, "GRAM_CELLS", gram_cells)
    r = np.random.default_rng(3)
    a, b, c = whole(r, 9, 7), whole(r, 7, 10), whole(r, 9, 10)
    got = O.dot(rows(spark, a.T if ta else a), cells(spark, b.T if tb else b), ta, tb, alpha=0.5, beta=2.0, c=TensorFrame.from_numpy(spark, c))
    assert np.array_equal(got.to_numpy(), 0.5 * a @ b + 2 * c)
    plan = got.df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan


def test_the_query_of_all_vectors_by_one_another(spark, tmp_path):
    """A number for each pair, over a border of tiles, as its SQL says."""
    v = np.random.default_rng(7).integers(-9, 10, (270, 64)) / 4
    spark.createDataFrame([(i, x.tolist(), i % 10) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.i0, r.i1): r.v for r in QUERIES["q_dot_large"](spark, str(tmp_path)).toLocalIterator()}
    want = np.round(v @ v.T, 4)
    assert len(got) == 270 * 270 and all(got[i, j] == want[i, j] for i in range(270) for j in range(270))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert {(i, j): x for i, j, x in db.execute(ORACLES["q_dot_large"]).fetchall()} == got


@pytest.mark.parametrize("m,n,k", [(1, 1, 1), (7, 20, 4), (25, 3, 2)])
@pytest.mark.parametrize("tasks,strip", [(1, 1 << 19), (50, 1 << 19), (1, 1)])
def test_strips_of_rows_by_one_another(spark, monkeypatch, m, n, k, tasks, strip):
    """Tiles of three: one strip a side, many for the tasks, and as many as their size asks for."""
    monkeypatch.setattr(tiles, "STRIP", strip)
    r = np.random.default_rng(m)
    a, b = whole(r, m, k), whole(r, n, k)
    got = outer(rows(spark, a), rows(spark, b), 3, tasks)
    places = sorted((t.ti, t.tj) for t in got.df.select("ti", "tj").collect())
    assert places == [(i, j) for i in range(-(-m // 3)) for j in range(-(-n // 3))]
    assert np.array_equal(got.frame(2.0).to_numpy(), 2 * a @ b.T)
    with pytest.raises(K.ShapeError):
        outer(rows(spark, a), rows(spark, whole(r, n, k + 1)))


def test_products_of_short_rows_shuffle_the_rows_once(spark, tmp_path):
    """Not once for each group of the other side's, which are three here."""
    n, store = 4200, spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    v = np.random.default_rng(8).normal(size=(n, 64)).astype(np.float32)
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df, before = QUERIES["q_dot_large"](spark, str(tmp_path)), written()
    got = df.agg(F.count("v").alias("n"), F.sum("v").alias("total")).first()
    assert got.n == n * n and got.total == pytest.approx(float((v.astype(float).sum(0) ** 2).sum()), abs=1000)
    assert 0 < sum(x for s, x in written().items() if s not in before) < 2.5 * n * 64 * 8


def test_rounding_is_that_of_decimal_text(spark):
    """Ties, their neighbours, numbers too large for whole multiples, and none."""
    ties = [(k + 0.5) / 10**4 for k in range(-300, 300)] + [1.00005, 1.00015, 2.00025, 0.15, -0.0, 0.0, 1e-300, 123456789.00005, 2.0**36, 2.0**53 + 2, 1e300]
    values = [x for t in ties for x in (t, np.nextafter(t, -np.inf).item(), np.nextafter(t, np.inf).item())] + np.random.default_rng(9).normal(size=2000).tolist()
    df = spark.createDataFrame([(x,) for x in [*values, *(-x for x in values), float("nan"), float("inf"), float("-inf"), None]], "v double")
    assert df.select(rounded("v", 4).alias("a"), F.round("v", 4).alias("b")).filter("NOT (a <=> b)").count() == 0


def test_integers_are_not_rounded(spark, monkeypatch):
    monkeypatch.setattr(linalg, "BROADCAST_CELLS", 0)
    a = np.array([[2**53 + 1, 1], [3, -(2**40)]])
    x = TensorFrame.from_numpy(spark, a, "i64")
    eye = TensorFrame.from_numpy(spark, np.eye(2, dtype=np.int64), "i64")
    assert O.dot(x, eye).to_numpy().tolist() == a.tolist()


def test_no_row_is_a_multiply(spark, monkeypatch):
    """What is shuffled for 60 by 40 by 60 numbers: tiles and slices of rows, not cells."""
    monkeypatch.setattr(linalg, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(linalg, "GRAM_CELLS", 0)
    x = rows(spark, whole(np.random.default_rng(4), 60, 40))
    plan = O.dot(x, x, tb=True).df._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("RepartitionByExpression")
    assert "Join" not in plan and "posexplode" not in below and F is not None
