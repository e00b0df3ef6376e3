"""Products of two large matrices by dense tiles.

A matrix is a table of tiles (ti, tj, tile): EDGE by EDGE numbers, row-major,
fewer at the borders.  Tiles of rows come from dense rows, which are cut and
shuffled as slices, or from cells; either way once.

C = A·B follows a replicated schedule.  Rows of tiles of A, and columns of tiles
of B, are divided into groups of GROUP; the inner axis is cut into as many
stretches (replicas of the output's grid) as it takes to keep all tasks busy.
A task has a group of rows, one of columns and a stretch, and goes along it: at
each inner place it holds a column of its group's tiles of A and a row of those
of B, each pair of which is one NumPy product, added into its square of tiles of
C.  What it holds is thus GROUP squared and twice GROUP tiles, however long the
stretch.  A tile of A is sent once for each group of columns of C (not for each
column, or cell), a tile of B once for each group of rows; the replicas' squares
are added up tile by tile after one more shuffle, if there are any.

Where the output is small and the inner axis long (AᵀB of tall matrices),
gram() needs no tiles: each task adds up its rows' outer products.  Where the
inner axis is short (ABᵀ of tall matrices), copies for each group would outgrow
the input with its square; outer() shuffles the rows once, into strips that meet
in a Cartesian product.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorframe import types as K
from tensorframe.frame import TensorFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this library

#: Rows and columns of a tile: half a megabyte of doubles.
EDGE = 256
#: Tiles along an edge of a group: a task holds 64 tiles of the output, 32 MB, and 16 of the factors.
GROUP = 8
#: Numbers of an output that each task may hold whole, for gram().
GRAM_CELLS = 1 << 20
#: Numbers of a strip of rows, for outer(): 4 MB of doubles.
STRIP = 1 << 19
_SCHEMA = "ti long, tj long, tile array<double>"


class Tiles:
    """[m, n] as (ti, tj, tile)."""

    def __init__(self, df: DataFrame, shape: tuple[int, int], edge: int) -> None:
        self.df, self.shape, self.edge = df, shape, edge

    @property
    def grid(self) -> tuple[int, int]:
        return tuple(-(-x // self.edge) for x in self.shape)

    @classmethod
    def of(cls, x: TensorFrame, edge: int = EDGE) -> Tiles:
        """From a matrix: of dense rows, slices are shuffled; of cells, cells."""
        m, n = x.require(ndim=2).shape
        width = lambda tj: min(edge, n - tj * edge)
        height = lambda ti: min(edge, m - ti * edge)
        if x.rows is not None:
            cuts = F.sequence(F.lit(0).cast("long"), F.lit(max(0, -(-n // edge) - 1)).cast("long"))
            pieces = x.rows.select("i0", F.col("value").cast("array<double>").alias("value"), F.explode(cuts).alias("tj"))
            pieces = pieces.select(F.expr(f"i0 div {edge}L").alias("ti"), "tj", (F.col("i0") % edge).cast("int").alias("at"), F.slice("value", (F.col("tj") * edge + 1).cast("int"), F.lit(edge)).alias("v"))

            def stacked(t: pa.Table) -> pa.Table:
                ti, tj = t.column("ti")[0].as_py(), t.column("tj")[0].as_py()
                out = np.zeros((height(ti), width(tj)))
                out[t.column("at").to_numpy()] = t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
                return _tile(ti, tj, out)

            return cls(pieces.groupBy("ti", "tj").applyInArrow(stacked, _SCHEMA), (m, n), edge)

        def filled(t: pa.Table) -> pa.Table:
            ti, tj = t.column("ti")[0].as_py(), t.column("tj")[0].as_py()
            out = np.zeros((height(ti), width(tj)))
            out[t.column("r").to_numpy(), t.column("c").to_numpy()] = t.column("v").to_numpy()
            return _tile(ti, tj, out)

        cells = x.df.select(
            F.expr(f"i0 div {edge}L").alias("ti"), F.expr(f"i1 div {edge}L").alias("tj"), (F.col("i0") % edge).cast("int").alias("r"), (F.col("i1") % edge).cast("int").alias("c"), F.col("v").cast("double").alias("v")
        )
        return cls(cells.groupBy("ti", "tj").applyInArrow(filled, _SCHEMA), (m, n), edge)

    def transposed(self) -> Tiles:
        """Each tile turned where it is; nothing is shuffled."""
        (m, n), edge = self.shape, self.edge

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    ti, tj = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                    a = b.column(2)[k].values.to_numpy().reshape(min(edge, m - ti * edge), -1)
                    yield _tile(tj, ti, a.T).to_batches()[0]

        return Tiles(self.df.mapInArrow(run, _SCHEMA), (n, m), edge)

    def dot(self, other: Tiles, group: int = GROUP, tasks: int | None = None) -> Tiles:
        """The product, by groups of tiles; tasks: how many should have work, by default as many as a shuffle has partitions."""
        if self.shape[1] != other.shape[0] or self.edge != other.edge:
            raise K.ShapeError(f"{self.shape} and {other.shape} don't multiply")
        (rows, inner), columns = self.grid, other.grid[1]
        high, wide = max(1, -(-rows // group)), max(1, -(-columns // group))
        tasks = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if tasks is None else tasks
        replicas = max(1, min(inner, -(-tasks // (high * wide))))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        stretch = lambda c: F.expr(f"{c} * {replicas}L div {max(inner, 1)}L").alias("gk")
        left = self.df.select(F.expr(f"ti div {group}L").alias("gi"), each(wide).alias("gj"), stretch("tj"), F.col("tj").alias("tk"), F.lit(0).alias("side"), F.col("ti").alias("t"), "tile")
        right = other.df.select(each(high).alias("gi"), F.expr(f"tj div {group}L").alias("gj"), stretch("ti"), F.col("ti").alias("tk"), F.lit(1).alias("side"), F.col("tj").alias("t"), "tile")
        m, k, n, edge = self.shape[0], self.shape[1], other.shape[1], self.edge

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, at, column, sums = None, None, [], {}
            for b in batches:
                gi, gj, gk, tk, side, t = (b.column(c).to_pylist() for c in range(6))
                for r in range(b.num_rows):
                    if (gi[r], gj[r], gk[r]) != key:
                        yield from _tiles(sums)
                        key, at, sums = (gi[r], gj[r], gk[r]), None, {}
                    if tk[r] != at:
                        at, column = tk[r], []
                    a = b.column(6)[r].values.to_numpy().reshape(min(edge, (k if side[r] else m) - (at if side[r] else t[r]) * edge), -1)
                    if not side[r]:
                        column.append((t[r], a.copy()))
                        continue
                    for ti, left_tile in column:  # they came before
                        if (ti, t[r]) in sums:
                            sums[ti, t[r]] += left_tile @ a
                        else:
                            sums[ti, t[r]] = left_tile @ a
            yield from _tiles(sums)

        keys = ["gi", "gj", "gk"]
        out = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "tk", "side").mapInArrow(multiply, _SCHEMA)
        if replicas > 1:
            out = out.repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(_added, _SCHEMA)
        return Tiles(out, (m, n), edge)

    def frame(self, alpha: float = 1.0) -> TensorFrame:
        """The matrix of cells; its dense rows too where a tile is as wide as it is."""
        (m, n), edge = self.shape, self.edge
        if n <= edge:
            per = F.transform(F.sequence(F.lit(0), F.expr(f"int(size(tile) / {max(n, 1)}) - 1")), lambda r: F.struct((F.col("ti") * edge + r).alias("i0"), F.slice("tile", r * n + 1, F.lit(n)).alias("value")))
            rows = self.df.filter(F.size("tile") > 0).select(F.inline(per))
            return TensorFrame.from_rows(rows if alpha == 1 else rows.select("i0", F.transform("value", lambda x: x * F.lit(alpha)).alias("value")), (m, n))
        width = F.least(F.lit(edge).cast("long"), F.lit(n).cast("long") - F.col("tj") * edge)
        cells = self.df.select("ti", "tj", width.alias("w"), F.posexplode("tile").alias("at", "v"))
        return TensorFrame(cells.select((F.col("ti") * edge + F.expr("at div w")).alias("i0"), (F.col("tj") * edge + F.col("at") % F.col("w")).alias("i1"), (F.col("v") * F.lit(alpha)).alias("v")), (m, n))


def _tile(ti: int, tj: int, a: np.ndarray) -> pa.Table:
    flat = pa.array(np.ascontiguousarray(a, np.float64).reshape(-1))
    return pa.table({"ti": pa.array([ti], pa.int64()), "tj": pa.array([tj], pa.int64()), "tile": pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)})


def _tiles(sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (ti, tj), a in sums.items():
        yield _tile(ti, tj, a).to_batches()[0]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of tiles of one place, which stand one after another; one tile is held at a time."""
    at, total = None, None
    for b in batches:
        for r in range(b.num_rows):
            place, tile = (b.column(0)[r].as_py(), b.column(1)[r].as_py()), b.column(2)[r].values.to_numpy()
            if place == at:
                total += tile
                continue
            if at is not None:
                yield from _tiles({at: total})
            at, total = place, tile.copy()
    if at is not None:
        yield from _tiles({at: total})


def outer(a: TensorFrame, b: TensorFrame, edge: int = EDGE, tasks: int | None = None) -> Tiles:
    """ABᵀ of matrices of short dense rows: a task has a strip of A's rows and one of B's, and gives its tiles one by one.

    A strip is read again for each of the other side's from where it was shuffled to, so what is
    written on the way has the size of the input; tasks: how many should have work, as in Tiles.dot.
    """
    (m, k), (n, _) = a.require(ndim=2).shape, b.require(ndim=2).shape
    if k != b.shape[1]:
        raise K.ShapeError(f"{a.shape} and {b.shape} have rows of different lengths")
    tasks = int(a.spark.conf.get("spark.sql.shuffle.partitions")) if tasks is None else tasks
    most, least = max(1, STRIP // (edge * max(k, 1))), math.isqrt(max(0, 2 * tasks - 1)) + 1

    def strips(x: TensorFrame, other: int, ids: str, values: str) -> tuple[DataFrame, int]:
        """(strip, its numbers), a partition each, and more of them where the other side's rows give few; and the tiles along one."""
        length, grid = x.shape[0], -(-x.shape[0] // edge)
        wanted = max(least, -(-2 * tasks // max(1, -(-other // edge))))
        per = max(1, -(-grid // max(1, -(-grid // most), min(grid, wanted)))) * edge

        def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for t in batches:
                strip, at, v = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).flatten().to_numpy().reshape(t.num_rows, k)
                for s in np.unique(strip).tolist():
                    own = strip == s
                    found.setdefault(s, np.zeros((min(per, length - s * per), k)))[at[own]] = v[own]
            for s, out in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.ListArray.from_arrays(pa.array([0, out.size], pa.int32()), out.reshape(-1))], names=[ids, values])

        rows = x.rows.select(F.expr(f"int(i0 div {per}L)").alias("s"), F.expr(f"int(i0 % {per}L)").alias("at"), F.col("value").cast("array<double>").alias("v"))
        return rows.repartitionById(max(1, -(-length // per)), "s").mapInArrow(stacked, f"{ids} int, {values} array<double>"), per // edge

    (left, high), (right, wide) = strips(a, n, "p", "x"), strips(b, m, "q", "y")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for r in range(t.num_rows):
                p, x, q, y = (t.column(c)[r] for c in range(4))
                x, y = (z.values.to_numpy().reshape(-1, k) for z in (x, y))
                for i in range(0, len(x), edge):
                    for j in range(0, len(y), edge):
                        yield from _tiles({(p.as_py() * high + i // edge, q.as_py() * wide + j // edge): x[i : i + edge] @ y[j : j + edge].T})

    return Tiles(left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(multiply, _SCHEMA), (m, n), edge)


def gram(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    """AᵀB of matrices of as many rows: each task's outer products in one sum, one row of which is shuffled for each row of the output.

    Rows meet by their index, unless a is b.
    """
    (_, m), (_, n) = a.require(ndim=2).shape, b.require(ndim=2).shape
    left = a.dense("i0", "x").select("i0", F.col("x").cast("array<double>").alias("x"))
    rows = left.select("x", F.col("x").alias("y")) if a is b else left.join(b.dense("i0", "y").hint("merge"), "i0").select("x", F.col("y").cast("array<double>").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, n))
        for batch in batches:
            x, y = (batch.column(k).flatten().to_numpy().reshape(batch.num_rows, -1) for k in (0, 1))
            total += x.T @ y
        ends = pa.array(np.arange(m + 1, dtype=np.int32) * n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.ListArray.from_arrays(ends, pa.array(total.reshape(-1)))], names=["i0", "value"])

    partial = rows.mapInArrow(run, "i0 long, value array<double>")

    # A row of the output from each task: they are added as they come.
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i == at:
                    total += v.values.to_numpy()
                    continue
                if at is not None:
                    yield _row(at, total)
                at, total = i, v.values.to_numpy().copy()
        if at is not None:
            yield _row(at, total)

    return TensorFrame.from_rows(partial.repartition("i0").sortWithinPartitions("i0").mapInArrow(added, "i0 long, value array<double>"), (m, n))


def _row(i: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))], names=["i0", "value"])
