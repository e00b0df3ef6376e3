"""Batches: a number on each row.

Rows with dense ids 0, 1, … need no sort, as ids are places.  Others get such ids
from dense(): any key will do, with gaps, repeats, strings or nulls.  A shuffled
order of n places is a keyed permutation of them, which needs no sort either.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorframe.scratch import materialize

#: A prime: products of two residues fit into 64 bits.
_P = 2**31 - 1
ROUNDS = 4


def sequential(rows: DataFrame, batch_size: int, row_id: str = "row_id") -> DataFrame:
    """batch_id by dense row ids 0, 1, …; the last batch may be short."""
    return rows.withColumn("batch_id", _div(F.col(f"`{row_id}`"), batch_size))


def _div(x: Column, n: int) -> Column:
    return F.call_function("div", x, F.lit(n).cast("long"))


def dense(rows: DataFrame, by: str | Sequence[str], name: str = "row_id") -> DataFrame:
    """rows with a number 0 … n-1 by the order of some columns, nulls first.

    Ranges of the keys are sorted apart, and written with each row's place in its
    range, so that a retried task can't number them otherwise; what a range's
    places start at is the sum of the lengths of those before it, of which the
    driver sees one number a range.  Rows of one key go by a hash of all their
    columns; a key, or even a row, that is repeated very often fills several
    ranges.  rows must come from a table, or be the same each time they are read.
    """
    keys = [by] if isinstance(by, str) else list(by)
    inner = [f"k{k}" for k in range(len(rows.columns))]
    named = rows.toDF(*inner)
    order = [inner[rows.columns.index(k)] for k in keys]
    named = named.withColumn("_tie", F.xxhash64(*inner)).withColumn("_cut", F.monotonically_increasing_id() % 1024)
    sorted_ = named.repartitionByRange(*order, "_tie", "_cut").sortWithinPartitions(*order, "_tie", "_cut").drop("_tie", "_cut")
    laid = materialize(sorted_.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    low = (1 << 33) - 1
    part = F.shiftrightunsigned("_at", 33)
    counts = laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    in_order = np.argsort(counts.column("part").to_numpy())
    parts, sizes = counts.column("part").to_numpy()[in_order], counts.column("n").to_numpy()[in_order]
    # Broadcast: a row for each range, whatever the rows.
    starts = rows.sparkSession.createDataFrame(list(zip(parts.tolist(), (np.cumsum(sizes) - sizes).tolist(), strict=True)), "_part long, _start long")
    out = laid.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_id", F.col("_start") + F.col("_at").bitwiseAND(F.lit(low)))
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, rows.columns, strict=True) if c != name], F.col("_id").alias(name))


def batched(rows: DataFrame, batch_size: int, by: str | Sequence[str], seed: int | None = None, name: str = "row_id") -> DataFrame:
    """Batches of any rows in the order of some columns, or in a shuffled order of theirs."""
    numbered = dense(rows, by, name)
    return sequential(numbered, batch_size, name) if seed is None else shuffled(numbered, batch_size, numbered.count(), seed, name)


class Permutation:
    """A keyed permutation of 0 … n-1: a Feistel network over a grid of a by b places, a·b >= n.

    A round adds to one coordinate, modulo its length, a number that the other
    and the key give.  Of the grid, fewer than a places aren't below n; what comes
    to one of these goes through the network again (cycle walking).  The driver
    follows all such places, about the root of n, and so knows how often that can
    be needed: the column has as many steps, and is a bijection for certain.
    """

    def __init__(self, n: int, seed: int, rounds: int = ROUNDS) -> None:
        self.n = max(n, 1)
        self.a = isqrt(self.n - 1) + 1
        self.b = -(-self.n // self.a)
        # Multipliers and summands of each round, from a small generator of their own.
        state, self.keys = (seed * 48_271 + 11) % _P, []
        for _ in range(rounds):
            key = []
            for _ in range(3):
                state = (state * 48_271 + 1_234_567) % _P
                key.append(1 + state % (_P - 1))
            self.keys.append(tuple(key))
        outside = np.arange(self.n, self.a * self.b, dtype=np.int64)
        self.walks = 0
        while len(outside):
            outside = self.once(outside)
            outside = outside[outside >= self.n]
            self.walks += 1

    def once(self, x: np.ndarray) -> np.ndarray:
        """Places of the grid, through the network."""
        left, right = x // self.b, x % self.b
        for k, (multiplier, summand, other) in enumerate(self.keys):
            t = ((left if k % 2 else right) % _P * multiplier + summand) % _P
            t = (t * t + other) % _P  # not linear
            if k % 2:
                right = (right + t) % self.b
            else:
                left = (left + t) % self.a
        return left * self.b + right

    def column(self, df: DataFrame, place: str, name: str) -> DataFrame:
        """df with the permuted place as another column; a projection a round, so that no expression is doubled."""
        df = df.withColumn("_x", F.col(f"`{place}`").cast("long"))
        mod = lambda v, m: v % F.lit(m).cast("long")
        for walk in range(1 + self.walks):
            df = df.withColumns({"_l": _div(F.col("_x"), self.b), "_r": mod(F.col("_x"), self.b)})
            for k, (multiplier, summand, other) in enumerate(self.keys):
                df = df.withColumn("_t", mod(mod(F.col("_l" if k % 2 else "_r"), _P) * multiplier + summand, _P))
                t = mod(F.col("_t") * F.col("_t") + other, _P)
                df = df.withColumn("_r", mod(F.col("_r") + t, self.b)) if k % 2 else df.withColumn("_l", mod(F.col("_l") + t, self.a))
            once = F.col("_l") * F.lit(self.b).cast("long") + F.col("_r")
            df = df.withColumn("_x", once if not walk else F.when(F.col("_x") >= self.n, once).otherwise(F.col("_x")))
        return df.withColumn(name, F.col("_x")).drop("_x", "_l", "_r", "_t")


def shuffled(rows: DataFrame, batch_size: int, n: int, seed: int = 13, row_id: str = "row_id") -> DataFrame:
    """Each row once, in a seeded order: row ids 0 … n-1 go through a keyed permutation.

    It needs no sort and no shuffle, unlike a random order of the whole, and is
    the same at every rerun; neighbours are no nearer afterwards than others.
    """
    return sequential(Permutation(n, seed).column(rows, row_id, "place"), batch_size, "place")
