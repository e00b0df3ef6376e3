"""Row blocks: tensors whose first axis are the rows of one frame.

A block keeps, for each row of its base (a frame of a row id and arrays), how its
array follows from the base's: a chain of array kernels.  Operators on blocks of
one base only make the chain longer.  Convolution, activation, pooling and
products with driver-sized weights, forward and backward, thus stay where the
rows are, and when a block is asked for, all its chain runs in one pass of Arrow
batches, ROWS rows at a time; equal parts of chains run once.  Sums over the rows
(gradients of weights, losses) are added up by each task, and only what is as
large as the weights is shuffled; gathered() takes any number of such sums in one
pass.  No cell is exploded or joined at any size.

Blocks of two bases meet by a join of their dense rows on the row id; the joined
base has the columns of both, so whatever was built on either goes on there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorframe import kernels
from tensorframe import types as K

for _module in (kernels, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)  # executors need not have this library

#: Rows that go through the chain at a time: few enough for a core's caches.
ROWS = 128
#: Numbers in a piece of a task's sums.
PIECE = 8192
_names = count()

#: kind: array from the arguments' arrays, options and constants.  Values of "sum:" kinds are added up over all rows.
KERNELS = {
    "reshape": lambda a, o, c: a[0].reshape(len(a[0]), *o),
    "columns": lambda a, o, c: kernels.conv_columns(a[0], *o)[0],
    "conv": lambda a, o, c: kernels.conv_product(a[0], c[0], o),
    "conv_back": lambda a, o, c: kernels.conv_back(a[0], c[0], *o),
    "pooled": lambda a, o, c: kernels.pooled(a[0], *o),
    "pool_back": lambda a, o, c: kernels.pool_back(a[0], a[1], *o),
    "relu": lambda a, o, c: np.where(kernels.passes(a[0]), a[0], 0.0),
    "relu_back": lambda a, o, c: np.where(kernels.passes(a[0]), a[1], 0.0),
    "dense": lambda a, o, c: a[0] @ c[0],
    "shift": lambda a, o, c: a[0] + c[0],
    "plus": lambda a, o, c: a[0] + o * a[1],
    "scale": lambda a, o, c: a[0] * o,
    "scored": lambda a, o, c: kernels.scored(a[0], a[1]),
    "part": lambda a, o, c: a[0][o],
    "sum:conv": lambda a, o, c: (kernels.by_channel(a[1]) @ a[0].T).reshape(o),
    "sum:dense": lambda a, o, c: a[0].T @ a[1],
    "sum:axes": lambda a, o, c: a[0].sum(axis=o),
}


class Base:
    """A frame of i0 and columns of arrays, and the bases that it has the columns of."""

    def __init__(self, df: DataFrame, has: frozenset = frozenset()) -> None:
        self.df, self.has = df, has | {self}
        self.joined: dict[Base, Base] = {}


def meet(a: Base, b: Base) -> Base:
    """A base with the columns of both: one of them, or their join on the row id, which is made once."""
    if b in a.has or a in b.has:
        return a if b in a.has else b
    if b not in a.joined:
        shared = [c for c in b.df.columns if c in a.df.columns and c != "i0"]
        a.joined[b] = b.joined[a] = Base(a.df.join(b.df.drop(*shared).hint("merge"), "i0"), a.has | b.has)
    return a.joined[b]


@dataclass(frozen=True, eq=False)
class Op:
    kind: str
    args: tuple[Op, ...] = ()
    options: object = None
    constants: tuple = ()


@dataclass(frozen=True, eq=False)
class Block:
    """A tensor [n, *inner] by base and chain; with a kind "sum:…", one that the rows are added up to, of shape inner."""

    base: Base
    op: Op
    inner: tuple[int, ...]

    def then(self, kind: str, inner: Sequence[int], options=None, constants: tuple = (), other: Block | None = None) -> Block:
        base, args = (self.base, (self.op,)) if other is None else (meet(self.base, other.base), (self.op, other.op))
        return Block(base, Op(kind, args, options, constants), tuple(inner))

    @property
    def is_sum(self) -> bool:
        return self.op.kind.startswith("sum:")

    def rows(self) -> DataFrame:
        """(i0, value): the arrays, row-major."""
        run = _program([self.op])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, (v,) in run(batches):
                flat = np.ascontiguousarray(v, np.float64).reshape(-1)
                ends = np.linspace(0, len(flat), len(v) + 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["i0", "value"])

        return _read(self.base, [self.op]).mapInArrow(each, "i0 long, value array<double>")


def source(df: DataFrame, arrays: dict[str, tuple[str, tuple[int, ...]]]) -> list[Block]:
    """Blocks of one base from (i0, …): for each column, of arrays or numbers, the inner shape."""
    names = {c: f"c{next(_names)}" for c in arrays}
    kinds = dict(df.dtypes)
    base = Base(df.select("i0", *[(F.col(c) if kinds[c].startswith("array") else F.array(c)).cast("array<double>").alias(n) for c, n in names.items()]))
    return [Block(base, Op("source", (), (names[c], tuple(inner))), tuple(inner)) for c, (_, inner) in arrays.items()]


def _ordered(ops: list[Op]) -> tuple[list[tuple], list[int]]:
    """Steps (kind, places of the arguments, options, constants) in order, equal ones once, and where the ops are."""
    steps: list[tuple] = []
    place: dict = {}
    of: dict[int, int] = {}

    def put(op: Op) -> int:
        if id(op) not in of:
            args = tuple(put(a) for a in op.args)
            key = (op.kind, args, repr(op.options), tuple(map(id, op.constants)))
            if key not in place:
                place[key] = len(steps)
                steps.append((op.kind, args, op.options, op.constants))
            of[id(op)] = place[key]
        return of[id(op)]

    return steps, [put(op) for op in ops]


def _columns(ops: list[Op]) -> list[str]:
    return list(dict.fromkeys(options[0] for kind, _, options, _ in _ordered(ops)[0] if kind == "source"))


def _read(base: Base, ops: list[Op]) -> DataFrame:
    return base.df.select("i0", *_columns(ops))


def _program(ops: list[Op]):
    """For batches of the columns that the ops need: row ids and the ops' arrays, ROWS rows at a time."""
    (steps, wanted), names = _ordered(ops), _columns(ops)
    last = {a: k for k, (_, args, _, _) in enumerate(steps) for a in args}
    rows = ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                values: list = []
                for k, (kind, args, options, constants) in enumerate(steps):
                    if kind == "source":
                        name, inner = options
                        column = part.column(1 + names.index(name))
                        values.append(column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, *inner))
                    else:
                        values.append(KERNELS[kind]([values[a] for a in args], options, constants))
                    for a in args:  # what nothing reads any more
                        if last[a] == k and a not in wanted:
                            values[a] = None
                yield part.column(0), [values[k] for k in wanted]

    return run


def gathered(sums: dict[str, Block]) -> DataFrame:
    """(name, at, v): the numbers of sums over rows, row-major, all of one base in one pass.

    A task adds up its rows; pieces of its sums meet by name and place, and are added one after another.
    """
    bases = list(dict.fromkeys(b.base for b in sums.values()))
    widest = max(bases, key=lambda b: len(b.has))
    if any(b not in widest.has for b in bases):
        widest = reduce(meet, bases)
    names, ops, piece = list(sums), [b.op for b in sums.values()], PIECE
    run = _program(ops)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for _, values in run(batches):
            totals = [np.array(v, np.float64) for v in values] if totals is None else [t + v for t, v in zip(totals, values, strict=True)]
        for name, total in zip(names, totals or [], strict=False):
            flat = total.reshape(-1)
            for k, at in enumerate(range(0, len(flat), piece)):
                yield _piece(name, k, flat[at : at + piece])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            for name, k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if (name, k) == at:
                    total += v.values.to_numpy()
                    continue
                if at is not None:
                    yield _piece(*at, total)
                at, total = (name, k), v.values.to_numpy().copy()
        if at is not None:
            yield _piece(*at, total)

    schema = "name string, piece int, v array<double>"
    parts = _read(widest, ops).mapInArrow(each, schema)
    whole = parts.repartition("name", "piece").sortWithinPartitions("name", "piece").mapInArrow(added, schema)
    cells = whole.select("name", "piece", F.posexplode("v").alias("k", "v"))
    return cells.select("name", (F.col("piece").cast("long") * piece + F.col("k")).alias("at"), "v")


def _piece(name: str, k: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))], names=["name", "piece", "v"])


# --- Operators ----------------------------------------------------------------------------------


def conv2(x: Block, w: np.ndarray, padding, stride, dilation) -> Block:
    kernel = w.shape[2:]
    out = K.conv_shape(x.inner[1:], kernel, padding, stride, dilation)
    columns = x.then("columns", (), (kernel, padding, stride, dilation))
    return columns.then("conv", (w.shape[0], *out), out, (w,))


def conv2_backward_input(dy: Block, w: np.ndarray, inner, padding, stride, dilation) -> Block:
    return dy.then("conv_back", inner, (tuple(inner), padding, stride, dilation), (w,))


def conv2_backward_weight(x: Block, dy: Block, kernel, padding, stride, dilation) -> Block:
    shape = (dy.inner[0], x.inner[0], *kernel)
    return x.then("columns", (), (kernel, padding, stride, dilation)).then("sum:conv", shape, shape, other=dy)


def max_pool2(x: Block, kernel, stride) -> tuple[Block, Block]:
    """The values that win the windows, and their taps."""
    inner = (x.inner[0], *K.conv_shape(x.inner[1:], kernel, (0, 0), stride, (1, 1)))
    both = x.then("pooled", (), (kernel, stride))
    return both.then("part", inner, 0), both.then("part", inner, 1)


def max_pool2_backward(won: Block, dy: Block, inner, kernel, stride) -> Block:
    return won.then("pool_back", inner, (tuple(inner), kernel, stride), other=dy)


def cross_entropy(x: Block, target: Block) -> tuple[Block, Block, Block]:
    """Each row's loss, whether it is right (1 or 0), and the gradient of the summed loss."""
    found = x.then("scored", (), other=target.then("reshape", (), ()))
    return found.then("part", (), 0), found.then("part", (), 1), found.then("part", x.inner, 2)


def total(x: Block, axes: Sequence[int] = ()) -> Block:
    """The sum over the rows and some inner axes (counted from 1)."""
    return x.then("sum:axes", [d for k, d in enumerate(x.inner, 1) if k not in axes], (0, *axes))
