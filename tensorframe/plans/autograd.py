"""Reverse-mode differentiation over TensorFrames.

The tape is on the driver: nodes and, for each input of an operator, a function
that extends the plan of its gradient.  Nothing runs until a gradient is
collected or written.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorframe import operators as O
from tensorframe import types as K
from tensorframe.frame import TensorFrame
from tensorframe.functions import cross_entropy, cross_entropy_backward
from tensorframe.operators import blocks
from tensorframe.scratch import discard, materialize

Backward = Callable[[TensorFrame], TensorFrame]


class Node:
    """A gradient slot and the edges to the nodes of the inputs."""

    def __init__(self, shape: tuple[int, ...], edges: Sequence[tuple[Node, Backward]] = (), dtype: str | None = None) -> None:
        self.shape, self.edges, self.dtype = shape, list(edges), dtype
        self.grad: TensorFrame | None = None
        self.done = False
        self.inputs: list[TensorFrame] = []

    def add(self, grad: TensorFrame) -> None:
        if grad.shape != self.shape:
            raise K.ShapeError(f"a gradient of {grad.shape} for a value of {self.shape}")
        if self.dtype is not None and K.is_float(self.dtype) != K.is_float(grad.dtype):
            raise TypeError(f"a gradient of {grad.dtype} for a value of {self.dtype}")
        self.grad = grad if self.grad is None else O.add_assign(self.grad, grad)

    def backward(self, grad: TensorFrame) -> None:
        """Send a gradient down; a second call does nothing.  A node is expanded when no edge to it is pending."""
        if self.done:
            return
        pending: dict[int, int] = {}
        queue, seen = deque([self]), {id(self)}
        while queue:
            for node, _ in queue.popleft().edges:
                pending[id(node)] = pending.get(id(node), 0) + 1
                if id(node) not in seen:
                    seen.add(id(node))
                    queue.append(node)
        self.add(grad)
        cuts = Checkpoints.active
        ready = deque([self])
        while ready:
            node = ready.popleft()
            node.done = True
            for to, f in node.edges:
                to.add(f(node.grad))
                pending[id(to)] -= 1
                if not pending[id(to)]:
                    if cuts is not None:
                        cuts.complete(to)
                    ready.append(to)
            if cuts is not None:
                cuts.expanded(node)


class Checkpoints:
    """While it is active, a tape's activations and gradients are written as they come, and removed after use.

        with Checkpoints(most_bytes):
            model(x).cross_entropy(labels).backward()

    A plan of cells holds all that led to it; an activation that the next layer
    and the way back both read would be worked out again for each of them, all
    layers before it included.  Cut points end that: each operator's result whose
    estimated size still fits into what may be held at a time is written to the
    shared folder at once, as is each gradient when it is complete, so each
    operator runs once in either direction and the inputs are read once by each
    operator on them.  What doesn't fit is worked out again from the cut before.
    An activation goes when the gradients that it is needed for are written; those
    of leaves are always written, and stay.

    Driver data and blocks of rows that are given are never cut: the latter's
    gradients take one pass over the rows.  Rows that come of tables written here
    (a product of large matrices is rows) would be read when those are gone, so
    they are written as what they are.
    """

    active: Checkpoints | None = None

    def __init__(self, most_bytes: int = 1 << 40) -> None:
        self.most, self.held, self.peak = most_bytes, 0, 0
        self._tables: dict[int, tuple[DataFrame, int]] = {}
        self._readers: dict[int, int] = {}
        self._open: list[Node] = []
        self._cut: set[int] = set()
        self._nodes: list[Node] = []

    @staticmethod
    def size(x: TensorFrame) -> int:
        """Estimated bytes of the cells of a tensor, or of its rows."""
        return 8 * (x.size + x.shape[0]) if x.block is not None else x.size * 8 * (x.ndim + 1)

    def __enter__(self) -> Checkpoints:
        self._before, Checkpoints.active = Checkpoints.active, self
        return self

    def __exit__(self, *_) -> None:
        Checkpoints.active = self._before

    def keep(self, x: TensorFrame, always: bool = False) -> TensorFrame:
        """x, as a table if it may be one."""
        size = self.size(x)
        if self._lasts(x) or not always and size > self.most - self.held:
            return x
        rows = x.block is not None
        table = materialize(x.rows if rows else x.df, "activation")
        out = TensorFrame.from_rows(table, x.shape) if rows else x.with_df(table)
        self._tables[id(table)] = table, size
        self.held += size
        self.peak = max(self.peak, self.held)
        return out

    def _lasts(self, x: TensorFrame) -> bool:
        """Driver data, or over rows that come of no table of this."""
        block = x.block or x.sums
        if x.local is not None or block is None:
            return x.local is not None
        names = {table._scratch_path.rpartition("/")[2] for table, _ in self._tables.values()}
        return not names or not any(f.split("/")[-2] in names for f in block.base.df.inputFiles())

    def _key(self, x: TensorFrame) -> int | None:
        """Of the table that a tensor is."""
        return next((id(d) for d in (x._df, x._rows) if d is not None and id(d) in self._tables), None)

    def _drop(self, x: TensorFrame) -> None:
        table, size = self._tables.pop(self._key(x), (None, 0))
        if table is not None:
            discard(table)
            self.held -= size

    def reads(self, node: Node, inputs: Sequence[TensorFrame]) -> None:
        """The way back through a node reads these."""
        node.inputs = [x for x in inputs if self._key(x) is not None]
        for x in node.inputs:
            self._readers[self._key(x)] = self._readers.get(self._key(x), 0) + 1

    def complete(self, node: Node) -> None:
        """All of a node's gradient is there."""
        grad = node.grad
        node.grad = self.keep(grad, always=not node.edges)
        if node.grad is not grad or self._lasts(grad):
            self._cut.add(id(node))

    def expanded(self, node: Node) -> None:
        """A node's edges are followed; what all gradients behind it are written without, goes."""
        self._open.append(node)
        self._nodes.append(node)  # ids of live objects
        settled = lambda n: id(n) in self._cut or n.done and n not in self._open
        again = True
        while again:
            again = False
            for n in list(self._open):
                if n.edges and all(settled(to) for to, _ in n.edges):
                    self._open.remove(n)
                    again = True
                    self._drop(n.grad)
                    for x in n.inputs:
                        self._readers[self._key(x)] -= 1
                        if not self._readers[self._key(x)]:
                            self._drop(x)


class Variable:
    """A value and, if it is differentiated, its node."""

    def __init__(self, value: TensorFrame, node: Node | None = None) -> None:
        self.value, self.node = value, node

    @classmethod
    def custom(cls, value: TensorFrame, edges: Sequence[tuple[Variable, Backward]], also: Sequence[TensorFrame] = ()) -> Variable:
        """An operator of one's own: its value and, for each input, the gradient's way back; also: what that reads besides the inputs."""
        kept = [(v.node, f) for v, f in edges if v.node is not None]
        cuts = Checkpoints.active
        if cuts is not None:
            value = cuts.keep(value)
        node = Node(value.shape, kept, value.dtype) if kept else None
        if cuts is not None and node is not None:
            cuts.reads(node, [*[v.value for v, _ in edges], *also])
        return cls(value, node)

    @classmethod
    def leaf(cls, value: TensorFrame) -> Variable:
        return cls(value, Node(value.shape, dtype=value.dtype))

    @property
    def shape(self) -> tuple[int, ...]:
        return self.value.shape

    @property
    def dtype(self) -> str:
        return self.value.dtype

    @property
    def grad(self) -> TensorFrame | None:
        return self.node.grad if self.node else None

    def cast(self, dtype: str) -> Variable:
        """Another element type; the gradient comes back in the old one."""
        return self.custom(O.cast(self.value, dtype), [(self, lambda g: O.cast(g, self.dtype))])

    def backward(self, grad: TensorFrame | None = None) -> None:
        if self.node is not None:
            self.node.backward(grad if grad is not None else TensorFrame.ones(self.value.spark, self.shape))

    def forward(self, layer) -> Variable:
        return layer(self)

    def reshape(self, shape: Sequence[int]) -> Variable:
        return self.custom(O.reshape(self.value, shape), [(self, lambda g: O.reshape(g, self.shape))])

    def flatten(self) -> Variable:
        return self.custom(O.flatten(self.value), [(self, lambda g: O.reshape(g, self.shape))])

    def permute(self, order: Sequence[int]) -> Variable:
        return self.custom(O.permute(self.value, order), [(self, lambda g: O.permute(g, np.argsort(order).tolist()))])

    def t(self) -> Variable:
        return self.permute(list(range(self.value.ndim))[::-1])

    def broadcast(self, shape: Sequence[int]) -> Variable:
        return self.custom(O.broadcast(self.value, shape), [(self, lambda g: O.broadcast_backward(g, self.shape))])

    def add(self, other: Variable) -> Variable:
        """other is broadcast to self."""
        return self.custom(O.add_assign(self.value, other.value), [(self, lambda g: g), (other, lambda g: O.broadcast_backward(g, other.shape))])

    def dot(self, other: Variable) -> Variable:
        return self.custom(O.dot(self.value, other.value), [(self, lambda g: O.dot(g, other.value, tb=True)), (other, lambda g: O.dot(self.value, g, ta=True))])

    def relu(self) -> Variable:
        return self.custom(O.relu(self.value), [(self, lambda g: O.relu_backward(self.value, g))])

    def conv2(self, w: Variable, **options) -> Variable:
        kernel = w.shape[2:]
        return self.custom(O.conv2(self.value, w.value, **options), [
            (self, lambda g: O.conv2_backward_input(g, w.value, self.shape, **options)),
            (w, lambda g: O.conv2_backward_weight(self.value, g, kernel, **options)),
        ])

    def max_pool2(self, kernel, stride=None) -> Variable:
        """The winning taps are kept for the way back."""
        value, won = O.max_pool2_switches(self.value, kernel, stride)
        won = won if Checkpoints.active is None else Checkpoints.active.keep(won)
        return self.custom(value, [(self, lambda g: O.max_pool2_backward(self.value, g, kernel, stride, won))], [won])

    def cross_entropy(self, target: TensorFrame) -> Variable:
        """The summed loss as rank 0; its gradient is that of the mean.  The incoming gradient must be one cell."""
        return self.custom(cross_entropy(self.value, target), [(self, lambda g: O.scaled(cross_entropy_backward(self.value, target), g))])


def gradient_table(parameters: Iterable[tuple[str, Parameter]]) -> DataFrame:
    """(param, idx, v): the gradients of all parameters that have one, row-major.

    Those that are sums over row blocks come from one pass over the rows, which
    runs forward and backward once; others have a plan of their own.
    """
    grads = {name: p.grad for name, p in parameters if p.grad is not None}
    if not grads:
        raise ValueError("no parameter has a gradient")
    sums = {name: g.sums for name, g in grads.items() if g.sums is not None}
    found = [g.df.select(F.lit(name).alias("param"), g.linear().alias("idx"), F.col("v").cast("double").alias("v")) for name, g in grads.items() if name not in sums]
    if sums:
        found.append(blocks.gathered(sums).select(F.col("name").alias("param"), F.col("at").alias("idx"), "v"))
    return reduce(DataFrame.unionByName, found)


class Parameter:
    """A named value with a gradient slot and the optimizer's state."""

    def __init__(self, value: TensorFrame, name: str = "") -> None:
        self.value, self.name = value, name
        self.state: dict[str, TensorFrame | float] = {}
        self.state_of: str | None = None
        self._node: Node | None = None

    def init_grad(self) -> None:
        """From now on to_variable() gives a differentiated one."""
        self._node = Node(self.value.shape, dtype=self.value.dtype)

    @property
    def grad(self) -> TensorFrame | None:
        return self._node.grad if self._node else None

    def set_grad(self, grad: TensorFrame) -> None:
        """The same gradient in another form."""
        if self._node is None or grad.shape != self.shape:
            raise K.ShapeError(f"a gradient of {grad.shape} for a value of {self.shape}")
        self._node.grad = grad

    def take_grad(self) -> TensorFrame | None:
        grad, self._node = self.grad, None
        return grad

    def to_variable(self) -> Variable:
        return Variable(self.value, self._node)

    @property
    def dtype(self) -> str:
        return self.value.dtype

    @property
    def shape(self) -> tuple[int, ...]:
        return self.value.shape

    def assign(self, value: TensorFrame) -> None:
        """Another value of the same shape and type."""
        self.check(value)
        self.value = value

    def check(self, value: TensorFrame) -> None:
        """Whether a value could be this parameter's; raises if not."""
        if value.shape != self.shape:
            raise K.ShapeError(f"{value.shape} isn't {self.shape}")
        value.require(dtype=self.dtype)

    def cast(self, dtype: str) -> None:
        """Another element type, for the state's tensors too."""
        self.value = O.cast(self.value, dtype)
        self.state = {k: O.cast(s, dtype) if isinstance(s, TensorFrame) else s for k, s in self.state.items()}
