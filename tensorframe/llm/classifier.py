"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text gives a row of statistics (lengths, shares of kinds of
characters, repetition of words and lines), which is written once.  The trees
are grown on the labelled rows, at most about SAMPLE of them, chosen by a hash
of the doc_id: statistics become bins, whose edges are quantiles; for each level
of a tree every task adds up the rows' gradients by node, statistic and bin, the
driver adds the tasks' histograms, of a size that no table changes, and picks
the best split of each node.  Gradients are whole multiples of a small unit, so
sums don't depend on how rows are dealt out, and a rerun or a lost executor
gives the same trees.  Margins aren't kept anywhere: a task works them out from
the trees so far.

A model is flattened into arrays (statistic, threshold, value of each node of
complete binary trees, in heap order); to score a batch, all its rows go down
all trees a level at a time.

Defined cases: a null or empty text has statistics of zero and a score; a row
without a doc_id isn't held out and has no label; several labels of one doc_id
count as their mean, null ones not at all; of repeated rows of a labelled doc_id
one is learnt from; without labels each score is 0.5, with labels of one kind
near it; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorframe.llm.common import discard, materialize, slices, table, tidy

FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "upper", "digits", "marks", "symbols", "beyond_ascii", "spaces", "newlines", "entropy",
    "distinct_words", "repeats_next", "commonest_word", "words_ending_in_marks", "capital_words", "line_words", "repeated_lines", "sentence_words",
)
#: Labelled rows that trees are grown on, about: a bound of the fit, not of what is scored.
SAMPLE = 200_000
TREES = 24
DEPTH = 3
BINS = 32
RATE = 0.3
#: Added to a node's second derivatives: small nodes give small values.
RIDGE = 1.0
#: Least gain of a split; a tree without one ends the fit.
LEAST_GAIN = 1e-3
#: Gradients are whole multiples of this, and sums of them exact.
UNIT = 2.0**-20
#: Rows of the training table in a partition, about.
ROWS = 25_000
HELD_OUT = 2
THRESHOLD = 0.7

_upper, _digit, _space = (np.array([chr(c) in s for c in range(256)]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c"))
_mark = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
_symbol = np.array([chr(c) in "#$%&*|<>@^~=+\\{}[]_/" for c in range(256)])
_ends = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def statistics(text: bytes) -> list[float]:
    """FEATURES of a UTF-8 text, in order."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    words, lines = text.split(), [x for x in text.split(b"\n") if not x.isspace() and x]
    m = len(words)
    tally: dict[bytes, int] = {}
    last, next_to, marked, capital, longest = None, 0, 0, 0, 0
    for w in words:
        tally[w] = tally.get(w, 0) + 1
        next_to += w == last
        last = w
    for w, k in tally.items():
        marked += k * (w[-1] in _ends)
        capital += k * (w.isupper() and len(w) > 1)
        longest = max(longest, len(w))
    per = max(m, 1)
    return [
        math.log1p(n), math.log1p(m), sum(len(w) * k for w, k in tally.items()) / per, min(longest, 1000), counts[_upper].sum() / n, counts[_digit].sum() / n, counts[_mark].sum() / n, counts[_symbol].sum() / n,
        counts[128:].sum() / n, counts[_space].sum() / n, counts[10] / n, float(-(share * np.log2(share)).sum()),
        len(tally) / per, next_to / per, max(tally.values(), default=0) / per, marked / per, capital / per, m / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), m / (1 + counts[46] + counts[33] + counts[63]),
    ]


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([statistics(t or b"") for t in b.column(1).to_pylist()], np.float64).reshape(-1)
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], names=["doc_id", "x"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary")).mapInArrow(tidy(run), "doc_id long, x array<double>")


@dataclass
class Trees:
    """Complete binary trees in heap order: node k's children are 2k + 1 (at most the threshold) and 2k + 2."""

    depth: int = DEPTH
    base: float = 0.0
    statistic: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))  # [trees, inner nodes]
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # [trees, leaves]

    def leaves(self, x: np.ndarray, statistic: np.ndarray, threshold: np.ndarray, depth: int) -> np.ndarray:
        """[rows, trees]: the node of a level that each row is at, in each tree."""
        trees = np.arange(len(statistic))
        at = np.zeros((len(x), len(statistic)), np.int64)
        for _ in range(depth):
            right = np.take_along_axis(x, statistic[trees, at], 1) > threshold[trees, at]
            at = 2 * at + 1 + right
        return at - ((1 << depth) - 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.value):
            return np.full(len(x), self.base)
        return self.base + self.value[np.arange(len(self.value)), self.leaves(x, self.statistic, self.threshold, self.depth)].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def with_tree(self, statistic: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> Trees:
        add = lambda old, new: new[None] if not len(old) else np.vstack([old, new])
        return Trees(self.depth, self.base, add(self.statistic, statistic), add(self.threshold, threshold), add(self.value, value))


def _matrix(b: pa.RecordBatch, column: int) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _histograms(rows: DataFrame, model: Trees, statistic: np.ndarray, threshold: np.ndarray, level: int, bins: int) -> np.ndarray:
    """[node of the level, statistic, bin, (gradient, second derivative)] over all rows, in whole units.

    rows: (bins of the statistics, label).  Each task gives one vector, whose size
    only the model has a say in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = _matrix(b, 0)
            n, width = x.shape
            p = model.scores(x)
            node = model.leaves(x, statistic[None], threshold[None], level)[:, 0]
            cell = ((node[:, None] * width + np.arange(width)) * bins + x).reshape(-1)
            parts = [np.rint(v / UNIT) for v in (p - b.column(1).to_numpy(), p * (1 - p))]
            sums = np.stack([np.bincount(cell, np.repeat(v, width), (1 << level) * width * bins) for v in parts], axis=1)
            total = sums if total is None else total + sums
        if total is not None:
            flat = total.astype(np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))], names=["h"])

    found = rows.mapInArrow(tidy(run), "h array<long>").toArrow()
    return sum(x.values.to_numpy() for x in found.column("h").combine_chunks()).reshape(1 << level, -1, bins, 2) * UNIT


def _splits(h: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best (statistic, bin) of each node and its gain, from histograms; ties go to the first."""
    left = h.cumsum(axis=2)[:, :, :-1]
    whole = h.sum(axis=2)[:, :1, None]
    gain = sum(x[..., 0] ** 2 / (x[..., 1] + ridge) for x in (left, whole - left)) - whole[..., 0] ** 2 / (whole[..., 1] + ridge)
    flat = gain.reshape(len(h), -1)
    best = flat.argmax(axis=1)
    statistic, at = np.divmod(best, gain.shape[2])
    return statistic, at, np.take_along_axis(flat, best[:, None], 1)[:, 0]


def binned(x: DataFrame, edges: np.ndarray) -> DataFrame:
    """(x as bins, label) of (x, label): how many of a statistic's edges a value is above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b, 0)
            out = np.stack([np.searchsorted(e, v[:, k], "left") for k, e in enumerate(edges)], axis=1).astype(np.int32)
            ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1))), b.column(1)], names=["x", "label"])

    return x.mapInArrow(run, "x array<int>, label double")


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE) -> Trees:
    """Trees for logistic loss from (x, label), label from 0 to 1."""
    rows = materialize(rows.select("x", F.col("label").cast("double")), "labelled")
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n:
        return Trees(depth)
    cuts = [k / bins for k in range(1, bins)]
    width = rows.agg(F.max(F.size("x"))).first()[0]
    found = rows.agg(*[F.percentile_approx(F.col("x")[k], cuts, 10_000).alias(f"q{k}") for k in range(width)]).first()
    edges = np.array([list(q) for q in found])
    data = materialize(binned(rows, edges).coalesce(max(1, -(-n // ROWS))), "binned")
    discard(rows)
    share = min(max((positive + 1) / (n + 2), 1e-6), 1 - 1e-6)
    model = Trees(depth, math.log(share / (1 - share)))
    for _ in range(trees):
        statistic, threshold = np.zeros((1 << depth) - 1, np.int32), np.full((1 << depth) - 1, bins, np.float64)
        gains = 0.0
        for level in range(depth):
            h = _histograms(data, model, statistic, threshold, level, bins)
            chosen, at, gain = _splits(h, ridge)
            first = (1 << level) - 1
            for node in range(1 << level):
                if gain[node] > LEAST_GAIN:  # else all of the node goes left
                    statistic[first + node], threshold[first + node] = chosen[node], at[node]
                    gains += gain[node]
        if not gains:
            break
        # The leaves' sums are the two sides of the last level's splits.
        value = np.zeros(1 << depth)
        for node in range(1 << depth - 1):
            cut = int(threshold[(1 << depth - 1) - 1 + node])
            own = h[node, statistic[(1 << depth - 1) - 1 + node]]
            for side, s in enumerate((own[: cut + 1].sum(axis=0), own[cut + 1 :].sum(axis=0))):
                value[2 * node + side] = -rate * s[0] / (s[1] + ridge)
        model = model.with_tree(statistic, threshold, value)
    discard(data)
    # Bins become values: above a bin is above its upper edge; what is never above stays so.
    model.threshold = np.where(model.threshold >= bins, np.inf, edges[model.statistic, np.minimum(model.threshold, bins - 2).astype(int)]) if len(model.value) else model.threshold
    return model


def scored(x: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) of (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(_matrix(b, 1)))], names=["doc_id", "score"])

    return x.select("doc_id", "x").mapInArrow(tidy(run), "doc_id long, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def training_rows(x: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(x, label): one row of each labelled doc_id that isn't held out, of about `sample` of these."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL").filter(~held_out())
    own = own.groupBy("doc_id").agg(F.avg("label").alias("label"))
    n = own.count()
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample / max(n, 1)))
    # Of both sides only what can be in the sample is shuffled, and a row of each doc_id is found before that.
    x = x.filter(~held_out() & chosen).groupBy("doc_id").agg(F.min("x").alias("x"))
    return x.join(own.filter(chosen), "doc_id").select("x", "label")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    x = materialize(described(docs), "statistics")
    model = fit(training_rows(x, labels, label, sample), **settings)
    return scored(x, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
