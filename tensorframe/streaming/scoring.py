"""Scoring a stream: the same Arrow kernels as for tables, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorframe.plans.train import Net, predict


def score_stream(rows: DataFrame, net: Net, shape: tuple[int, ...], scale: float = 1.0) -> DataFrame:
    """(row_id, logits, label) of a streaming or static frame of (row_id, value); label is the first of the largest logits."""
    scored = predict(rows, net, shape, scale)
    return scored.withColumn("label", (F.array_position("logits", F.array_max("logits")) - 1).cast("int"))
