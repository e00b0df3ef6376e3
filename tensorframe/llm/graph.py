"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorframe.llm.common import discard, materialize, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node with an edge; root is the component's smallest node.

    edges: (a, b) of longs.  Alternating large-star and small-star rounds until
    nothing changes; each round's edges are a table in the shared folder, so that
    a lost executor costs no more than a round.  Only a count and a checksum
    come to the driver.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = _round_end(e)
    while seen[0]:
        # Large star: the larger end of each edge goes to the smaller end's least neighbour.  Only nodes
        # with a smaller neighbour have one; hubs at which many edges end are salted.
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        large = spread_join(e.select(F.col("v").alias("k"), "u"), least.select(F.col("u").alias("k"), "m"), "k", "left").select("u", F.coalesce("m", "k").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = e
        e, now = _round_end(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _round_end(e: DataFrame) -> tuple[DataFrame, tuple]:
    e = materialize(e, "edges")
    return e, tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
