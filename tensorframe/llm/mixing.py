"""Mixing sources to target weights along a curriculum.

Each source has a weight and a schedule: at training time t in 0..1 its share is
in proportion to 1 + slope * (2t - 1).  The schedule's integral up to 1 is the
source's target, that up to t its cumulative demand; inverting the demand at a
document's place among its source's words gives the document's training
position, and documents are range-sorted by position.

Targets share the whole by weight; one may not exceed `most` times its source,
and what that leaves is shared among the others (water filling, solved in closed
form over sources ordered by size per weight).  A source's documents, in order
of a hash of their ids and texts, are taken whole passes first; the last pass
takes those that fit before the first that doesn't, and does so again among the
others that fit what room is left, until none does: what a source misses of its
target is less than its smallest document that is left over.

Running sums never put a source into one task: sums by range of hash, added up
per source, start windows over (source, range).  Three windows run over all
sources at once, with one row a source.  Positions are rounded to nine digits;
documents at one position are ordered by their hashes.

Defined cases: null texts have size 0 and are never taken; a null source is a
source of its own, ordered last; null ids are told apart by their texts;
repeated rows and doc_ids are taken as separate documents; an empty table gives
an empty result; other columns are ignored by mix() and kept by train_order(),
whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorframe.llm.common import WORD, materialize, null_key, spread_join

WEIGHTS = (1, 2, 3)
MOST = 3
#: A source's slope by its place: early, even or late in training.
SLOPES = (-0.5, 0.0, 0.5)


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """totals (source, source_size) with weight, slope's place, and target; as many rows as sources."""
    by_name = Window.partitionBy().orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    t = totals.withColumn("place", place).withColumn("weight", F.element_at(F.lit(list(weights)), F.col("place") + 1).cast("long"))
    fill = Window.partitionBy().orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum(most * F.col("source_size")).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    t = t.withColumn("n", F.row_number().over(fill)).withColumn("level", (F.sum("source_size").over(everything) - before) / left)
    fits = F.col("level") * F.col("weight") <= most * F.col("source_size")
    level = F.min(F.when(fits, F.struct("n", "level"))).over(everything)["level"]
    return t.withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), level * F.col("weight"))).drop("n", "level")


def _starts(sized: DataFrame) -> DataFrame:
    """What of each (skey, bucket)'s source is in the buckets before: start."""
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sized.groupBy("skey", "bucket").agg(F.sum("size").alias("b")).withColumn("start", F.coalesce(F.sum("b").over(before), F.lit(0))).drop("b")


def _fill_up(spare: DataFrame) -> DataFrame:
    """The rows of spare (rid, skey, bucket, at, size, rest, filled) that are taken, with their places `last` in the last pass.

    Each round takes at least the first spare document of each source that has one.
    """
    columns, rounds = spare.columns, []
    inside = Window.partitionBy("skey", "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        last = F.col("filled") + F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
        done = materialize(spare.join(_starts(spare), ["skey", "bucket"]).withColumn("last", last).withColumn("fits", F.col("last") + F.col("size") <= F.col("rest")).select(*columns, "last", "fits"), "mixing")
        rounds.append(done.filter("fits").select("rid", "skey", "size", "last"))
        if done.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        ends = done.filter("fits").groupBy("skey").agg(F.max(F.col("last") + F.col("size")).alias("end"))
        spare = spread_join(done.filter("not fits").select(columns), ends, "skey", few=True).withColumn("filled", F.col("end")).filter(F.col("size") <= F.col("rest") - F.col("filled")).select(columns)


def _plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """A row for each of rows (rid, doc_id, source, text): rid, doc_id, source, size, h, source_size, target, times, taken, positions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # By the text too: null ids, and those of many rows, are spread.
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    sized = materialize(rows.select("rid", "doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), h.alias("h")), "mixing")
    # A key without nulls, and the range of the hash: any number of ranges gives the same order.
    sized = sized.withColumn("skey", null_key("source")).withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * n, 32))
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    aims = aims.withColumn("skey", null_key("source")).drop("source")
    aims = aims.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    starts = _starts(sized).join(aims, "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("h", "rid").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(starts, ["skey", "bucket"]).withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("fits", (F.col("size") > 0) & (F.col("at") + F.col("size") <= F.col("rest")))
    # What the last pass has room for after the first documents; then others that fit.
    placed = materialize(placed.drop("start"), "mixing")
    room = placed.groupBy("skey").agg(F.coalesce(F.max(F.when(F.col("fits"), F.col("at") + F.col("size"))), F.lit(0)).alias("filled"))
    spare = spread_join(placed, room, "skey", few=True).filter(~F.col("fits") & (F.col("size") > 0) & (F.col("size") <= F.col("rest") - F.col("filled"))).select("rid", "skey", "bucket", "at", "size", "rest", "filled")
    extra = _fill_up(spare)
    ends = room.join(extra.groupBy("skey").agg(F.sum("size").cast("double").alias("more")), "skey", "left")
    d = spread_join(placed, ends, "skey", few=True).join(extra.select("rid", "last"), "rid", "left")
    once = F.col("fits") | ((F.col("size") > 0) & F.col("last").isNotNull())
    d = d.withColumn("n_times", F.when(F.col("size") > 0, F.col("full") + once.cast("long")).otherwise(0))
    # The extra documents come after those that fitted; what is taken in all scales the demand to 0..1.
    last = F.when(F.col("fits"), F.col("at")).otherwise(F.coalesce("last", "filled"))
    start = lambda k: k * F.col("source_size") + F.when(k < F.col("full"), F.col("at")).otherwise(last)
    total = F.greatest(F.col("full") * F.col("source_size") + F.col("filled") + F.coalesce("more", F.lit(0.0)), F.lit(1.0))
    share = lambda k: F.least((start(k) + F.col("size") / 2) / total, F.lit(1.0))
    slope = F.element_at(F.lit(list(slopes)), F.col("place") + 1)
    # a t^2 + (1 - a) t = u, in the form that is stable also at a = 0.
    time = lambda u: F.round(2 * u / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u)), 9)
    passes = F.when(F.col("n_times") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_times") - 1)).otherwise(F.array().cast("array<bigint>"))
    return d.select(
        "rid", "doc_id", "source", "size", "h", "source_size", "target", F.col("n_times").alias("times"), (F.col("size") * F.col("n_times")).alias("taken"),
        F.transform(passes, lambda k: time(share(k))).alias("positions"),
    )


def _ordered(plan: DataFrame) -> DataFrame:
    """(rid, shard, place): a row for each time a document is taken, range-sorted; place counts from 0 over all shards."""
    n = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = plan.select("rid", "h", F.explode("positions").alias("position"))
    times = materialize(times.repartitionByRange(n, "position", "h", "rid").withColumn("shard", F.spark_partition_id()), "order")
    # A row for each shard.
    before = Window.partitionBy().orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = times.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard").orderBy("position", "h", "rid")
    return times.withColumn("nth", F.row_number().over(inside) - 1).join(firsts, "shard").select("rid", "shard", (F.col("first") + F.col("nth")).alias("place"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, times, taken, positions (one for each time).

    settings: weights, most and slopes.
    """
    return _plan(docs.select("doc_id", "source", "text").withColumn("rid", F.monotonically_increasing_id()), **settings).drop("rid", "h")


def train_order(docs: DataFrame, **settings) -> DataFrame:
    """The documents as training sees them: a row for each time one is taken, in order of position.

    Positions are planned and sorted without the texts, which meet their shards afterwards.
    """
    names = [f"k{i}" for i in range(len(docs.columns))]
    own = {c: names[docs.columns.index(c)] for c in ("doc_id", "source", "text")}
    # As a table, so that a task that is run again can't give its rows other numbers.
    rows = materialize(docs.toDF(*names).withColumn("rid", F.monotonically_increasing_id()), "documents")
    order = _ordered(materialize(_plan(rows.select("rid", *[F.col(k).alias(c) for c, k in own.items()]), **settings).select("rid", "h", "positions"), "plan"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(order, "rid").repartitionById(n, F.col("shard")).sortWithinPartitions("place").select(*names).toDF(*docs.columns)


def digests(docs: DataFrame) -> DataFrame:
    """mix() with the places that a document has in the order of training, as numbers joined by commas."""
    plan = materialize(_plan(docs.select("doc_id", "source", "text").withColumn("rid", F.monotonically_increasing_id())), "plan")
    # As many places as a document is taken, at most `most`.
    places = _ordered(plan).groupBy("rid").agg(F.array_join(F.sort_array(F.collect_list("place")).cast("array<string>"), ",").alias("places"))
    return plan.join(places, "rid", "left").select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), F.coalesce("places", F.lit("")).alias("places"))


_SLOPE = "(CASE place WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END)"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM s),
v AS (SELECT *, place + 1 AS weight FROM w),
l AS (SELECT *, row_number() OVER o AS n, (sum(source_size) OVER ()::BIGINT - coalesce(sum(3 * source_size) OVER (o {_BEFORE}), 0)::BIGINT)::DOUBLE
        / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM v WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
g AS (SELECT level FROM l WHERE level * weight <= 3 * source_size ORDER BY n LIMIT 1),
a AS (SELECT l.source, source_size, place, least(3.0::DOUBLE * source_size, (SELECT level FROM g) * weight) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM a),
c AS (SELECT d.*, b.* EXCLUDE (source), target - times * source_size AS rest,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, rid {_BEFORE}), 0)::BIGINT AS pos
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
e AS (SELECT *, size > 0 AND pos + size <= rest AS fits FROM c),
f AS (SELECT *, coalesce(max(CASE WHEN fits THEN pos + size END) OVER (PARTITION BY source), 0) AS filled FROM e),
r AS (
  SELECT rid, source, pos, size, rest, last, last + size <= rest AS fits
  FROM (SELECT *, (filled + coalesce(sum(size) OVER (PARTITION BY source ORDER BY pos {_BEFORE}), 0))::BIGINT AS last FROM f WHERE NOT fits AND size > 0 AND size <= rest - filled)
  UNION ALL
  SELECT rid, source, pos, size, rest, last, last + size <= rest AS fits
  FROM (SELECT rid, source, pos, size, rest, (used + coalesce(sum(size) OVER (PARTITION BY source ORDER BY pos {_BEFORE}), 0))::BIGINT AS last
        FROM (SELECT *, max(CASE WHEN fits THEN last + size END) OVER (PARTITION BY source) AS used FROM r) WHERE NOT fits AND size <= rest - used)),
x AS (SELECT f.*, r.last, coalesce(sum(CASE WHEN r.rid IS NOT NULL THEN f.size END) OVER (PARTITION BY f.source), 0)::BIGINT AS more FROM f LEFT JOIN (SELECT rid, last FROM r WHERE fits) r ON f.rid = r.rid),
y AS (SELECT *, CASE WHEN size > 0 THEN times + CASE WHEN fits OR last IS NOT NULL THEN 1 ELSE 0 END ELSE 0 END AS n_times, greatest((times * source_size + filled + more)::DOUBLE, 1.0::DOUBLE) AS total FROM x),
z AS (SELECT rid, h, place, least((k * source_size + CASE WHEN fits OR k < times THEN pos ELSE last END + size / 2.0::DOUBLE) / total, 1.0::DOUBLE) AS u FROM (SELECT *, unnest(range(n_times)) AS k FROM y)),
t AS (SELECT rid, h, round(2 * u / ((1 - {_SLOPE}) + sqrt((1 - {_SLOPE}) * (1 - {_SLOPE}) + 4 * {_SLOPE} * u)), 9) AS position FROM z),
o AS (SELECT rid, position, row_number() OVER (ORDER BY position, h, rid) - 1 AS place FROM t),
p AS (SELECT rid, min(position) AS position, string_agg(place::VARCHAR, ',' ORDER BY place) AS places FROM o GROUP BY rid)
SELECT doc_id, size, source_size, target, size * n_times AS taken, position, coalesce(places, '') AS places FROM y LEFT JOIN p USING (rid)
"""
