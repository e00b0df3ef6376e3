"""Filter interaction audit: what each filter removes in each order of the filters.

The orders of k filters are the paths of a trie, in which prefixes of the same
filters leave the same documents, whatever their order.  The trie is walked
depth first: the survivors of a prefix are a persisted frame, from which those
of each longer prefix are filtered; a prefix whose set of filters was met before
is not walked again (2^k states stand for all k! paths); a state's frame is
dropped when the walk leaves it, so at most k are kept at a time.  At each state
one aggregate counts the documents that each filter left removes: the edges of
the trie, which are written to a table.  The report of every order is read off
that table: kept and removed at a step from its edge, the other columns from
edges of the same filter.

Filters are given as columns that say whether a document fails.  They are
evaluated once, on the texts; what the trie is walked with is a row of
booleans for each document, in the shared folder, so a lost executor costs the
filtering of such rows.

Defined cases: a null text is an empty one, a null part is the empty string; a
filter that gives null doesn't fail; repeated rows and doc_ids count as often as
they stand; a row without a doc_id is no copy and has no label; several labels
of one doc_id are one, which holds if any of them does; a part keeps its rows
where nothing of it is left, with zeros; an empty table gives an empty report;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tensorframe.llm.common import WORD, materialize, spread_join, table
from tensorframe.scratch import scratch_path

#: Fixed values of the five filters of documents().
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
SYMBOLS = "[#$%&*|]"


def walk(rows: DataFrame, filters: Sequence[str], counted: Sequence[str] = ()) -> DataFrame:
    """(part, state, filter, met, removed, lost_<c> of each counted column): the edges of the trie.

    rows: part, a boolean column for each filter (failing) and for each counted
    column.  state is the set of filters before, bit k for filter k; met is the number of
    its survivors.  Edges at which a part has no document left have no row.
    """
    spark, path, met = rows.sparkSession, scratch_path(rows.sparkSession, "states"), set()
    names = [f"lost_{c}" for c in counted]
    sums = [F.count(F.lit(1)).alias("met"), *[F.count_if(f).alias(f"n{k}") for k, f in enumerate(filters)]]
    sums += [F.count_if(F.col(f) & F.col(c)).alias(f"n{k}_{c}") for k, f in enumerate(filters) for c in counted]

    def enter(state: int, survivors: DataFrame) -> None:
        met.add(state)
        left = [k for k in range(len(filters)) if not state >> k & 1]
        ahead = [k for k in left if state | 1 << k not in met and len(left) > 1]
        if ahead:
            survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        # One plan for all states, so that its code is compiled once: filters applied before remove nothing more.
        survivors.groupBy("part").agg(*sums).write.parquet(f"{path}/state={state}")
        for k in ahead:
            if state | 1 << k not in met:
                enter(state | 1 << k, survivors.filter(~F.col(filters[k])))
        if ahead:
            survivors.unpersist()

    enter(0, rows)
    states = spark.read.parquet(path)
    edge = lambda k: F.struct(F.lit(k).alias("filter"), F.col(f"n{k}").alias("removed"), *[F.col(f"n{k}_{c}").alias(n) for c, n in zip(counted, names, strict=True)])
    edges = states.select("part", F.col("state").cast("int").alias("state"), "met", F.inline(F.array(*[edge(k) for k in range(len(filters))])))
    return edges.filter(~F.getbit("state", "filter").cast("boolean"))


def audit(rows: DataFrame, filters: Sequence[str], counted: Sequence[str] = ()) -> DataFrame:
    """A row for each part, order of the filters and step.

    part, filter_order (names joined), step (from 1), kept, removed, redundant
    (failing the step's filter, but removed before), unique_fails (failing that
    filter only), lost_<c> (of those removed), shapley (what the filter removes,
    added up over all orders, wherever it stands).
    """
    spark, k = rows.sparkSession, len(filters)
    rows = materialize(rows.select(F.coalesce("part", F.lit("")).alias("part"), *[F.coalesce(c, F.lit(False)).alias(c) for c in (*filters, *counted)]), "facts")
    everything = (1 << k) - 1
    # Every edge of every part, with zeros where no document of the part came so far.
    all_edges = [[state, f] for state in range(everything) for f in range(k) if not state >> f & 1]
    grid = rows.select("part").distinct().select("part", F.explode(F.lit(all_edges)).alias("e")).select("part", F.col("e")[0].alias("state"), F.col("e")[1].alias("filter"))
    measures = ["met", "removed", *(f"lost_{c}" for c in counted)]
    edges = grid.join(walk(rows, filters, counted), ["part", "state", "filter"], "left").select("part", "state", "filter", *[F.coalesce(m, F.lit(0).cast("long")).alias(m) for m in measures])
    edges = materialize(edges, "edges")
    # Of the k! orders, |S|! (k - 1 - |S|)! have the filters S, in any order, before a filter.
    before = F.bit_count("state").cast("int")
    orders = F.element_at(F.lit([factorial(s) * factorial(k - 1 - s) for s in range(k)]), before + 1).cast("long")
    alone = F.col("state") == F.element_at(F.lit([everything - (1 << f) for f in range(k)]), F.col("filter") + 1)
    by_filter = edges.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"), F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * orders).alias("shapley")
    )
    # As many rows as the orders have steps: nothing of the tables.
    steps = []
    for order in permutations(range(k)):
        state = 0
        for at, f in enumerate(order):
            steps.append(("".join(filters[x] for x in order), at + 1, f, state))
            state |= 1 << f
    steps = spark.createDataFrame(steps, "filter_order string, step int, filter int, state int")
    out = edges.join(by_filter, ["part", "filter"]).join(F.broadcast(steps), ["state", "filter"])
    return out.select(
        "part", "filter_order", "step", (F.col("met") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *[f"lost_{c}" for c in counted], "shapley"
    )


def copies(rows: DataFrame, digest: str = "digest", doc_id: str = "doc_id") -> DataFrame:
    """rows with is_copy: whether a smaller doc_id has the same digest."""
    firsts = rows.groupBy(digest).agg(F.min(doc_id).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return spread_join(rows, firsts, digest, "left", by=[doc_id]).withColumn("is_copy", F.coalesce(F.col(doc_id) > F.col("_first"), F.lit(False))).drop("_first")


def documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, whether a document fails each of A to E, and its labels.

    A: few words; B: few distinct words; C: many capitals; D: a symbol; E: a
    copy of a document with a smaller id.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), ""))
    n, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    rows = rows.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (n < LEAST_WORDS).alias("A"), (distinct * 100 < n * LEAST_DISTINCT).alias("B"),
        (capitals * 100 > F.length("text").cast("long") * MOST_CAPITALS).alias("C"), F.col("text").rlike(SYMBOLS).alias("D"),
    )
    rows = copies(materialize(rows, "texts")).withColumnRenamed("is_copy", "E")
    labels = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.join(labels, "doc_id", "left").select("part", *"ABCDE", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(rows, "ABCDE", ["good", "toxic"]).withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


def oracle_sql() -> str:
    steps = [("".join(order), at + 1, 1 << "ABCDE".index(f), sum(1 << "ABCDE".index(x) for x in order[:at])) for order in permutations("ABCDE") for at, f in enumerate(order)]
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
e AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS is_copy FROM d),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (len(w) < {LEAST_WORDS})::INTEGER + 2 * (100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w))::INTEGER
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {MOST_CAPITALS} * length(t))::INTEGER + 8 * regexp_matches(t, '{SYMBOLS}')::INTEGER + 16 * is_copy::INTEGER AS m,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM e LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, m),
o AS (SELECT * FROM (VALUES {", ".join(map(str, steps))}) v(filter_order, step, bit, before)),
r AS (SELECT part, filter_order, step, bit, sum(n * (m & (before | bit) = 0)::INTEGER)::BIGINT AS kept, sum(n * (m & before = 0 AND m & bit <> 0)::INTEGER)::BIGINT AS removed,
    sum(n * (m & before <> 0 AND m & bit <> 0)::INTEGER)::BIGINT AS redundant, sum(n * (m = bit)::INTEGER)::BIGINT AS unique_fails,
    sum(good * (m & before = 0 AND m & bit <> 0)::INTEGER)::BIGINT AS good_lost, sum(toxic * (m & before = 0 AND m & bit <> 0)::INTEGER)::BIGINT AS toxic_lost
  FROM c, o GROUP BY part, filter_order, step, bit)
SELECT r.* EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
