import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from tensorframe.llm import filters

from .oracle import rows as rows_of
from .oracle import sql_rows


def report(spark, docs, labels):
    return filters.audit(filters.documents(docs, labels), "ABCDE", ["good", "toxic"]).withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


def some_documents(spark):
    r = random.Random(5)
    texts = [None, "", " \n ", "x" * 5000, "$ " * 300]
    texts += [" ".join(r.choice(["aa", "b", "CAPS", "#", "d\x0be", "é"] + [f"w{k}" for k in range(r.choice([3, 400]))]) for _ in range(r.choice([20, 199, 200, 400]))) for _ in range(60)]
    rows = [(None if i % 23 == 5 else i // 2 if i % 17 == 3 else i, t, r.choice(["a", "", None, "c"]), i) for i, t in enumerate(texts + texts[:40] + texts[3:4] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, words int").withColumn("part", F.lit(1)).withColumn("A", F.lit("x")).withColumn("digest", F.lit(2))
    labels = spark.createDataFrame([(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(60)] + [(3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs.repartition(5), labels


def test_report_equals_sql(spark):
    docs, labels = some_documents(spark)
    got = rows_of(report(spark, docs, labels))
    assert len(got) == 3 * 600 and got == sql_rows(filters.oracle_sql(), documents=docs, labels=labels)


def test_report_equals_filtering_in_every_order(spark):
    """Document after document, filter after filter, without any state shared."""
    docs, labels = some_documents(spark)
    good = {x.doc_id for x in labels.collect() if x.quality == 1} - {None}
    rows = [(x.doc_id, x.source or "", x.text or "") for x in docs.collect()]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    fails = {
        "A": lambda d, p, t: len(words(t)) < 200, "B": lambda d, p, t: 100 * len(set(words(t))) < 50 * len(words(t)),
        "C": lambda d, p, t: 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": lambda d, p, t: bool(re.search(r"[#$%&*|]", t)),
        "E": lambda d, p, t: d is not None and any(t == u and e is not None and e < d for e, _, u in rows),
    }
    failing = {f: {i for i, x in enumerate(rows) if test(*x)} for f, test in fails.items()}
    want = {}
    for order in permutations("ABCDE"):
        for part in {p for _, p, _ in rows}:
            left = {i for i, x in enumerate(rows) if x[1] == part}
            own = set(left)
            for step, f in enumerate(order):
                gone = left & failing[f]
                only = {i for i in own & failing[f] if not any(i in failing[g] for g in "ABCDE" if g != f)}
                want[part, "".join(order), step + 1] = (len(left - gone), len(gone), len((own - left) & failing[f]), len(only), sum(rows[i][0] in good for i in gone))
                left -= gone
    got = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost) for x in report(spark, docs, labels).collect()}
    assert got == want


def test_states_are_shared(spark, monkeypatch):
    """Three filters: seven states with edges, not the 15 inner nodes that the trie of six orders has."""
    rows = spark.range(40).select(F.lit("p").alias("part"), (F.col("id") % 2 == 0).alias("a"), (F.col("id") % 3 == 0).alias("b"), (F.col("id") % 5 == 0).alias("c"))
    edges = filters.walk(rows, ["a", "b", "c"]).collect()
    assert sorted({e.state for e in edges}) == list(range(7)) and len(edges) == 12 == len({(e.state, e["filter"]) for e in edges})
    assert {(e.state, e["filter"]): e.removed for e in edges}[3, 2] == sum(i % 5 == 0 and i % 2 and i % 3 != 0 for i in range(40))
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_no_documents(spark):
    docs, labels = some_documents(spark)
    assert report(spark, docs.limit(0), labels).count() == 0
    assert report(spark, docs, labels.limit(0)).filter("good_lost > 0 OR toxic_lost > 0").count() == 0
