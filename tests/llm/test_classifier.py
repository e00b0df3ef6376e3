import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorframe.llm import classifier as C

WORDS = ["lorem", "ipsum", "dolor", "sit", "amet", "é", "Zwei", "drei", "vier"]


def text(r, good):
    n = r.choice([5, 30, 200])
    words = [r.choice(WORDS) + r.choice(WORDS) for _ in range(n)]
    if good:
        return " ".join(words) + "."
    kind = r.randrange(3)
    return " ".join(w.upper() + "!!" for w in words) if kind == 0 else " ".join(w + "$$%" for w in words) if kind == 1 else " ".join([words[0]] * n)


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(2)
    rows = [(i, text(r, i % 5 > 0), "en", i % 5 > 0) for i in range(1500)]
    docs = spark.createDataFrame([x[:3] for x in rows] + [(None, None, None), (3, "", "x"), (3, rows[3][1], "x")], "doc_id long, text string, lang string").withColumn("x", F.lit("clash")).withColumn("score", F.lit(9)).withColumn("label", F.lit(3)).repartition(5)
    labels = [(i, int(good), 0) for i, *_, good in rows if i % 3] + [(3, None, 0), (None, 1, 0), (4, 1, 1), (99_999, 0, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(3), {x[0]: x for x in rows}


def test_held_out_rows(spark, corpus):
    docs, labels, rows = corpus
    got = C.classify(docs, labels, trees=8).collect()
    assert len(got) == 1503 and all(0 < x.score < 1 and x.predicted == (x.score >= 0.7) for x in got)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    own = [x for x in got if x.doc_id is not None and x.doc_id != 3]
    assert sum(x.predicted == rows[x.doc_id][3] for x in own if x.held_out) >= 0.97 * sum(x.held_out for x in own)


def test_labels_of_held_out_rows_change_nothing(spark, corpus):
    docs, labels, _ = corpus
    other = labels.withColumn("quality", F.when(C.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: sorted((r.doc_id or -1, r.score) for r in C.classify(docs, x, trees=2).collect())
    assert score(labels) == score(other.repartition(2))  # and rows dealt out otherwise give the same trees


def grown(x, y, trees, depth, bins, rate):
    """Boosting a row at a time over plain lists, as a check."""
    edges = [[float(q) for q in col] for col in bins]
    base = math.log((sum(y) + 1) / (len(y) - sum(y) + 1))
    margin = [base] * len(y)
    for _ in range(trees):
        def split(rows, level):
            g = {i: 1 / (1 + math.exp(-margin[i])) - y[i] for i in rows}
            h = {i: (1 / (1 + math.exp(-margin[i]))) * (1 - 1 / (1 + math.exp(-margin[i]))) for i in rows}
            part = lambda rs: sum(g[i] for i in rs) ** 2 / (sum(h[i] for i in rs) + 1.0)
            if level == depth:
                return [(rows, -rate * sum(g.values()) / (sum(h.values()) + 1.0))]
            best = (1e-3, None, None)
            for k, cuts in enumerate(edges):
                for c in cuts:
                    left, right = [i for i in rows if x[i][k] <= c], [i for i in rows if x[i][k] > c]
                    gain = part(left) + part(right) - part(rows)
                    if gain > best[0] + 1e-7:
                        best = (gain, left, right)
            if best[1] is None:
                return split(rows, level + 1)
            return split(best[1], level + 1) + split(best[2], level + 1)

        for rows, value in split(list(range(len(y))), 0):
            for i in rows:
                margin[i] += value
    return [1 / (1 + math.exp(-m)) for m in margin]


def test_trees_equal_plain_boosting(spark):
    r = random.Random(4)
    x = [[float(r.randrange(12)), r.random(), 7.0] for _ in range(120)]
    y = [float(a > 5 or b > 0.8) if r.random() < 0.9 else 0.0 for a, b, _ in x]
    rows = spark.createDataFrame(list(zip(x, y, strict=True)), "x array<double>, label double").repartition(4)
    model = C.fit(rows, trees=3, depth=3, bins=8)
    found = rows.agg(*[F.percentile_approx(F.col("x")[k], [j / 8 for j in range(1, 8)], 10_000) for k in range(3)]).first()
    want = grown(x, y, 3, 3, found, C.RATE)
    assert np.allclose(model.scores(np.array(x)), want, atol=1e-4)


def test_flat_arrays_equal_descent(spark):
    r = np.random.default_rng(1)
    model = C.Trees(3, 0.25, r.integers(0, 4, (5, 7)).astype(np.int32), r.normal(size=(5, 7)), r.normal(size=(5, 8)))
    x = r.normal(size=(50, 4))

    def descend(row, tree):
        at = 0
        while at < 7:
            at = 2 * at + 1 + (row[model.statistic[tree, at]] > model.threshold[tree, at])
        return model.value[tree, at - 7]

    assert np.allclose(model.margin(x), [0.25 + sum(descend(row, t) for t in range(5)) for row in x])


def test_odd_tables(spark, corpus):
    docs, labels, _ = corpus
    assert C.classify(docs.limit(0), labels, trees=1).count() == 0
    assert {x.score for x in C.classify(docs.limit(20), labels.limit(0), trees=1).collect()} == {0.5}
    one = C.classify(docs, labels.filter("quality = 1"), trees=2).collect()
    assert all(x.score > 0.9 for x in one)
    assert C.statistics(b"") == [0.0] * len(C.FEATURES) and all(map(math.isfinite, C.statistics(b"\xc3\xa9 \n\n")))
    few = C.training_rows(C.described(docs), labels, sample=100).count()
    assert 60 < few < 150
