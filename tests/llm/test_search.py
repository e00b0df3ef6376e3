import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tensorframe.llm import search

from .oracle import rows as rows_of
from .oracle import sql_rows

FIELDS = "doc_id long, text string, n long, terms string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """Every document for every item, by the formula."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        found = []
        for i, b in bags:
            m = 50 + (50 * b.total() * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m)) for t in own if b[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def corpus(seed=1, n=400):
    r = random.Random(seed)
    words = ["The", "the", "of", "éa", "ÉA", "日本", "x_y", "don't", "42", "a\x00b", "K"] + [f"w{i}" for i in range(60)]
    docs = [(r.choice([None, i, i, i, i * 3000, -i, 7]), " ".join(r.choices(words, k=r.choice([0, 1, 5, 30, 200])))) for i in range(n)]
    docs += [(i, "the same text w1 w2") for i in range(1000, 1080)] + [(5000, None), (5001, " .,; "), (5002, "w3 " * 20000)]
    items = [(i, " ".join(r.choices(words, k=r.choice([1, 3, 12])))) for i in range(25)] + [(100, None), (101, "nowhere"), (3, "w1 w2"), (None, "w5"), (102, "The of " + "w1 " * 50)]
    return docs, items


@pytest.mark.parametrize("k,window,block", [(50, 8192, 200_000), (7, 16, 20)])
def test_equals_brute_force(spark, k, window, block):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("window", F.lit(1)).repartition(7)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit("x"))
    got = search.search(d, q, k, window, block_terms=block)
    assert got.columns == ["query", "rank", "doc_id", "score"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == brute(docs, items, k)


def test_equals_sql(spark):
    docs, items = corpus(2, 150)
    docs = [(i, t) for i, t in docs if i is not None and "\x00" not in (t or "")]  # repeated ids have equal rows
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = search.search(d, q).withColumnRenamed("query", "item_id")
    assert rows_of(got) == sql_rows(search.ORACLE_SQL, documents=d, benchmark=q)


def test_bags_in_pieces(monkeypatch):
    text = "Ab,é日 z__q x\x0041 " * 50
    whole = search.bag(text.encode())
    assert {t.decode(): n for t, n in whole.items()} == Counter(terms(text))
    monkeypatch.setattr(search, "PIECE", 7)
    assert search.bag(text.encode()) == whole and search.bag(b"one-word-" * 9).total() == 18


def test_empty_tables(spark):
    docs, items = corpus(3, 20)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert search.search(d.limit(0), q).count() == 0 and search.search(d, q.limit(0)).count() == 0
    assert search.search(d.filter("text IS NULL"), q).count() == 0
