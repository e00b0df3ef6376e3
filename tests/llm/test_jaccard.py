import random

import numpy as np
import pytest

from tensorframe.llm import graph, jaccard

from .oracle import rows, sql_rows


def documents(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "日本"]
    passage = r.choices(vocabulary, k=40)
    base = [r.choices(vocabulary, k=r.randint(30, 160)) for _ in range(12)]
    data = []
    for b in base:
        for _ in range(r.randint(1, 8)):
            words = list(b)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            data.append(" ".join(words))
    data += [" ".join(passage + r.choices(vocabulary, k=r.randint(3, 25))) for _ in range(40)]
    data += ["a b", "a b", "a  b", "a b c", "", None, " \n", "", "same " * 300, "same " * 400, " ".join(r.choices(vocabulary, k=30_000))]
    r.shuffle(data)
    full = [(i * 3, t, "x", 1) for i, t in enumerate(data)] + [(3, data[1], "x", 1), (None, data[2], "x", 1), (None, "nobody's own text of six words", "x", 1)]
    return spark.createDataFrame(full, "doc_id long, text string, digest string, n int")


def test_equals_brute_force(spark):
    docs = documents(spark)
    want = sql_rows(jaccard.ORACLE_SQL, documents=docs)
    assert rows(jaccard.join(docs.repartition(5))) == want
    assert jaccard.join(docs.limit(0)).count() == 0


@pytest.mark.parametrize("settings", [{"BUCKET_BLOCK": 3, "TEXT_BLOCK": 4, "SPREAD": 1000, "BUCKET_ROWS": 4}, {"BUCKET_BLOCK": 2, "TEXT_BLOCK": 2, "SPREAD": 2, "BUCKET_ROWS": 5, "TEXT_ROWS": 4}, {"SPREAD": 1, "TEXT_SHINGLES": 100}])
def test_large_groups_in_small_blocks(spark, monkeypatch, settings):
    docs = documents(spark)
    for k, v in settings.items():
        monkeypatch.setattr(jaccard, k, v)
    assert rows(jaccard.join(docs)) == sql_rows(jaccard.ORACLE_SQL, documents=docs)


@pytest.mark.parametrize("tile", [2, 7, 512])
def test_links_by_tiles(monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    r = np.random.default_rng(tile)
    base = [r.choice(10**6, 60, replace=False) for _ in range(5)]
    sets = [np.unique(np.concatenate([base[k % 5][: 60 - r.integers(0, 5)], r.integers(0, 10**6, r.integers(0, 5))])).astype(np.uint64) for k in range(30)]
    copies = r.integers(1, 4, 30)
    for side in (np.zeros(30, int), r.integers(0, 2, 30)):
        two = bool(side.any())
        like = np.array([[i != j and (not two or side[i] != side[j]) and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
        links, label = jaccard.links_of(sets, side, copies, two)
        assert (links == like @ copies).all() and (label == jaccard.labels_of(30, *np.nonzero(like))).all()


def test_deduplicate_keeps_one_of_each_class(spark):
    docs = documents(spark).filter("doc_id is not null")
    kept = [r.doc_id for r in jaccard.deduplicate(docs).collect()]
    assert sorted(kept) == sorted({r.class_id for r in jaccard.join(docs).collect()})


def test_deduplicate_keeps_rows_without_ids_and_any_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    data = [(None, text), (None, text), (None, None), (4, text), (2, text + " end"), (2, text + " end"), (7, None), (8, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as class_id", "2 as rid", "3 as digest", "4 as _salt", "5 as `a.b`", "map(1, 2) as n")
    out = jaccard.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, ""), (0, text), (0, text), (2, text + " end"), (7, ""), (8, "")]
    assert jaccard.deduplicate(docs.limit(0)).count() == 0


def test_pruning_and_spanning():
    r = np.random.default_rng(3)
    least = jaccard.least_matches()
    assert all(least[n] < 0.8 * n for n in least) and least[128] > 64
    groups = r.integers(0, 2**31 - 1, (20, jaccard.VALUES), dtype=np.int32)
    values = groups[r.integers(0, 20, 300)].copy()
    change = r.random(values.shape) < 0.06
    values[change] = r.integers(0, 2**31 - 1, change.sum())
    for side in (np.zeros(300, int), r.integers(0, 2, 300)):
        i, j = np.triu_indices(300, 1)
        on = jaccard.survivors(values, i, j, least)
        on = on[(side[i[on]] != side[j[on]]) | (not side.any())]
        assert (jaccard.spanning(values, side, least) == jaccard.labels_of(300, i[on], j[on])).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (5, 5), (8, 8)]
    got = {(x.node, x.root) for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 100) for i in range(100, 161)} | {(5, 5), (9, 5), (7, 5)}


WORDS_OF = 5


def brute_classes(texts):
    """Classes of ids whose texts' shingles are 0.8 alike, by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + WORDS_OF]) for k in range(max(len(w) - WORDS_OF + 1, 1))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    classes = {}
    for i in texts:
        classes.setdefault(find(i), set()).add(i)
    return list(classes.values())


def test_shared_counts_by_ranges(monkeypatch):
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)) for n in (0, 5, 400, 900, 30, 7)]
    sets += [np.unique(np.concatenate([sets[3][::2], sets[2][:100]])), sets[3]]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    for n in (10**9, 100, 7):
        monkeypatch.setattr(jaccard, "RANGE", n)
        got = jaccard.shared_counts(sets)
        assert all(got[i][j] == want[i][j] for i in range(len(sets)) for j in range(len(sets)) if i != j)
