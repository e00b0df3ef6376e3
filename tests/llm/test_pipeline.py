"""Each stage of the pipeline against brute force on its own input."""

import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tensorframe.llm import byte_bpe, jaccard, mixing, quality, secrets

from .test_jaccard import WORDS_OF, brute_classes


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(11)
    vocabulary = [f"word{i}" for i in range(500)] + ["é", "日本"]
    data = []
    for i in range(60):
        words = r.choices(vocabulary, k=r.randint(25, 120))
        text = " ".join(words[:12]) + "\n" + " ".join(words[12:])
        data.append((i, text, "en", r.choice(["a", "a", "b", None])))
        if i % 6 == 0:
            data.append((100 + i, text, "en", "b"))
            changed = text.split(" ")
            changed[20] = "other"
            data.append((200 + i, " ".join(changed), "en", "a"))
    data += [(300, "too short", "en", "a"), (301, None, "en", "a"), (302, "same words again and again here " * 20, "en", "b")]
    data += [(310 + i, " ".join(r.choices(vocabulary, k=40)) + f'\ntoken = "{r.getrandbits(160):040x}" end', "en", "a") for i in range(4)]
    data += [(400 + i, "A banner line of six words\n" + " ".join(r.choices(vocabulary, k=60)), None, "c") for i in range(30)]
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in data]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def outputs(spark, docs, tmp_path_factory):
    out, d = [docs], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('stages')}/{k}"
        stage(spark, d, "").write.parquet(path)
        d = spark.read.parquet(path)
        out.append(d)
    return out


def test_columns(docs, outputs):
    assert all(sorted(d.columns) == sorted(docs.columns) for d in outputs[:-1])


def test_quality(outputs):
    before = {r.doc_id: r for r in outputs[0].collect()}
    after = {r.doc_id: r for r in outputs[1].collect()}
    failed = set()
    for i, r in before.items():
        n, *_, repeated = quality.rules(r.text or "")
        if n < 20 or 100 * repeated > 30 * n:
            failed.add(i)
    assert set(after) == set(before) - failed and {300, 301, 302} <= failed
    for i, r in after.items():
        want = before[i].text.removeprefix("A banner line of six words\n") if i >= 400 else before[i].text
        assert r.text == want and r.n_chars == len(want)


def test_near_duplicates(outputs):
    before = {r.doc_id: r.text for r in outputs[1].collect()}
    classes = brute_classes(before)
    assert sorted(r.doc_id for r in outputs[2].collect()) == sorted({min(c) for c in classes})


def test_secrets(outputs):
    before = {r.doc_id: r.text for r in outputs[2].collect()}
    after = {r.doc_id: r.text for r in outputs[3].collect()}
    assert set(after) == set(before)
    for i, t in after.items():
        assert t == before[i] or (310 <= i < 320 and "[SECRET]" in t)
        assert not secrets.Scanner()(t) and not re.search("[0-9a-f]{32}", t)


def test_mixing(outputs):
    times = {r.doc_id: r.times for r in mixing.mix(outputs[3]).collect()}
    assert Counter(r.doc_id for r in outputs[4].collect()) == +Counter(times)


def test_tokens(outputs):
    ranks = byte_bpe.parse_ranks(byte_bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY)))
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, oracle.encode_ordinary(r.text or "")) for r in outputs[4].collect())
    assert sorted((r.doc_id, r.token_ids) for r in outputs[5].collect()) == want


def test_run_is_the_stages(spark, docs, outputs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens").collect()
    assert Counter(map(tuple, got)) == Counter(tuple(r) for r in outputs[5].select("doc_id", "n_tokens").collect())
    assert jaccard.THRESHOLD == 0.8 and WORDS_OF == 5


def odd(spark):
    """Nulls in any column, repeated rows, an empty and a long text, and columns named like what the stages use inside."""
    words = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    data = [(None, words(0), None, None, None), (None, words(0), None, None, 5), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, words(3), "en", "a", 1), (3, words(3), "en", "a", 1), (3, words(4), "en", "b", 1), (5, words(5, 20_000), "de", "a", 1)]
    docs = spark.createDataFrame([(*r, r[0], "z") for r in data], "doc_id long, text string, lang string, source string, n_chars long, _id long, tie string")
    names = ("rid", "h", "hash", "_salt", "key", "class_id", "spans", "place", "shard", "token_ids", "raw", "kept", "removed", "a.b")
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(names)})


def test_odd_rows_and_columns_pass_each_stage(spark, tmp_path):
    docs = odd(spark)
    columns, d = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, d.limit(0), "").count() == 0
        stage(spark, d, "").write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert d.columns == columns
            got = d.collect()
            assert all(r._id == r.doc_id and r.tie == "z" and r["a.b"] == 13 and r.shard == 8 for r in got)
            assert all(r.n_chars == len(r.text) for r in got)
            # Rejected without words; of the row that is there twice one stays from the second stage on.
            ids = Counter(r.doc_id for r in got)
            if k < 3:
                assert ids == Counter({None: 2, 3: 3 if k == 0 else 2, 5: 1})
            else:  # the long text is more than its source's target
                assert set(ids) == {None, 3}
    assert {"doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_sha256"} == set(d.columns) and d.count() > 3


def test_one_of_each_family_of_near_copies_is_left(spark, tmp_path):
    """Twenty near copies, ten lines each with one changed, among 320 documents of a host: quality rules keep them, and one stays."""
    r = random.Random(5)
    words = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    own = [words(20) for _ in range(10)]
    data = [(i, "\n".join(words(3) + " " + x[x.index(" ") + 1 :] if k == i % 10 else x for k, x in enumerate(own))) for i in range(20)]
    data += [(100 + i, "\n".join(words(15) for _ in range(4))) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "host", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    left = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:2]):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left.append({x.doc_id for x in docs.collect()})
    assert left[0] == {i for i, _ in data}
    assert sum(i < 20 for i in left[1]) == 1 and sum(i >= 100 for i in left[1]) == 300


def test_stage_tables_go(spark, docs, tmp_path):
    from pathlib import Path

    from tensorframe.scratch import shared_dir

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("tensorframe/stage-*"))
    before = stages()
    corpus_pipeline.run(spark, str(tmp_path)).count()
    assert len(stages() - before) == 1
