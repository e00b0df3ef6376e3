import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tensorframe.llm import byte_bpe

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.parse_ranks(RANKS), special_tokens={})


def texts():
    r = random.Random(7)
    alphabet = ["a", "é", "the", " ", "  ", "\n", "\t", "12", "'s", "'", "!", "…", "\x85", "\x1c", " ", "日本", "🙂", "́"]
    odd = ["".join(r.choices(alphabet, k=r.randint(0, 300))) for _ in range(60)]
    return [None, "", " ", "ab" * 400, " " * 700, "\n\n x", "word " * 200, "日本語" * 300, *odd, odd[0], odd[0]]


def encoded(spark, rows, **settings):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, ids string")
    return {r.doc_id: r.token_ids for r in byte_bpe.encode(docs, RANKS, PATTERN, **settings).collect()}


@pytest.mark.parametrize("size,overlap", [(32_768, 256), (40, 8), (16, 16), (7, 3), (100, 40)])
def test_equals_the_library(spark, oracle, size, overlap):
    rows = texts()
    got = encoded(spark, rows, chunk_chars=size, overlap=overlap)
    assert got == {i: oracle.encode_ordinary(t or "") for i, t in enumerate(rows)}


def test_merge_of_long_pieces(oracle):
    r = random.Random(1)
    ranks = byte_bpe.parse_ranks(RANKS)
    for _ in range(100):
        piece = "".join(r.choices("abeht é", k=r.randint(1, 400)))
        assert byte_bpe.merge(piece.encode(), ranks) == oracle._encode_single_piece(piece)


def test_round_trip_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (None, None)], "doc_id long, text string")
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS)
    assert sorted((r.doc_id or 0, bytes(r.bytes)) for r in back.collect()) == [(0, b""), (1, b"same"), (1, b"same")]
    assert byte_bpe.digests(docs.limit(0), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("size,overlap", [(32_768, 256), (40, 8), (7, 3)])
def test_bytes_of_the_ids_are_the_texts(spark, size, overlap):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], "doc_id long, text string, raw string, rid int")
    got = byte_bpe.encode(docs, RANKS, PATTERN, decoded="raw", chunk_chars=size, overlap=overlap)
    assert got.columns == ["doc_id", "rid", "token_ids", "raw"]
    assert {r.doc_id: bytes(r.raw).decode() for r in got.collect()} == {i: t or "" for i, t in enumerate(rows)}


def test_a_full_cache_changes_nothing(oracle, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 600)
    ids = byte_bpe._Pieces(RANKS, PATTERN)
    for _ in range(2):
        for piece in ("word", " other", "é" * 9, "ab" * 400, "x"):
            assert list(np.frombuffer(ids[piece], np.int32)) == oracle._encode_single_piece(piece)
            assert len(ids) <= 2
