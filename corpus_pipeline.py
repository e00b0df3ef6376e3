"""From raw documents to a tokenised, mixed training set.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; between stages the documents are a Parquet table in the shared folder.

Defined cases, for each stage: a null text has no words, so the quality rules
reject it; a null source is a source of its own; null ids and languages pass
through, and rows without an id are never duplicates of one another; repeated
rows of one id and text become one in the Jaccard stage; an empty table gives an
empty one; other columns, whatever their names, pass through all stages but the
last, which gives ids and digests beside doc_id, lang and source.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorframe.llm import byte_bpe, jaccard, mixing, quality, secrets
from tensorframe.llm.common import discard, materialize, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that too many of a source's documents hold go from the others."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return jaccard.deduplicate(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no document goes."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken, in order of training position."""
    return mixing.train_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of texts, with digests of the ids and of the bytes they decode to."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    ids = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, decoded="raw")
    return ids.select(
        "doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL can't express byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage")
            discard(before)  # a stage's table goes when the next one's is written
            before = docs
    return docs
