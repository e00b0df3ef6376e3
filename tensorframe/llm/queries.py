"""The operators over their whole tables, as the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tensorframe.llm import byte_bpe, chat, classifier, filters, fingerprints, jaccard, licenses, mixing, private, quality, search, secrets, warc
from tensorframe.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digests(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.digests(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digests(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.report(spark, sf_dir)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.report(spark, sf_dir)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.report(spark, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_jaccard_join, op2_fingerprints, op3_secret_scans, op4_license_scans, op5_mixing, op6_personal_data, op7_byte_bpe, op8_chat, op9_quality_rules, op10_warc, op11_filter_audit, op12_lexical_search, op13_quality_classifier, pipeline)}
ORACLES: dict[str, str] = {
    "op1_jaccard_join": jaccard.ORACLE_SQL,
    "op2_fingerprints": fingerprints.ORACLE_SQL,
    "op3_secret_scans": secrets.oracle_sql(),
    "op4_license_scans": licenses.oracle_sql(),
    "op5_mixing": mixing.ORACLE_SQL,
    "op8_chat": chat.ORACLE_SQL,
    "op9_quality_rules": quality.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
    "op11_filter_audit": filters.oracle_sql(),
    "op12_lexical_search": search.ORACLE_SQL,
}
