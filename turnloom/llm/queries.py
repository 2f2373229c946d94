"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import bpe, decontaminate, filter_audit, language_id, license_scan, oracles, periodic_runs, quality, secret_scan, sharding, simhash, substring_dedup, token_count, warc

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BPE_RANKS, ["doc_id"], ids=False)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, digest of the canonical text, license_id of a whole licence text, notices found as lines."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), COUNT_TOKENIZER)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_candidates, n_secrets and findings (start, end, kind, probability) of every document."""
    return secret_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_words, n_repeated, partners and spans of every document."""
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and spans: the original characters of hit runs as start-end, comma-joined."""
    d = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.withColumn("spans", F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x.start, x.end)), ","))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def tail_repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the contract of op11 has them: in a tenth of the documents a tail repeats."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"), edit=tail_repeated)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 24).drop("place")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_license_scans": op2_license_scans,
    "op3_token_counts": op3_token_counts,
    "op4_secret_scans": op4_secret_scans,
    "op5_language_id": op5_language_id,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_filter_audit": op12_filter_audit,
    "op13_sharding": op13_sharding,
}

ORACLE: dict[str, str] = oracles.ORACLE
