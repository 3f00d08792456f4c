"""The operators of this package over their whole tables, as registered queries."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_documents
from .chat_format import format_chats
from .common import table
from .decontaminate import contaminated
from .embedding_dedup import near_duplicate_vectors
from .hmm_lm import score_documents
from .lexical_search import ranked_search
from .license_scan import scan_licenses
from .minhash_dedup import near_duplicates
from .mixing import plan
from .oracles import ORACLES
from .periodic_runs import digests, periodic_runs, with_repeats
from .quality import classify
from .secret_scan import scan_secrets
from .sharding import shard


def vocabulary_path() -> str:
    """The public vocabulary; CADENZA_VOCABULARY names another file."""
    if found := os.environ.get("CADENZA_VOCABULARY"):
        return found
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents")).drop("source", "text_md5")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_repeats(table(spark, sf_dir, "documents"))))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_lm_score, op3_secret_scan, op4_quality, op5_near_dedup, op6_decontaminate, op7_sharding, op8_bpe, op9_embedding_dedup, op10_chat_format, op11_mixing, op12_periodic_runs, op13_lexical_search)}
ORACLE_SQL: dict[str, str] = ORACLES
