"""The pipeline that makes training data out of documents: what the quality
classifier rejects goes, one document of each group of near-duplicates stays,
documents that hold benchmark items go, secrets are blotted out of the texts, and
what is left is encoded.

Special inputs, stage by stage. quality: null and empty texts and those without words go,
equal rows fare alike, without annotations the heuristics decide. near_duplicates: of equal
rows and of near copies the one with the least doc_id stays, one without a doc_id only
where none has one. decontaminate: without benchmark items all stay. secrets: n_chars is
counted anew where it was given. encode: a row for each document, other columns are not
read. Other columns are carried through all stages but the last; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.bpe import encode_documents
from cadenza.llm.common import removed, shared_dir, table
from cadenza.llm.decontaminate import drop_contaminated
from cadenza.llm.minhash_dedup import drop_near_duplicates
from cadenza.llm.quality import classify
from cadenza.llm.queries import vocabulary_path
from cadenza.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classify(docs, table(spark, sf_dir, "labels"), only_kept=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = redact_secrets(docs)
    return docs.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast("long")) if "n_chars" in docs.columns else docs


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, vocabulary_path(), full=True).drop("decoded")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("encode", encode)]

# No SQL: the classifier is trained and the encoder follows merge ranks. The stages
# are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; each result is written to the shared folder and
    removed when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex[:12]}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            removed(before)
        docs = before = spark.read.parquet(path)
    return docs
