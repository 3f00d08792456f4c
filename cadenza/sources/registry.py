"""Versions of the tables that requests are served from.

A version is a folder of tables, each dealt to buckets by a hash of its key and sorted by the key in each
bucket. Buckets are partitions whose column name says how many there are, so a request for a key
that is known when it is planned reads one bucket, and in that only row groups that may hold it.

What is current is a row in a table of versions. It is appended, as one file, when all tables of the
version are there; until then readers see the version before, and a version that was not finished is never seen.
Going back to an older version appends one more row. Two writers at once get rows of the same
number; the folder's name decides between them, alike for all readers."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_NAME = re.compile(r"bucket_of_(\d+)$")


def bucketed(df: DataFrame, key: str, path: str, buckets: int = BUCKETS) -> None:
    """df written in buckets of key. Rows of a key that is null have bucket 0 and are found by no
    request. A bucket of many rows is one task's, so buckets grow with the table (a parameter)."""
    name = f"bucket_of_{buckets}"
    dealt = df.withColumn(name, F.coalesce(F.pmod(F.xxhash64(key), F.lit(buckets)), F.lit(0)).cast("int"))
    dealt.repartition(buckets, name).sortWithinPartitions(name, key).write.partitionBy(name).mode("overwrite").parquet(path)


def rows_of(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """The rows of df whose key is one of ids (a request's, so few). If df is read from buckets of this key,
    only those of the ids are read. Other tables are filtered."""
    if not ids:
        return df.where(F.lit(False))
    kind = df.schema[key].dataType
    wanted = [F.lit(i).cast(kind) for i in ids]
    either = lambda conditions: reduce(Column.__or__, conditions)
    for name in df.columns:
        if found := _NAME.match(name):
            df = df.where(either([F.col(name) == F.pmod(F.xxhash64(i), F.lit(int(found[1]))).cast("int") for i in wanted])).drop(name)
    return df.where(F.col(key).isin(list(ids)) if len(ids) > 1 else F.col(key) == wanted[0])


def publish(spark: SparkSession, folder: str, tables: dict[str, tuple[DataFrame, str]], facts: dict | None = None, buckets: int = BUCKETS) -> int:
    """Write tables (name: (DataFrame, key)) as a new version and make it the current one. facts: what
    else readers need (weights of channels, say), as JSON. Gives the version's number."""
    own = f"{folder}/tables-{uuid.uuid4().hex[:12]}"
    for name, (df, key) in tables.items():
        bucketed(df, key, f"{own}/{name}", buckets)
    number = max((v["version"] for v in versions(spark, folder)), default=0) + 1
    _point(spark, folder, number, own.rsplit("/", 1)[1], {n: k for n, (_, k) in tables.items()}, facts or {})
    return number


def _point(spark: SparkSession, folder: str, number: int, own: str, keys: dict, facts: dict) -> None:
    row = [(number, own, json.dumps(keys), json.dumps(facts))]
    spark.createDataFrame(row, "version long, tables string, keys string, facts string").coalesce(1).write.mode("append").parquet(f"{folder}/versions")


def versions(spark: SparkSession, folder: str) -> list[dict]:
    """All versions ever made current, the oldest first (a row for each refresh)."""
    try:
        rows = spark.read.parquet(f"{folder}/versions").orderBy("version", "tables").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [r.asDict() | {"keys": json.loads(r["keys"]), "facts": json.loads(r["facts"])} for r in rows]


def back_to(spark: SparkSession, folder: str, number: int) -> int:
    """Make the tables of an older version current again, as a new version."""
    known = versions(spark, folder)
    old = [v for v in known if v["version"] == number]
    if not old:
        raise ValueError(f"no version {number} in {folder}")
    _point(spark, folder, known[-1]["version"] + 1, old[-1]["tables"], old[-1]["keys"], old[-1]["facts"])
    return known[-1]["version"] + 1


def current(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """(tables, facts) of the current version."""
    known = versions(spark, folder)
    if not known:
        raise ValueError(f"no version in {folder}")
    last = known[-1]
    return {n: spark.read.parquet(f"{folder}/{last['tables']}/{n}") for n in last["keys"]}, last["facts"]
