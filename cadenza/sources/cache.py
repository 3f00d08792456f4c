"""Results kept by what they were made from.

The fingerprint of a table does not depend on the order of rows: for each bucket of it, the number of
rows and the sum and exclusive or of two parts of their digests. Names and types of columns and the
parameters of the computation belong to it. cached() keeps a whole result; cached_rows() keeps the results of a
computation that works row by row, and makes only those of buckets that have changed.

Equal rows count each; a null differs from an empty text; an empty table has a fingerprint of its own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def _digest(df: DataFrame) -> Column:
    return F.md5(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}).cast("binary"))


def _bucket(keys: list[str] | None, buckets: int, digest: str = "_d") -> Column:
    """By the keys, so that a changed row stays in its bucket; without keys by the row's digest."""
    return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(buckets)) if keys else F.conv(F.substring(digest, 31, 2), 16, 10).cast("long") % buckets


def fingerprints(df: DataFrame, keys: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, rows, total, parity): at most `buckets` rows."""
    part = lambda at: F.conv(F.substring("_d", at, 15), 16, 10).cast("long")
    rows = df.withColumn("_d", _digest(df)).withColumn("_b", _bucket(keys, buckets))
    return rows.groupBy(F.col("_b").cast("long").alias("bucket")).agg(F.count("*").alias("rows"), F.sum(part(1).cast("decimal(38,0)")).alias("total"), F.bit_xor(part(16)).alias("parity"))


def _named(*parts: object) -> str:
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:32]


def _shape(df: DataFrame) -> str:
    return ",".join(f"{n} {t}" for n, t in sorted(df.dtypes))


def fingerprint(df: DataFrame, *parameters: object, buckets: int = BUCKETS) -> str:
    """One for the whole table and the parameters."""
    rows = sorted(tuple(r) for r in fingerprints(df, None, buckets).collect())  # `buckets` at most
    return _named(_shape(df), *parameters, *rows)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}:
            raise
        return None


def cached(df: DataFrame, folder: str, compute: Callable[[DataFrame], DataFrame], *parameters: object) -> DataFrame:
    """compute(df), which is made only if the folder has no result of the same rows and parameters."""
    path = f"{folder}/{fingerprint(df, *parameters)}"
    done = _read(df.sparkSession, f"{path}/done")  # written last, so a result that was cut short does not count
    if done is None:
        run = uuid.uuid4().hex[:12]
        compute(df).write.parquet(f"{path}/{run}")
        df.sparkSession.createDataFrame([(run,)], "run string").write.mode("append").parquet(f"{path}/done")
        done = df.sparkSession.read.parquet(f"{path}/done")
    return df.sparkSession.read.parquet(f"{path}/{done.agg(F.min('run')).first()[0]}")


def cached_rows(df: DataFrame, folder: str, keys: list[str], compute: Callable[[DataFrame], DataFrame], *parameters: object, buckets: int = BUCKETS) -> DataFrame:
    """compute(df) for a computation that works row by row and keeps `keys`: only rows of buckets
    that are not in the folder are computed, and they are kept for later tables."""
    spark = df.sparkSession
    wanted = {_named(_shape(df), buckets, ",".join(keys), *parameters, *r): r.bucket for r in fingerprints(df, keys, buckets).collect()}
    done = _read(spark, f"{folder}/done")
    runs = {} if done is None else {r["print"]: r.run for r in done.groupBy("print").agg(F.min("run").alias("run")).where(F.col("print").isin(list(wanted))).collect()}
    new = {p: b for p, b in wanted.items() if p not in runs}
    if new or not wanted:
        run = uuid.uuid4().hex[:12]
        rows = compute(df.where(_bucket(keys, buckets).isin(list(new.values()))))
        rows.withColumns({"_run": F.lit(run), "_bucket": _bucket(keys, buckets)}).write.mode("append").partitionBy("_run", "_bucket").parquet(f"{folder}/rows")
        if new:
            spark.createDataFrame([(p, run) for p in new], "print string, run string").write.mode("append").parquet(f"{folder}/done")
        runs |= dict.fromkeys(new, run)
    kept = _read(spark, f"{folder}/rows")
    if kept is None:
        return compute(df)
    listed = spark.createDataFrame([(runs[p], b) for p, b in wanted.items()], "_run string, _bucket long")
    return kept.join(F.broadcast(listed), ["_run", "_bucket"]).drop("_run", "_bucket")
