"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS = 500  # rows that are Python objects at a time


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.
    It is set here only where it is unset and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file:///tmp/checkpoints/cadenza"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables that the innermost temporary_tables() of this thread is to remove.
_TEMPORARY: ContextVar[list[str] | None] = ContextVar("temporary", default=None)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back. This cuts the lineage: a
    lost executor costs no more than the tasks that were running on it. keep: the
    table outlives temporary_tables(), as a result is still to be read from it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cadenza-{name}-{uuid.uuid4().hex[:12]}"
    if (own := _TEMPORARY.get()) is not None and not keep:
        own.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let go of shuffles, broadcasts and plans that nothing refers to any more: the driver
    keeps them until its memory is collected, which long chains of small jobs delay."""
    gc.collect()
    spark._jvm.System.gc()
    release()


def removed(df: DataFrame) -> None:
    """Remove the stored table that df reads."""
    _delete(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside, but for those kept, are removed at the end."""
    own: list[str] = []
    outer = _TEMPORARY.set(own)
    try:
        yield
    finally:
        _TEMPORARY.reset(outer)
        _delete(spark, own)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run inside hand texts to Python in batches of so many rows at most,
    which bounds what a task holds beside its state."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


HOT_KEYS = 1 << 12


BITS = 1 << 26  # at most, 8 MB


def likely_in(df: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """df without most of the rows whose key is none of the `total` keys (or fewer) of facts; no other row goes. All
    tasks are sent a bit for each hash of a key, in rows of 4 kB."""
    bits = min(BITS, max(1 << 15, 1 << (8 * total).bit_length()))
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    held = facts.select(at.alias("_at")).groupBy(F.expr("_at div 32768").alias("_row")).agg(F.bitmap_construct_agg(F.col("_at") % 32768).alias("_bits"))
    rows = df.withColumn("_at", at).withColumn("_row", F.expr("_at div 32768")).join(F.broadcast(held), "_row")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast((_at % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return rows.where(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1).select(*(F.col(f"`{c}`") for c in df.columns))


def join_counted(df: DataFrame, facts: DataFrame, key: str, count: str, total: int, rare: bool = False) -> DataFrame:
    """df joined with facts, which have one row for each key and in `count` how many of
    df's `total` rows (or more) hold it. Keys with more than total / HOT_KEYS rows, fewer than
    HOT_KEYS of them, are broadcast and their rows stay where they are, so no task
    gets all rows of a frequent key. rare: few of df's rows have a key of facts, so that most others are left
    out before any are dealt."""
    least = total // HOT_KEYS
    hot, cold = facts.where(F.col(count) > least), facts.where(F.col(count) <= least)
    frequent = df.join(F.broadcast(hot), key)
    rest = df.join(F.broadcast(hot.select(key)), key, "left_anti")
    rest = likely_in(rest, cold, key, total) if rare else rest
    return frequent.unionByName(rest.join(cold, key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_long(df: DataFrame, *names: str) -> DataFrame:
    """df with only these columns, the first as a long."""
    return df.select(F.col(f"`{names[0]}`").cast("long").alias(names[0]), *(F.col(f"`{n}`") for n in names[1:]))


def release() -> None:
    """Give memory that a task no longer uses back to the system: Python workers live
    on for later tasks, and what they hold is missing to the executor beside them."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[[list], list]]) -> DataFrame:
    """One output row for every input row, in Python, batch by batch. start() runs
    once in each task and gives a function from an input batch (a list of column
    lists) to an output batch (a list of column lists); its attribute close, if any, is
    called at the end of the task."""
    out = df.sparkSession.createDataFrame([], schema).schema
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, f = [x.type for x in to_arrow_schema(out)], None
        for b in batches:
            f = f or start()
            for i in range(0, b.num_rows, ROWS):
                cols = f([c.to_pylist() for c in b.slice(i, ROWS).columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        if close := getattr(f, "close", None):
            close()
        release()

    return df.mapInArrow(run, out)
