"""Tables that a query writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. It is set here only where it is unset and all
    runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file:///tmp/checkpoints/cadenza"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/cadenza-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Have files of shuffles removed that no plan needs any more: Spark does so when the driver's memory is tidied up, which
    may be long after a disk is full."""
    gc.collect()
    spark._jvm.System.gc()


def in_turns(turns: int, make: Callable[[int], DataFrame], name: str) -> DataFrame:
    """Rows of make(0) to make(turns - 1). If there are several they are written one after the other, and what a turn
    shuffled is let go before the next, so that turns bound what lies on disk at a time."""
    if turns == 1:
        return make(0)
    done = []
    for turn in range(turns):
        done.append(stored(make(turn), name))
        let_go(done[0].sparkSession)
    return reduce(DataFrame.unionByName, done)


def _ranges(df: DataFrame, *order: str) -> DataFrame:
    """df in ranges of an order without ties, of which _p is the number."""
    return stored(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")


def sums_before(df: DataFrame, *order: str, **sums: Column) -> DataFrame:
    """df with the sums over all rows before each row in an order without ties. Sums of ranges of it (a
    row for each partition) are added up, so no sort lands in one task."""
    dealt = _ranges(df.withColumns({f"_{n}": c for n, c in sums.items()}), *order)
    kind = dict(dealt.dtypes)
    before = W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy("_p").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums))
    parts = parts.select("_p", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in sums))
    inside = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = {n: (F.col(f"_start_{n}") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0))).cast(kind[f"_{n}"] if not kind[f"_{n}"].startswith("int") else "long") for n in sums}
    return dealt.join(F.broadcast(parts), "_p").withColumns(out).drop("_p", *(f"_{n}" for n in sums), *(f"_start_{n}" for n in sums))


def placed(df: DataFrame, *order: str, out: str = "i") -> DataFrame:
    """df with each row's place from 0 in an order without ties."""
    return sums_before(df, *order, **{out: F.lit(1).cast("long")})


def following(df: DataFrame, *order: str, **values: Column) -> DataFrame:
    """df with the first value, if any, of the rows behind each row in an order without ties: nulls are skipped.
    What a range lacks comes from the first of later ranges."""
    dealt = _ranges(df.withColumns({f"_{n}": c for n, c in values.items()}), *order)
    parts = dealt.groupBy("_p").agg(*(F.min_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.struct(*order))).alias(f"_{n}") for n in values))
    # From the back: a frame up to the last row would be gone through anew for each row.
    later = W.partitionBy(F.lit(0)).orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_p", *(F.last(f"_{n}", ignorenulls=True).over(later).alias(f"_next_{n}") for n in values))
    inside = W.partitionBy("_p").orderBy(*(F.desc(c) for c in order)).rowsBetween(W.unboundedPreceding, -1)
    out = {n: F.coalesce(F.last(f"_{n}", ignorenulls=True).over(inside), F.col(f"_next_{n}")) for n in values}
    return dealt.join(F.broadcast(parts), "_p").withColumns(out).drop("_p", *(f"_{n}" for n in values), *(f"_next_{n}" for n in values))
