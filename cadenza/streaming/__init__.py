"""History as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .keyed import keep_last, last_rows, weekly_lists

__all__ = ["EVENT", "current", "keep_last", "last_rows", "maintain", "weekly_counts", "weekly_lists"]

EVENT = "user_id string, song_id string, ts timestamp_ntz, weight double, type string"


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The last-n history that a stream keeps, with seq from 1 in the order of its rows."""
    from pyspark.errors import PySparkException

    try:
        rows = last_rows(spark, folder)
    except PySparkException as e:
        if e.getCondition() not in ("STDS_COMMITTED_BATCH_UNAVAILABLE", "STDS_OFFSET_LOG_UNAVAILABLE"):
            raise
        return spark.createDataFrame([], EVENT + ", seq bigint")  # no batch yet
    user = W.partitionBy("user_id").orderBy("ts", *(c for c in rows.columns if c not in ("user_id", "ts")))
    return rows.withColumn("seq", F.row_number().over(user).cast("long"))


def maintain(events: DataFrame, folder: str, n: int = 50) -> StreamingQuery:
    """Keep the last n rows of each user from a stream of events; weight 1 and type play
    where missing. A batch touches only the users it has rows of."""
    return keep_last(events.withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "type": F.coalesce("type", F.lit("play"))}), folder, n)


def weekly_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by user and calendar week from Monday, with a watermark."""
    week = F.window("ts", "7 days", startTime="4 days")
    return events.withWatermark("ts", late).groupBy(week, "user_id").agg(F.count("*").alias("n"))
