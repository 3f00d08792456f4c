"""User history: last-n windows, weekly mixing and update checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_n(history: DataFrame, n: int = 50) -> DataFrame:
    """The n rows of each user appended last."""
    back = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("seq")))
    return history.withColumn("back", back).where(F.col("back") <= n).drop("back")


def week_start(as_of: str, exact: bool = False) -> Column:
    """Monday of the week of as_of at midnight; exact keeps the time of day."""
    t = F.lit(as_of).cast("timestamp_ntz")
    if exact:
        return t - F.make_dt_interval(F.weekday(t))
    return F.date_trunc("week", t).cast("timestamp_ntz")


def weekly_mix(history: DataFrame, as_of: str, n: int = 50, exact: bool = False) -> DataFrame:
    """Half of n from before this week and half from this week (all of the last n if
    there is nothing of this week), the latest row of each song, latest first."""
    kept = last_n(history, n).withColumn("new", F.col("ts") >= week_start(as_of, exact))
    user = W.partitionBy("user_id")
    kept = kept.withColumn("mixed", F.max("new").over(user))
    kept = kept.withColumn("back", F.row_number().over(W.partitionBy("user_id", "new").orderBy(F.desc("seq"))))
    kept = kept.where(~F.col("mixed") | (F.col("back") <= n // 2))
    latest = F.row_number().over(W.partitionBy("user_id", "song_id").orderBy(F.desc("seq")))
    kept = kept.withColumn("latest", latest).where("latest = 1")
    place = F.row_number().over(user.orderBy(F.desc("seq"))).cast("long")
    return kept.withColumn("place", place).where(F.col("place") <= n).select("user_id", "song_id", "weight", "seq", "place")


def update_due(last_update: Column, as_of: str) -> Column:
    """Whether models are to be refitted: never done, or it is Monday of a new week."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return last_update.isNull() | ((F.date_trunc("week", last_update) < F.date_trunc("week", now)) & (F.weekday(now) == 0))


def append(history: DataFrame, rows: DataFrame, n: int = 50) -> DataFrame:
    """History with rows (user_id, song_id, ts, weight, type) put behind it, cut to
    the last n of each user; weight 1 and type play where missing."""
    last = history.groupBy("user_id").agg(F.max("seq").alias("at"))
    new = rows.join(last, "user_id", "left").select(
        "user_id", "song_id", "ts", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("type", F.lit("play")).alias("type"),
        (F.coalesce("at", F.lit(0)) + F.row_number().over(W.partitionBy("user_id").orderBy("ts", "song_id"))).cast("long").alias("seq"),
    )
    return last_n(history.select(new.columns).unionByName(new), n)


def users(history: DataFrame) -> DataFrame:
    return history.groupBy("user_id").agg(F.count("*").alias("rows"))


def latest_items(ui: DataFrame, history: DataFrame, created: DataFrame, n: int = 50) -> DataFrame:
    """(user_id, song_id, place, source): each user's latest songs, from the history of
    those who have one, else by the songs' created_at where any of the user's has one,
    else in order of the songs. created: (song_id, created_at)."""
    user = W.partitionBy("user_id")
    told = last_n(history, n).select("user_id", "song_id", F.row_number().over(user.orderBy(F.desc("seq"))).alias("place"), F.lit("history").alias("source"))
    rest = ui.select("user_id", "song_id").distinct().join(told.select("user_id"), "user_id", "left_anti").join(created.select("song_id", "created_at"), "song_id", "left")
    dated = F.count("created_at").over(user) > 0
    rest = rest.withColumn("source", F.when(dated, "created").otherwise("order"))
    place = F.row_number().over(user.orderBy(F.desc_nulls_last("created_at"), "song_id"))
    rest = rest.withColumn("place", place).where(F.col("place") <= n).select("user_id", "song_id", "place", "source")
    return told.unionByName(rest)
