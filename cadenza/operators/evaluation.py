"""Offline ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import r6


def ranking_metrics(recommended: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(user_id, k, precision, recall, ndcg, map) of each user with relevant songs.
    recommended: (user_id, song_id, rank); relevant: (user_id, song_id).

    Average precision is over the hits found. A user without results scores zero."""
    size = relevant.groupBy("user_id").agg(F.countDistinct("song_id").alias("size"))
    hits = recommended.join(relevant.select("user_id", "song_id").distinct(), ["user_id", "song_id"])
    so_far = F.row_number().over(W.partitionBy("user_id").orderBy("rank"))
    hits = hits.select("user_id", "rank", so_far.alias("hit"))
    cases = size.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    met = cases.join(hits, (cases.user_id == hits.user_id) & (hits.rank <= cases.k), "left").drop(hits.user_id)
    best = F.aggregate(F.sequence(F.lit(1), F.least("size", F.col("k").cast("long")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    n = F.count("rank")
    out = met.groupBy("user_id", "k", "size").agg(
        n.alias("n"), F.coalesce(F.sum(1 / F.log2(F.col("rank") + 1.0)), F.lit(0.0)).alias("dcg"), F.coalesce(F.avg(F.col("hit") / F.col("rank")), F.lit(0.0)).alias("ap")
    )
    return out.select("user_id", "k", r6(F.col("n") / F.col("k")).alias("precision"), r6(F.col("n") / F.col("size")).alias("recall"), r6(F.col("dcg") / best).alias("ndcg"), r6("ap").alias("map"))


def over_cases(metrics: DataFrame) -> DataFrame:
    """Mean and standard deviation of each metric over all cases, by k."""
    names = ["precision", "recall", "ndcg", "map"]
    return metrics.groupBy("k").agg(F.count("*").alias("cases"), *(r6(F.avg(c)).alias(f"{c}_mean") for c in names), *(r6(F.stddev_pop(c)).alias(f"{c}_std") for c in names))


def diversity(recommended: DataFrame, catalog: DataFrame, feature: str = "genre") -> DataFrame:
    """(user_id, diversity): distinct over all features of the songs; one song or none
    is 1."""
    value = F.explode("tags") if feature == "tags" else F.col(feature)
    found = recommended.join(catalog, "song_id").select("user_id", "song_id", value.alias("x"))
    ratio = F.countDistinct("x") / F.count("x")
    return found.groupBy("user_id").agg(F.when(F.countDistinct("song_id") <= 1, 1.0).otherwise(r6(ratio)).alias("diversity"))


def coverage(recommended: DataFrame, catalog: DataFrame) -> DataFrame:
    """The share of the catalog that is recommended to anyone."""
    found = recommended.agg(F.countDistinct("song_id").alias("found"))
    return found.join(F.broadcast(catalog.agg(F.countDistinct("song_id").alias("songs")))).select("found", "songs", r6(F.col("found") / F.col("songs")).alias("coverage"))
