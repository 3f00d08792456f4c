"""How interactions are distributed over users and songs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import r6

PERCENTILES = (10, 25, 50, 75, 90, 95, 99)


def counts(ui: DataFrame, of: str) -> DataFrame:
    return ui.where("weight > 0").groupBy(of).agg(F.count("*").alias("n"))


def item_counts(ui: DataFrame, catalog: DataFrame) -> DataFrame:
    """Users of each song of the catalog, zero included."""
    return catalog.select("song_id").join(counts(ui, "song_id"), "song_id", "left").select("song_id", F.coalesce("n", F.lit(0)).alias("n"))


def distribution(n: DataFrame) -> DataFrame:
    """One row of statistics of the counts n; percentiles are linear."""
    return n.agg(
        F.count("*").alias("size"), F.min("n").alias("lowest"), F.max("n").alias("highest"), r6(F.avg("n")).alias("mean"), r6(F.median("n")).alias("median"), r6(F.stddev_pop("n")).alias("std"),
        *(r6(F.percentile("n", p / 100)).alias(f"p{p}") for p in PERCENTILES),
    )


def buckets(users: DataFrame, items: DataFrame) -> DataFrame:
    """Counts of songs by users (0, 1, 2+, ...) and of users by songs; as stated, 50
    belongs to the last two groups of users."""
    n = F.col("n")
    of_items = items.agg(F.count_if(n == 0).alias("items_0"), F.count_if(n == 1).alias("items_1"), *(F.count_if(n >= k).alias(f"items_{k}_up") for k in (2, 3, 5, 10)))
    of_users = users.agg(
        F.count_if(n == 0).alias("users_0"), *(F.count_if(n.between(a, b)).alias(f"users_{a}_{b}") for a, b in ((1, 5), (6, 10), (11, 20), (21, 50))), F.count_if(n >= 50).alias("users_50_up")
    )
    return of_items.join(F.broadcast(of_users))


def concentration(items: DataFrame, shares: tuple[float, ...] = (0.1, 0.01)) -> DataFrame:
    """The share of all interactions that the most popular songs have.

    Songs are first grouped by their count, so only as many rows as there are
    different counts are put in order."""
    by = items.groupBy("n").agg(F.count("*").alias("songs"))
    run = W.partitionBy(F.lit(0)).orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    by = by.withColumn("above", F.coalesce(F.sum("songs").over(run), F.lit(0)))
    totals = by.agg(F.sum("songs").alias("all_songs"), F.sum(F.col("songs") * F.col("n")).alias("all_n"))
    by = by.join(F.broadcast(totals))
    parts = []
    for p in shares:
        taken = F.greatest(F.lit(0), F.least("songs", F.floor(F.col("all_songs") * p) - F.col("above")))
        parts.append(r6(F.sum(taken * F.col("n")) / F.max("all_n")).alias(f"top_{round(p * 100)}"))
    return by.agg(*parts)


def sparsity(ui: DataFrame, catalog: DataFrame) -> DataFrame:
    own = ui.where("weight > 0").agg(F.count("*").alias("interactions"), F.countDistinct("user_id").alias("users"))
    both = own.join(F.broadcast(catalog.agg(F.count("*").alias("items"))))
    n = F.col("interactions")
    return both.select("interactions", "users", "items", r6(1 - n / (F.col("users") * F.col("items"))).alias("sparsity"), r6(n / F.col("users")).alias("per_user"), r6(n / F.col("items")).alias("per_item"))


def viability(ui: DataFrame, catalog: DataFrame) -> DataFrame:
    """Whether collaborative filtering can work: songs with several users, users that
    share songs, and the mean overlap of a pair of users (each pair once, without
    pairs of a user with themself)."""
    items = item_counts(ui, catalog)
    several = items.agg(*(F.count_if(F.col("n") >= k).alias(f"items_{k}_up") for k in (2, 3, 5)))
    # A song of n users gives n (n - 1) / 2 pairs: no pair has to be made to count them.
    pairs = items.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("shared"))
    shared = ui.where("weight > 0").join(items.where("n > 1").select("song_id"), "song_id", "left_semi").agg(F.countDistinct("user_id").alias("users_overlapping"))
    users = ui.where("weight > 0").agg(F.countDistinct("user_id").alias("users"))
    all_ = several.join(F.broadcast(pairs)).join(F.broadcast(shared)).join(F.broadcast(users))
    possible = F.col("users") * (F.col("users") - 1) / 2
    return all_.withColumn("mean_overlap", r6(F.when(possible > 0, F.col("shared") / possible).otherwise(0.0)))


def permutation(ui: DataFrame) -> DataFrame:
    """(users, items, pairs, is_permutation): whether each user has one song and each
    song one user, which no collaborative filter can learn from."""
    n = ui.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("song_id").alias("items"), F.countDistinct("user_id", "song_id").alias("pairs"))
    return n.withColumn("is_permutation", (F.col("pairs") > 0) & (F.col("users") == F.col("pairs")) & (F.col("items") == F.col("pairs")))


def most(ui: DataFrame, k: int = 10) -> DataFrame:
    """The k users and songs with most interactions."""
    return counts(ui, "user_id").orderBy(F.desc("n"), "user_id").limit(k).select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), "n").unionByName(
        counts(ui, "song_id").orderBy(F.desc("n"), "song_id").limit(k).select(F.lit("song").alias("kind"), F.col("song_id").alias("id"), "n")
    )


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two distributions of item counts side by side."""
    part = lambda df, s: df.agg(F.count("*").alias(f"items_{s}"), r6(F.avg("n")).alias(f"mean_{s}"), *(r6(F.count_if(c) / F.count("*")).alias(f"{x}_{s}") for x, c in (("cold", F.col("n") == 0), ("single", F.col("n") == 1), ("multi", F.col("n") > 1))))
    both = part(a, "a").join(F.broadcast(part(b, "b")))
    return both.withColumn("ratio", r6(F.col("mean_b") / F.col("mean_a")))


def sample_matrix(ui: DataFrame, users: int = 10, items: int = 20) -> DataFrame:
    """The first users and songs as a dense table, to look at."""
    u = [r[0] for r in ui.select("user_id").distinct().orderBy("user_id").limit(users).collect()]
    s = [r[0] for r in ui.select("song_id").distinct().orderBy("song_id").limit(items).collect()]
    return ui.where(F.col("user_id").isin(u) & F.col("song_id").isin(s)).groupBy("user_id").pivot("song_id", s).sum("weight").na.fill(0.0)
