"""Deterministic simulation of interactions and negatives. All draws come from hashes
of a seed and the keys, so results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import dot, r6, uniform, unit
from cadenza.sources.scratch import stored

from .sampling import alias_table, draws, spread
from .similarity import top


def _positive(u: Column) -> Column:
    return F.greatest(u, F.lit(1e-10))


def normal(seed: str, *keys: str) -> Column:
    """A standard normal draw (Box-Muller)."""
    return F.sqrt(-2 * F.ln(_positive(uniform(f"{seed}/r", *keys)))) * F.cos(2 * F.pi() * uniform(f"{seed}/a", *keys))


def popularity_weights(catalog: DataFrame, seed: str = "42", sigma: float = 0.3) -> DataFrame:
    """(song_id, p): ((popularity / most) + 0.1)^2 times lognormal noise, summing to 1."""
    most = catalog.agg(F.max("popularity_score").alias("most"))
    raw = F.pow(F.col("popularity_score") / F.greatest(F.col("most"), F.lit(1e-9)) + 0.1, 2.0) * F.exp(sigma * normal(seed, "song_id"))
    raw = catalog.join(F.broadcast(most)).select("song_id", raw.alias("w"))
    return raw.join(F.broadcast(raw.agg(F.sum("w").alias("total")))).select("song_id", (F.col("w") / F.col("total")).alias("p"))


def user_activity(users: DataFrame, seed: str = "42", least: int = 3, most: int = 50) -> DataFrame:
    """(user_id, k): least + a (most - least) songs for a Beta(2, 5) draw a, which is
    the second least of six uniform draws."""
    draws = F.array_sort(F.array(*(uniform(f"{seed}/{i}", "user_id") for i in range(6))))
    return users.select("user_id", F.floor(least + draws[1] * (most - least)).cast("int").alias("k"))


def genre_preferences(own: DataFrame, genres: DataFrame) -> DataFrame:
    """(user_id, genre, preference): 0.6 of the user's own share plus 0.4 / G; users
    without songs like all genres alike. own: (user_id, genre), genre null for none."""
    n = own.where("genre IS NOT NULL").groupBy("user_id", "genre").agg(F.count("*").alias("n"))
    total = n.groupBy("user_id").agg(F.sum("n").alias("total"))
    g = genres.select("genre").distinct()
    users = own.select("user_id").distinct().join(total, "user_id", "left")
    all_ = users.crossJoin(g).join(F.broadcast(g.agg(F.count("*").alias("G")))).join(n, ["user_id", "genre"], "left")
    p = F.when(F.col("total").isNull(), 1 / F.col("G")).otherwise(0.6 * F.coalesce(F.col("n"), F.lit(0)) / F.col("total") + 0.4 / F.col("G"))
    return all_.select("user_id", "genre", r6(p).alias("preference"))


def affinity(weights: DataFrame, preferences: DataFrame, catalog: DataFrame) -> DataFrame:
    """(user_id, song_id, w) for all songs of genres that have a preference."""
    songs = catalog.select("song_id", "genre", *[c for c in ("days_since_creation",) if c in catalog.columns]).join(weights, "song_id")
    w = F.col("p") * (1 + 2 * F.col("preference"))
    if "days_since_creation" in songs.columns:
        w = w * F.coalesce(1 + 0.3 * F.exp(-0.1 * F.col("days_since_creation") / 365), F.lit(1.0))
    return songs.join(preferences, "genre").select("user_id", "song_id", w.alias("w"))


def without_replacement(weighted: DataFrame, k: Column | int, seed: str = "42") -> DataFrame:
    """k weighted draws for each user without replacement (Efraimidis-Spirakis): the
    songs with the least -ln(u) / w."""
    key = -F.ln(_positive(uniform(seed, "user_id", "song_id"))) / F.col("w")
    place = F.row_number().over(W.partitionBy("user_id").orderBy("key", "song_id"))
    return weighted.where("w > 0").withColumn("key", r6(key)).withColumn("draw", place.cast("long")).where(F.col("draw") <= k)


def item_classes(catalog: DataFrame, cold: float = 0.05, single: float = 0.15, seed: str = "42") -> DataFrame:
    """(song_id, class): the first 5 % of a shuffle cold, the next 15 % single-user.

    The shuffle is cut by quantiles of its hash found from 4096 buckets of it, so only
    counts of buckets and the two buckets that hold a cut are put in order."""
    songs = catalog.select("song_id").distinct().withColumn("u", uniform(seed, "song_id")).withColumn("b", F.floor(F.col("u") * 4096).cast("int"))
    n = songs.groupBy("b").agg(F.count("*").alias("in_b"))
    before = W.partitionBy(F.lit(0)).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    n = n.select("b", F.coalesce(F.sum("in_b").over(before), F.lit(0)).alias("before"))
    placed = songs.join(n, "b").withColumn("i", F.col("before") + F.row_number().over(W.partitionBy("b").orderBy("u", "song_id")))
    total = songs.agg(F.count("*").alias("total"))
    cuts = F.floor(F.col("total") * cold), F.floor(F.col("total") * cold) + F.floor(F.col("total") * single)
    return placed.join(F.broadcast(total)).select("song_id", F.when(F.col("i") <= cuts[0], "cold").when(F.col("i") <= cuts[1], "single").otherwise("multi").alias("class"))


def assign_singles(classes: DataFrame, taken: DataFrame, users: DataFrame, seed: str = "42") -> DataFrame:
    """Each single-user song that nobody has yet goes to one user by hash. users:
    (user_id, i) with i from 0 without gaps, and the number of them in n."""
    left = classes.where("class = 'single'").join(taken.select("song_id"), "song_id", "left_anti")
    size = F.broadcast(users.agg(F.count("*").alias("n")))
    return left.join(size).withColumn("i", F.floor(uniform(f"{seed}/single", "song_id") * F.col("n")).cast("long")).join(users, "i").select("user_id", "song_id", F.lit(1.0).alias("weight"))


def uniform_negatives(positives: DataFrame, catalog: DataFrame, k: int = 50, seed: str = "42", tries: int = 4) -> DataFrame:
    """k songs of the catalog for each user that the user doesn't have, or all of them if
    they are fewer. A user's songs are in the order of tries * k drawn numbers, then of
    a hash; the first that aren't positives are taken.

    Only users whose draws leave them short are joined with all songs: they have most of the
    catalog (or it is small), so that this makes rows in proportion to the positives."""
    songs = numbered(catalog.select("song_id").distinct(), "song_id")
    songs = stored(songs, "songs")
    users = spread(positives.select("user_id").distinct(), "user_id").join(F.broadcast(songs.agg(F.count("*").alias("songs"))))
    drawn = users.select("user_id", "songs", F.explode(F.sequence(F.lit(0), F.lit(tries * k - 1))).alias("d"))
    drawn = drawn.select("user_id", F.col("d").cast("long").alias("d"), F.floor(uniform(seed, "user_id", "d") * F.col("songs")).cast("long").alias("i"))
    drawn = drawn.groupBy("user_id", "i").agg(F.min("d").alias("d")).join(songs, "i").select("user_id", "song_id", F.col("d").cast("double").alias("o"))
    own = positives.select("user_id", "song_id").distinct()
    drawn = stored(drawn.join(own, ["user_id", "song_id"], "left_anti"), "drawn")
    found = drawn.groupBy("user_id").agg(F.count("*").alias("found"))
    listed = own.join(songs.select("song_id"), "song_id").groupBy("user_id").agg(F.count("*").alias("listed"))
    wanted = F.least(F.lit(k), F.col("songs") - F.coalesce("listed", F.lit(0)))
    short = users.join(found, "user_id", "left").join(listed, "user_id", "left").where(F.coalesce("found", F.lit(0)) < wanted)
    rest = short.select("user_id").join(songs.select("song_id")).select("user_id", "song_id", (tries * k + uniform(seed, "user_id", "song_id")).alias("o"))
    free = drawn.unionByName(rest.join(own, ["user_id", "song_id"], "left_anti")).groupBy("user_id", "song_id").agg(F.min("o").alias("o"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy("o", "song_id"))
    return free.withColumn("n", place).where(F.col("n") <= k).select("user_id", "song_id", F.lit(0).alias("label"))


def running(df: DataFrame, key: str, value: Column, out: str, buckets: int = 256) -> DataFrame:
    """df with out, the sum of value over all rows up to the row in order of key. Ranges
    of the key between quantiles are summed first and rows inside them, so no sort lands in
    one task however the keys lie."""
    cuts = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    df = df.withColumn("_v", value).join(F.broadcast(df.agg(F.percentile_approx(key, cuts, F.lit(10 * buckets)).alias("_q"))))
    df = df.withColumn("_b", F.size(F.filter("_q", lambda q: q < F.col(key))))
    n = df.groupBy("_b").agg(F.sum("_v").alias("_s"))
    n = n.select("_b", F.coalesce(F.sum("_s").over(W.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_b").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    return df.join(n, "_b").withColumn(out, F.col("_before") + F.sum("_v").over(inside)).drop("_v", "_q", "_b", "_before")


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with i, the place of key in order from 0."""
    return running(df, key, F.lit(1), "i").withColumn("i", (F.col("i") - 1).cast("long"))


def impressions(weights: DataFrame, users: DataFrame, m: int = 50, seed: str = "42") -> DataFrame:
    """(user_id, song_id): m draws with replacement by weight for each user, each song
    once."""
    return spread(draws(alias_table(weights), users, m, f"{seed}/imp").select("user_id", "song_id"), "user_id").distinct()


def impression_negatives(shown: DataFrame, positives: DataFrame, k: int = 10, seed: str = "42") -> DataFrame:
    """k of the songs shown to each user that the user doesn't have."""
    left = spread(shown.join(positives.select("user_id", "song_id"), ["user_id", "song_id"], "left_anti"), "user_id")
    place = F.row_number().over(W.partitionBy("user_id").orderBy(uniform(f"{seed}/neg", "user_id", "song_id"), "song_id"))
    return left.withColumn("n", place).where(F.col("n") <= k).select("user_id", "song_id", F.lit(0).alias("label"))


def hard_negatives(shown: DataFrame, user_vectors: DataFrame, vectors: DataFrame, k: int = 5, share: float = 0.2, seed: str = "42") -> DataFrame:
    """k by hash of the 20 % of the songs shown that are nearest to the user's mean."""
    sims = shown.join(user_vectors.select("user_id", unit("vec").alias("uv")), "user_id").join(vectors.select("song_id", unit("vec").alias("iv")), "song_id")
    sims = sims.select("user_id", "song_id", r6(dot("uv", "iv")).alias("sim"))
    size = F.count("*").over(W.partitionBy("user_id"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("sim"), "song_id"))
    near = sims.withColumn("size", size).withColumn("n", place).where(F.col("n") <= F.greatest(F.lit(1), F.floor(F.col("size") * share)))
    drawn = near.withColumn("o", uniform(f"{seed}/hard", "user_id", "song_id"))
    return top(drawn.withColumn("minus", -F.col("o")), k, ["user_id"], "minus", "song_id").select("user_id", "song_id", "sim")


def split(df: DataFrame, keys: list[str], held_out: float = 0.2, seed: str = "42") -> DataFrame:
    """df with part: valid for the first floor(held_out * n) rows of a shuffle, else train.
    The shuffle is cut as in item_classes: only counts of its buckets are put in order."""
    df = df.withColumn("_u", uniform(f"{seed}/split", *keys)).withColumn("_b", F.floor(F.col("_u") * 4096).cast("int"))
    n = df.groupBy("_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    n = n.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(F.lit(0))).alias("_total"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy("_u", *keys))
    part = F.when(place <= F.floor(F.col("_total") * held_out), "valid").otherwise("train")
    return df.join(F.broadcast(n), "_b").withColumn("part", part).drop("_u", "_b", "_before", "_total")
