"""One interface to fitted tables: recommendations, similar songs, information."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators import channels, hybrid
from cadenza.operators.history import last_n
from cadenza.operators.similarity import top
from cadenza.sources import registry

NEIGHBOURS = 20  # other users that propose songs


@dataclass
class Recommender:
    """Tables that a weekly refresh writes. Keys of a request are known when it is planned: tables in
    buckets (those of `load`) are read at the buckets of these keys only. The user's last songs and nearest
    others, `last` and NEIGHBOURS at most, are read first, as they are keys of other tables."""

    catalog: DataFrame
    item_sims: DataFrame  # (a, b, sim)
    quality: DataFrame
    history: DataFrame
    weights: dict[str, float] = field(default_factory=lambda: {"item_cf": 1.0, "user_based": 1.0, "two_tower": 1.0, "content": 1.0})
    user_sims: DataFrame | None = None  # (a, b, sim) of users; with likes a channel
    likes: DataFrame | None = None  # (user_id, song_id, weight)
    vectors: DataFrame | None = None  # (song_id, vec); a content channel
    tower_lists: DataFrame | None = None  # (user_id, song_id, score) of the trained towers
    tower_sims: DataFrame | None = None  # (a, b, score) of songs by the trained item tower
    co_liked: DataFrame | None = None  # (a, b, score) of songs with the same users

    @staticmethod
    def tables(**tables: DataFrame) -> dict[str, tuple[DataFrame, str]]:
        """Tables with the key that requests read them by, as registry.publish takes them."""
        keys = {"catalog": "song_id", "quality": "song_id", "vectors": "song_id", "history": "user_id", "likes": "user_id", "tower_lists": "user_id"}
        return {name: (df, keys.get(name, "a")) for name, df in tables.items()}

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Recommender:
        """The current version of a folder that registry.publish has written."""
        tables, facts = registry.current(spark, folder)
        known = {f.name for f in fields(cls)}
        return cls(**{n: df for n, df in tables.items() if n in known}, **{n: x for n, x in facts.items() if n == "weights"})

    def user_row(self, user_id) -> DataFrame:
        """(song_id, weight): one user's row of the interactions."""
        if self.likes is None:
            raise ValueError("no likes are known")
        return registry.rows_of(self.likes, "user_id", [user_id]).select("song_id", "weight")

    def recommend(self, user_id=None, song_ids: list | None = None, n: int = 10, exclude_song_ids: list | None = None, last: int = 50) -> DataFrame:
        """The n best songs for a user's last songs and those given, without these and
        the excluded ones; popular songs if nothing is known of either."""
        if user_id is None and not song_ids:
            raise ValueError("a user or songs are needed")
        if not 1 <= n <= 100:
            raise ValueError("n is from 1 to 100")
        mine = [] if user_id is None else [user_id]
        me = F.lit(-1 if user_id is None else user_id).alias("user_id")
        listed = lambda ids: registry.rows_of(self.catalog, "song_id", ids or []).select(me, "song_id")
        own = last_n(registry.rows_of(self.history, "user_id", mine), last).select(me, "song_id")
        seeds = own.unionByName(listed(song_ids)).distinct()
        seed_ids = [r.song_id for r in seeds.collect()]  # of one request: `last` and those given at most
        excludes = listed(exclude_song_ids)
        sims = registry.rows_of(self.item_sims, "a", seed_ids)
        found = {"item_cf": channels.item_cf(seeds, sims, n=3 * n, per_seed=5, excludes=excludes)}
        if mine and self.user_sims is not None and self.likes is not None:
            near = top(registry.rows_of(self.user_sims, "a", mine), NEIGHBOURS, ["a"], "sim", "b").select(me, F.col("b").alias("other"), "sim")
            others = [r.other for r in near.collect()]
            recent = last_n(registry.rows_of(self.history, "user_id", others), last).select("user_id", "song_id", (-F.col("seq")).alias("place"))
            likes = registry.rows_of(self.likes, "user_id", others + mine)
            found["user_based"] = channels.without(channels.user_cf(near, likes, recent, n=3 * n), seeds, excludes)
        if mine and self.tower_lists is not None:
            lists = registry.rows_of(self.tower_lists, "user_id", mine).select(me, "song_id", "score")
            found["two_tower"] = top(channels.without(lists, seeds, excludes), 3 * n, ["user_id"], "score", "song_id")
        elif self.tower_sims is not None:
            near = registry.rows_of(self.tower_sims, "a", seed_ids).withColumnRenamed("score", "sim")
            found["two_tower"] = channels.item_cf(seeds, near, n=3 * n, per_seed=5, excludes=excludes)
        if self.vectors is not None:
            found["content"] = channels.content_based(seeds, self.vectors, self.catalog, 3 * n, excludes=excludes)
        best = hybrid.recommend(found, self.quality, n, weights=self.weights)
        place = F.row_number().over(W.orderBy(F.desc("score"), "song_id")).cast("long")  # n + 100 rows at most
        spare = channels.without(channels.popular(self.catalog, n + len(exclude_song_ids or [])).select(me, "song_id", "score"), excludes).withColumn("rank", place).where(F.col("rank") <= n)
        spare = spare.join(best.select("user_id").distinct(), "user_id", "left_anti").select("user_id", "song_id", F.col("score").alias("fine_score"), F.lit("popular").alias("primary_channel"), "rank")
        return hybrid.decorated(best.unionByName(spare, allowMissingColumns=True), self.catalog)

    def similar(self, song_id, n: int = 10) -> DataFrame:
        """(a, b, sim, rank) of item CF alone, or (a, b, score, rank) blended with the songs that
        the same users have and those near in the trained tower, as far as these are known."""
        of = lambda df: registry.rows_of(df, "a", [song_id])
        items = of(self.item_sims)
        parts = {"user_based": self.co_liked, "two_tower": self.tower_sims}
        if all(df is None for df in parts.values()):
            return top(items, n, ["a"], "sim", "b")
        found = {name: of(df).select("a", "b", "score") for name, df in parts.items() if df is not None}
        return hybrid.similar({"item_cf": items.select("a", "b", F.col("sim").alias("score"))} | found, n)

    def info(self) -> dict:
        return {"songs": self.catalog.count(), "weights": self.weights}
