"""The entities of the engine as projections of the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import doubles

from .scratch import stored

AS_OF = "2024-01-24 10:00:00"
ENTRIES = 1 << 20  # of playlists in a task


class Tables:
    """Entities over the parquet tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def shared(self) -> Tables:
        """The same, with likes and plays written once for a query that reads them often."""
        return self if isinstance(self, _Shared) else _Shared(self.spark, self.dir)

    def lines(self) -> DataFrame:
        """Each playlist entry with its user and time."""
        return self["lineitem"].join(self["orders"], F.col("l_orderkey") == F.col("o_orderkey"))

    def interactions(self) -> DataFrame:
        """(user_id, song_id, weight), unique for each pair."""
        return self.lines().groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("song_id")).agg(F.sum("l_quantity").alias("weight"))

    def likes(self) -> DataFrame:
        """Interactions with weight 1."""
        return self.lines().select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("song_id")).distinct().withColumn("weight", F.lit(1.0))

    def plays(self) -> DataFrame:
        """(user_id, song_id, seq): a user's songs in order of their last play."""
        # Dealt by user at once: hardly any pair comes twice, and a user's rows are put in order next.
        own = self.lines().select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("song_id"), "o_orderdate").repartition("user_id")
        last = own.groupBy("user_id", "song_id").agg(F.max("o_orderdate").alias("ts"))
        return last.select("user_id", "song_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "song_id")).cast("long").alias("seq"))

    def playlists(self) -> DataFrame:
        """(id, user_handle, user_id, user_display_name, song_id): one row for each entry."""
        key = F.col("o_custkey").cast("string")
        return self.lines().select(
            F.col("o_orderkey").alias("id"),
            F.when(F.col("o_orderpriority") != "1-URGENT", F.concat(F.lit("h"), key)).otherwise("").alias("user_handle"),
            F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("u"), key)).otherwise("").alias("user_id"),
            F.when(F.col("o_totalprice") < 100000, F.concat(F.lit("d"), key)).otherwise("").alias("user_display_name"),
            F.col("l_partkey").alias("song_id"),
        )

    def entries(self, known: DataFrame) -> DataFrame:
        """(id, song_id): one row for each playlist entry of a known song, dealt by playlist to tasks in proportion to
        their number, so that a task's rows do not grow."""
        lines = self["lineitem"].select("l_orderkey", F.col("l_partkey").alias("song_id"))
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // ENTRIES))
        songs = known.select("song_id")
        if songs.count() > ENTRIES:
            lines, songs = lines.repartition(tasks, "song_id"), songs.repartition(tasks, "song_id")
        lines = lines.join(songs, "song_id", "left_semi").repartition(tasks, "l_orderkey")
        orders = self["orders"].select("o_orderkey").repartition(tasks, "o_orderkey")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("id"), "song_id")

    def catalog(self) -> DataFrame:
        counts = self["lineitem"].groupBy(F.col("l_partkey").alias("song_id")).agg(
            F.count("*").alias("play_count"), F.count_if(F.col("l_returnflag") == "A").alias("upvote_count"), F.count_if(F.col("l_returnflag") == "R").alias("comment_count")
        )
        part = self["part"].select(
            F.col("p_partkey").alias("song_id"), F.col("p_name").alias("title"), F.split("p_name", " ").alias("tags"), F.lower("p_type").alias("genre"), F.col("p_brand").alias("creator"), F.col("p_size").cast("double").alias("duration")
        )
        zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("play_count", "upvote_count", "comment_count")]
        return part.join(counts, "song_id", "left").select("song_id", "title", "tags", "genre", "creator", "duration", *zero)

    def genres(self) -> DataFrame:
        """(song_id, genre) of the catalog, without its counts."""
        return self["part"].select(F.col("p_partkey").alias("song_id"), F.lower("p_type").alias("genre"))

    def history(self) -> DataFrame:
        """(user_id, song_id, ts, weight, type, seq)"""
        song = F.get_json_object("props", "$.k").cast("long")
        seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
        return self["events"].select("user_id", song.alias("song_id"), "ts", F.col("value").alias("weight"), F.col("event_type").alias("type"), seq.alias("seq"))

    def vectors(self) -> DataFrame:
        """(song_id, vec, label): embeddings in double precision."""
        return self["embeddings"].select(F.col("vec_id").alias("song_id"), doubles("embedding").alias("vec"), "label")

    def prompts(self) -> DataFrame:
        return self["documents"].select(F.col("doc_id").alias("song_id"), F.col("text").alias("prompt"))


class _Shared(Tables):
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__(spark, sf_dir)
        self._kept: dict[str, DataFrame] = {}

    def _once(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = stored(df, name)
        return self._kept[name]

    def likes(self) -> DataFrame:
        return self._once("likes", super().likes())

    def plays(self) -> DataFrame:
        return self._once("plays", super().plays())
