"""Interaction builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import filled


def from_playlists(entries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Each playlist is a user; a song's weight is how often it stands there. known:
    the catalog, of which a song must be part."""
    if known is not None:
        entries = entries.join(known.select("song_id"), "song_id", "left_semi")
    return entries.groupBy(F.col("id").alias("user_id"), "song_id").agg(F.count("*").cast("double").alias("weight"))


def from_creators(catalog: DataFrame) -> DataFrame:
    """A song's creator is its user."""
    return catalog.groupBy(F.col("creator").alias("user_id"), "song_id").agg(F.count("*").cast("double").alias("weight"))


def creator(with_id: bool = True) -> Column:
    """Handle, user id (optional), display name or else the playlist itself."""
    names = ["user_handle", "user_id", "user_display_name"] if with_id else ["user_handle", "user_display_name"]
    return F.coalesce(*(filled(n) for n in names), F.concat(F.lit("playlist_"), F.col("id").cast("string")))


def from_playlist_creators(entries: DataFrame, known: DataFrame | None = None, with_id: bool = True) -> DataFrame:
    """Playlists of a creator are one user; songs count once."""
    if known is not None:
        entries = entries.join(known.select("song_id"), "song_id", "left_semi")
    return entries.select(creator(with_id).alias("user_id"), "song_id").distinct().withColumn("weight", F.lit(1.0))


def merged(real: DataFrame, simulated: DataFrame) -> DataFrame:
    """The union of two sets of interactions; weights are clipped at 1."""
    return real.unionByName(simulated).groupBy("user_id", "song_id").agg(F.least(F.lit(1.0), F.max("weight")).alias("weight"))


def build(mode: str, playlists: DataFrame | None = None, simulated: DataFrame | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """Interactions by mode: playlists, creators, simulated or playlists+simulated."""
    if mode == "playlists":
        return from_playlist_creators(playlists, catalog)
    if mode == "creators":
        return from_creators(catalog)
    if mode == "simulated":
        return simulated
    if mode == "playlists+simulated":
        return merged(from_playlist_creators(playlists, catalog), simulated)
    raise ValueError(f"no such mode: {mode}")


def as_history(ui: DataFrame, as_of: str) -> DataFrame:
    """Interactions as history: the i-th of a user's n songs is n - i days old."""
    user = W.partitionBy("user_id")
    i = F.row_number().over(user.orderBy("song_id")) - 1
    days = F.count("*").over(user) - i
    ts = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days.cast("int"))
    return ui.select("user_id", "song_id", ts.alias("ts"), "weight", F.lit("like").alias("type"), (i + 1).cast("long").alias("seq"))


def cold(catalog: DataFrame, ui: DataFrame) -> DataFrame:
    """Songs of the catalog that nobody has interacted with."""
    return catalog.join(ui.where("weight > 0").select("song_id"), "song_id", "left_anti")


def active(ui: DataFrame, least: int = 3) -> DataFrame:
    return ui.groupBy("user_id").agg(F.count("*").alias("songs")).where(F.col("songs") >= least)


def multi_playlist(entries: DataFrame, k: int = 10, with_id: bool = False) -> DataFrame:
    """The k creators with most playlists, of those with several."""
    per = entries.groupBy(creator(with_id).alias("creator")).agg(F.countDistinct("id").alias("playlists"), F.countDistinct("song_id").alias("songs"))
    return per.where("playlists > 1").orderBy(F.desc("playlists"), "creator").limit(k)
