"""Readers and writers of catalogs, playlists, history, embeddings and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import filled
from cadenza.operators import features, quality, simulate

from .parts import records

META = "struct<tags:string,prompt:string,duration:double,is_remix:boolean>"
SONG = f"""id string, title string, user_id string, handle string, display_name string, created_at string, audio_url string,
play_count bigint, upvote_count bigint, comment_count bigint, display_tags string, major_model_version string, is_public boolean, metadata {META}"""
HISTORY = "user_id string, song_id string, ts timestamp_ntz, weight double, type string, seq bigint"


LINES = (".jsonl", ".ndjson")


def _json(spark: SparkSession, path: str) -> DataFrame:
    """(doc): each whole JSON text of a path, in one row and so of 2 GB at most."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))


WHOLE = 1 << 26  # bytes of a JSON text that is read by one task


def raw_songs(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """Song records of a JSON list or of {"songs": [...]}, with their place pos. Texts of more than `whole`
    bytes are read in parts, as are files with a record in each line (.jsonl, .ndjson)."""
    if path.endswith(LINES):
        rows = spark.read.schema(SONG).json(path).withColumn("line", F.monotonically_increasing_id())
        return simulate.numbered(rows, "line").withColumnRenamed("i", "pos").select("pos", *rows.drop("line").columns)
    if spark.read.format("binaryFile").load(path).where(F.col("length") > whole).select("path").count():
        depth = F.when(F.col("head").rlike(r"^\s*\["), 1).when(F.col("head").rlike(r"^\s*\{"), 2).otherwise(0)
        found = records(spark, path, depth, "songs")
        if not found.isEmpty():  # else the whole text tells a list of nothing from an error
            rows = found.select("line", F.from_json("record", SONG).alias("s")).select("line", "s.*")
            return simulate.numbered(rows, "line").withColumnRenamed("i", "pos").select("pos", *rows.drop("line").columns)
    kind = T._parse_datatype_string(SONG).simpleString()
    doc = _json(spark, path).withColumn("doc", F.ltrim("doc"))
    listed = F.when(F.col("doc").startswith("["), F.from_json("doc", f"array<{kind}>"))
    inside = F.from_json("doc", f"struct<songs:array<{kind}>>")["songs"]
    bad = F.raise_error(F.concat(F.lit("neither a list of songs nor an object with songs: "), F.substring("doc", 1, 60))).cast(f"array<{kind}>")
    return doc.select(F.posexplode(F.coalesce(listed, inside, bad)).alias("pos", "s")).select("pos", "s.*")


def aggregated(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """The typed catalog of aggregated records: those with an id, defaults for all
    that is missing, unnamed creators numbered by the records accepted before."""
    rows = raw.where(F.col("pos") < limit) if limit else raw
    rows = simulate.numbered(rows.where(filled("id").isNotNull()), "pos")
    k = F.col("i").cast("string")
    tags = features.parsed_tags("metadata.tags")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = rows.select(
        F.col("id").alias("song_id"),
        F.coalesce(filled("user_id"), filled("handle"), filled("display_name"), F.concat(F.lit("unknown_user_"), k)).alias("user_id"),
        F.coalesce("title", F.lit("")).alias("title"), zero("play_count").alias("play_count"), zero("upvote_count").alias("upvote_count"),
        F.coalesce("metadata.duration", F.lit(0.0)).alias("duration"), tags.alias("tags"), features.first_tag_genre(tags).alias("genre"), F.coalesce("metadata.prompt", F.lit("")).alias("prompt"),
    )
    return features.engagement_aggregated(out)


def processed(raw: DataFrame, as_of: str) -> DataFrame:
    """The processed catalog: tags and genres by keyword, engagement, prompt features,
    dates in UTC and ages at as_of."""
    rows = raw.where(filled("id").isNotNull())
    tags = features.tag_set("metadata.tags", "display_tags")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = rows.select(
        F.col("id").alias("song_id"), F.coalesce("user_id", F.lit("")).alias("user_id"), F.coalesce("title", F.lit("")).alias("title"), features.created("created_at").alias("created_at"),
        F.coalesce("audio_url", F.lit("")).alias("audio_url"), zero("play_count").alias("play_count"), zero("upvote_count").alias("upvote_count"), zero("comment_count").alias("comment_count"),
        F.coalesce("metadata.duration", F.lit(0.0)).alias("duration"), tags.alias("tags"), features.keyword_genre(tags).alias("genre"), F.coalesce("metadata.prompt", F.lit("")).alias("prompt"),
        F.coalesce("major_model_version", F.lit("")).alias("model_version"), F.coalesce("is_public", F.lit(True)).alias("is_public"), F.coalesce("metadata.is_remix", F.lit(False)).alias("is_remix"),
    )
    return features.prompt_features(features.engagement_processed(out)).select("*", *features.age("created_at", as_of))


def save_processed(catalog: DataFrame, folder: str) -> None:
    """Parquet and JSON of the catalog and one JSON row of metadata."""
    catalog.write.mode("overwrite").parquet(f"{folder}/songs.parquet")
    catalog.write.mode("overwrite").json(f"{folder}/songs.json")
    features.metadata(catalog).write.mode("overwrite").json(f"{folder}/metadata.json")


def load_processed(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog's parquet, else its JSON, else an error."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{folder}/songs.parquet")
    except AnalysisException:
        try:
            return spark.read.json(f"{folder}/songs.json")
        except AnalysisException:
            raise FileNotFoundError(f"no processed catalog in {folder}") from None


PLAYLIST = "struct<id:string,name:string,user_id:string,user_handle:string,user_display_name:string,song_ids:array<string>,playlist_clips:array<struct<clip:struct<id:string>>>>"


def playlists(spark: SparkSession, path: str) -> DataFrame:
    """Playlists of a list, of an object's lists, or of a nested search response."""
    doc = _json(spark, path).withColumn("doc", F.ltrim("doc"))
    listed = F.when(F.col("doc").startswith("["), F.from_json("doc", f"array<{PLAYLIST}>"))
    nested = F.from_json("doc", f"struct<result:struct<playlist:struct<result:array<{PLAYLIST}>>>>")["result"]["playlist"]["result"]
    lists = F.map_values(F.from_json("doc", "map<string,string>"))
    every = F.flatten(F.transform(F.filter(lists, lambda x: F.ltrim(x).startswith("[")), lambda x: F.from_json(x, f"array<{PLAYLIST}>")))
    rows = doc.select(F.explode(F.coalesce(listed, nested, every)).alias("p")).select("p.*")
    clips = F.transform("playlist_clips", lambda c: c["clip"]["id"])
    return rows.withColumn("song_ids", F.coalesce("song_ids", clips, F.array().cast("array<string>"))).drop("playlist_clips")


def playlist_entries(lists: DataFrame) -> DataFrame:
    return lists.select("id", "user_id", "user_handle", "user_display_name", F.explode("song_ids").alias("song_id"))


def history(spark: SparkSession, path: str) -> DataFrame:
    """History of a JSON export {user_history: {user: [...]}}; nothing if unreadable."""
    row = "struct<song_id:string,timestamp:string,weight:double,type:string>"
    doc = _json(spark, path).select(F.from_json("doc", f"struct<user_history:map<string,array<{row}>>>")["user_history"].alias("m"))
    rows = doc.select(F.explode("m").alias("user_id", "rows")).select("user_id", F.posexplode("rows").alias("i", "r"))
    return rows.select(
        "user_id", F.col("r.song_id").alias("song_id"), features.created("r.timestamp").alias("ts"), F.coalesce("r.weight", F.lit(1.0)).alias("weight"), F.coalesce("r.type", F.lit("play")).alias("type"), (F.col("i") + 1).cast("long").alias("seq")
    )


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(song_id, embedding) of a JSON object of arrays."""
    return _json(spark, path).select(F.explode(F.from_json("doc", "map<string,array<float>>")).alias("song_id", "embedding"))


def stored_scores(spark: SparkSession, path: str) -> DataFrame:
    """(song_id, quality_score) of a JSON object of score records in any layout."""
    rows = _json(spark, path).select(F.explode(F.from_json("doc", "map<string,string>")).alias("song_id", "record"))
    return rows.select("song_id", quality.stored_score("record").alias("quality_score")).where("quality_score IS NOT NULL")


def missing_embeddings(catalog: DataFrame, known: DataFrame) -> DataFrame:
    """Songs with an id and audio whose embedding is still to be made."""
    return catalog.where(filled("song_id").isNotNull() & filled("audio_url").isNotNull()).join(known.select("song_id"), "song_id", "left_anti")


KEYS_PER_FILE = 10_000  # users or songs of a JSON object that is written


def _save_objects(entries: DataFrame, path: str, wrap: str | None, keys_per_file: int) -> None:
    """entries (key, value) as files that hold a JSON object each, of some keys_per_file keys."""
    parts = max(1, -(-entries.count() // keys_per_file))
    dealt = entries.where("key IS NOT NULL").groupBy(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("m"))
    doc = F.to_json(F.struct(F.col("m").alias(wrap))) if wrap else F.to_json("m")
    dealt.select(doc).write.option("maxRecordsPerFile", 1).text(path)


def save_history(rows: DataFrame, path: str, keys_per_file: int = KEYS_PER_FILE) -> None:
    """Write history (user_id, song_id, ts, weight, type, seq) as the JSON that history() reads, in
    several files in a new folder. Rows without a user are left out, as the format has no place for them."""
    row = F.struct("seq", "song_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("weight").cast("double").alias("weight"), "type")
    listed = rows.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    value = F.transform("rows", lambda r: F.struct(r["song_id"].cast("string").alias("song_id"), r["timestamp"].alias("timestamp"), r["weight"].alias("weight"), r["type"].alias("type")))
    _save_objects(listed.select("key", value.alias("value")), path, "user_history", keys_per_file)


def save_embeddings(rows: DataFrame, path: str, keys_per_file: int = KEYS_PER_FILE) -> None:
    """Write (song_id, embedding), unique by song, as the JSON that embeddings() reads, in several files."""
    _save_objects(rows.select(F.col("song_id").cast("string").alias("key"), F.col("embedding").cast("array<float>").alias("value")), path, None, keys_per_file)
