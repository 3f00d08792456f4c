"""Catalog features: tags, genres, engagement, prompts, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import SPACE, col, filled, fitted, r6, strip, unit, words

# Genres in order of preference and the words that stand for them.
GENRES = {
    "pop": ["pop", "pop rock", "indie pop"],
    "rock": ["rock", "pop rock", "post-hardcore", "acoustic rock"],
    "hip hop": ["hip hop", "hip-hop", "rap", "trap"],
    "electronic": ["edm", "electronic", "synth", "glitch", "phonk"],
    "jazz": ["jazz", "blues"],
    "r&b": ["r&b", "r and b", "soul"],
    "country": ["country", "folk"],
    "classical": ["classical", "orchestral"],
    "metal": ["metal", "heavy metal"],
    "reggae": ["reggae", "dancehall"],
    "latin": ["latin", "salsa", "reggaeton"],
}


def tag_set(tags: str | Column, display: str | Column) -> Column:
    """Distinct lower-case tags of both comma-separated texts, sorted."""
    both = F.split(F.concat_ws(",", col(tags), col(display)), ",")
    return F.array_sort(F.array_distinct(F.filter(F.transform(both, lambda x: F.lower(strip(x))), lambda x: x != "")))


def parsed_tags(text: str | Column) -> Column:
    """Tags cut at commas, else at full stops (pieces of over two characters), else at
    white space; the whole text if that gives nothing or one piece of over 50."""
    # The text and its parts are bound, so that neither is worked out anew for each use.
    once = lambda c, f: F.transform(F.array(c), f)[0]

    def parts_of(t: Column) -> Column:
        pieces = lambda sep, least: F.filter(F.transform(F.split(t, sep), strip), lambda x: F.length(x) > least)
        return F.when(F.contains(t, F.lit(",")), pieces(",", 0)).when(F.contains(t, F.lit(".")), pieces(r"\.", 2)).otherwise(words(t))

    def checked(t: Column, parts: Column) -> Column:
        bad = (F.size(parts) == 0) | ((F.size(parts) == 1) & (F.length(F.get(parts, F.lit(0))) > 50))
        return F.when(strip(t) == "", F.array().cast("array<string>")).when(bad, F.array(strip(t))).otherwise(parts)

    return once(F.coalesce(col(text), F.lit("")), lambda t: once(parts_of(t), lambda parts: checked(t, parts)))


def first_tag_genre(tags: str | Column) -> Column:
    return F.coalesce(filled(F.substring(F.get(col(tags), F.lit(0)), 1, 50)), F.lit("unknown"))


def keyword_genre(tags: str | Column) -> Column:
    """The first genre of which a word is part of the joined tags; else null."""
    joined, out = F.lower(F.array_join(col(tags), " ")), None
    for genre, keys in GENRES.items():
        found = joined.contains(keys[0])
        for k in keys[1:]:
            found = found | joined.contains(k)
        out = F.when(found, genre) if out is None else out.when(found, genre)
    return out


def engagement_processed(df: DataFrame) -> DataFrame:
    play, up, comments = (F.coalesce(F.col(c), F.lit(0)) for c in ("play_count", "upvote_count", "comment_count"))
    return df.withColumns({"engagement_rate": r6((up + comments) / F.greatest(play, F.lit(1))), "popularity_score": r6(F.log1p(play) + 2 * F.log1p(up))})


def engagement_aggregated(df: DataFrame) -> DataFrame:
    play, up = (F.coalesce(F.col(c), F.lit(0)) for c in ("play_count", "upvote_count"))
    return df.withColumns({"engagement_rate": r6(F.when(play > 0, up / play).otherwise(0.0)), "popularity_score": play.cast("double")})


def prompt_features(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Length, words and counts of section marks of a prompt."""
    p = F.coalesce(F.col(prompt), F.lit(""))
    count = lambda name: F.regexp_count(p, F.lit(rf"(?i)\[{name}")).cast("long")
    out = df.withColumns({"prompt_length": F.length(p).cast("long"), "word_count": F.size(words(p)).cast("long"), "verse_count": count("verse"), "chorus_count": count("chorus"), "bridge_count": count("bridge")})
    return out.withColumn("has_structure", (F.col("verse_count") > 0) | (F.col("chorus_count") > 0))


def normal_prompt(p: str | Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(col(p), F.lit("")), f"{SPACE}+", " "))


def best_by_prompt(df: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """The best row of each normalised prompt, ties to the least song_id."""
    place = F.row_number().over(W.partitionBy(*(by or []), "normal").orderBy(F.desc(score), "song_id"))
    return df.withColumn("normal", normal_prompt("prompt")).withColumn("n", place).where("n = 1").drop("n")


def created(text: str | Column) -> Column:
    """Timestamp of a text in UTC without zone; null where it is none."""
    return F.try_to_timestamp(col(text)).cast("timestamp_ntz")


def age(created_at: str | Column, as_of: str, recent: int = 30) -> tuple[Column, Column]:
    days = F.floor(F.timestamp_diff("SECOND", col(created_at), F.lit(as_of).cast("timestamp_ntz")) / 86400).cast("int")
    return days.alias("days_since_creation"), (days <= recent).alias("is_recent")


def tag_stats(catalog: DataFrame) -> DataFrame:
    """(tag, n, share) over all tags of the catalog."""
    n = catalog.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("tag", "n", r6(F.col("n") / F.col("total")).alias("share"))


def scaled_metadata(catalog: DataFrame) -> DataFrame:
    """Z-scores of duration, popularity and engagement, and the genre as one-hot (empty
    without a genre). Genres are numbered as rows, so that no row holds all of them."""
    names = ["duration", "popularity_score", "engagement_rate"]
    stats = catalog.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names), F.countDistinct("genre").cast("int").alias("size"))
    z = [r6((F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + 1e-8)).alias(f"z_{c}") for c in names]
    places = catalog.where("genre IS NOT NULL").select("genre").distinct().withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("genre")))
    hot = F.concat(F.repeat(F.lit("0"), F.col("place") - 1), F.lit("1"), F.repeat(F.lit("0"), F.col("size") - F.col("place")))
    return catalog.join(places, "genre", "left").join(F.broadcast(stats)).select("song_id", *z, F.coalesce(hot, F.lit("")).alias("one_hot"))


def item_features(vectors: DataFrame, base: int, target: int | None = None) -> DataFrame:
    """Vectors cut or filled to base, perhaps cut to target, at length 1."""
    v = fitted("vec", base)
    return vectors.withColumn("vec", unit(F.slice(v, 1, target) if target else v))


def audio_vector(features: str | Column) -> Column:
    """The values of a map of feature arrays in order of its keys."""
    m = col(features)
    return F.flatten(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.element_at(m, k)))


def song_url(song_id: str | Column, base: str = "https://example.org/song/") -> Column:
    return F.concat(F.lit(base), col(song_id).cast("string"))


def html_genres(pages: DataFrame, pattern: str = r"<(?:h1|h2|h3)[^>]*>([^<]+)<") -> DataFrame:
    """Distinct texts that a pattern finds in pages, sorted."""
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("x"))
    return found.select(F.lower(strip("x")).alias("genre")).where("genre <> ''").distinct()


def metadata(catalog: DataFrame) -> DataFrame:
    """One row of counts, users, dates and the genre histogram."""
    genres = catalog.where("genre IS NOT NULL").groupBy("genre").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("genre", "n")))).alias("genres"))
    whole = catalog.agg(F.count("*").alias("total_songs"), F.countDistinct("user_id").alias("unique_users"), F.struct(F.min("created_at").alias("min"), F.max("created_at").alias("max")).alias("date_range"))
    return whole.join(F.broadcast(genres))
