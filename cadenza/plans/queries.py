"""The engine's queries over the tables at hand, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza import streaming
from cadenza.functions import dot, norm, r6, unit
from cadenza.operators import channels, diagnostics, evaluation, features, history, hybrid, interactions, neighbours, quality, ranking, sampling, similarity, simulate, topk, training
from cadenza.sources.bindings import AS_OF, Tables
from cadenza.service import Recommender
from cadenza.sources import registry
from cadenza.sources.scratch import new_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


# Interactions


@query
def ui_from_playlists(t: Tables) -> DataFrame:
    return interactions.from_playlists(t.entries(t.genres()))


@query
def ui_from_creators(t: Tables) -> DataFrame:
    return interactions.from_creators(t.catalog())


@query
def ui_creator_priority(t: Tables) -> DataFrame:
    return interactions.from_playlist_creators(t.playlists(), t.catalog())


@query
def multi_playlist_creators(t: Tables) -> DataFrame:
    return interactions.multi_playlist(t.playlists())


@query
def active_users(t: Tables) -> DataFrame:
    return interactions.active(t.likes())


@query
def ui_as_history(t: Tables) -> DataFrame:
    return interactions.as_history(t.likes(), AS_OF)


@query
def cold_songs(t: Tables) -> DataFrame:
    """Songs that nobody has returned in large orders."""
    few = t.lines().where("l_returnflag = 'R' AND l_quantity > 40").select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("song_id")).withColumn("weight", F.lit(1.0))
    return interactions.cold(t.catalog(), few).select("song_id")


@query
def interactions_merged(t: Tables) -> DataFrame:
    real = t.likes().withColumn("weight", F.lit(0.4))
    return interactions.merged(real, t.interactions().withColumn("weight", F.col("weight").cast("double") / 50))


@query
def permutation_test(t: Tables) -> DataFrame:
    return diagnostics.permutation(t.likes())


# Similarity and collaborative channels


def item_sims(t: Tables, k: int) -> DataFrame:
    return topk.top_similar(t.likes(), "song_id", "user_id", k)


def user_sims(t: Tables, k: int) -> DataFrame:
    return topk.top_similar(t.likes(), "user_id", "song_id", k)


@query
def item_item_cosine_topk(t: Tables) -> DataFrame:
    return item_sims(t, 5)


@query
def item_item_weighted_cosine(t: Tables) -> DataFrame:
    return topk.top_similar(t.interactions(), "song_id", "user_id", 5)


@query
def user_user_cosine_topk(t: Tables) -> DataFrame:
    return user_sims(t, 5)


def seeds(t: Tables, n: int = 16) -> DataFrame:
    return history.last_n(t.plays(), n)


def item_cf_scores(t: Tables, n: int = 10) -> DataFrame:
    return channels.item_cf(seeds(t), item_sims(t, 5), n=n, per_seed=5)


@query
def item_cf_recommend(t: Tables) -> DataFrame:
    return item_cf_scores(t)


def user_cf_scores(t: Tables, n: int = 10) -> DataFrame:
    near = user_sims(t, 20).select(F.col("a").alias("user_id"), F.col("b").alias("other"), "sim")
    recent = history.last_n(t.plays(), 50).select("user_id", "song_id", (-F.col("seq")).alias("place"))
    return channels.user_cf(near, t.likes(), recent, n=n)


@query
def user_cf_recommend(t: Tables) -> DataFrame:
    return user_cf_scores(t)


@query
def virtual_user_recommend(t: Tables) -> DataFrame:
    """Each creator's five most played songs as an unknown user's seeds."""
    own = similarity.top(t.catalog(), 5, ["creator"], "play_count", "song_id").select(F.col("creator").alias("user_id"), "song_id")
    near = channels.virtual_users(own, t.likes())
    likes = near.join(t.likes().select(F.col("user_id").alias("other"), "song_id", "weight"), "other")
    scored = likes.groupBy("user_id", "song_id").agg(r6(F.sum(F.col("sim") * F.col("weight"))).alias("score"))
    return similarity.top(channels.without(scored, own), 10, ["user_id"], "score", "song_id")


@query
def similar_songs_colike(t: Tables) -> DataFrame:
    return channels.co_liked(t.likes())


@query
def similar_songs_item_cf(t: Tables) -> DataFrame:
    return item_sims(t, 10)


@query
def popular_fallback(t: Tables) -> DataFrame:
    return channels.popular(features.engagement_processed(t.catalog()))


@query
def cold_start_fill(t: Tables) -> DataFrame:
    """Two item results for each user, filled up with popular songs."""
    warm = stored(item_cf_scores(t.shared(), 2), "warm")  # read three times
    songs = channels.popular(features.engagement_processed(t.catalog()), 12)
    fallback = warm.select("user_id").distinct().join(F.broadcast(songs))
    return channels.with_cold_start(warm, fallback, 10)


# History


@query
def last_n_history(t: Tables) -> DataFrame:
    return history.last_n(t.history(), 50)


def event_stream(t: Tables) -> DataFrame:
    """The events as a stream of (user_id, song_id, ts, event_id, weight, type)."""
    song = F.get_json_object("props", "$.k").cast("long")
    rows = t.spark.readStream.schema(t["events"].schema).parquet(f"{t.dir}/events.parquet*")
    return rows.select("user_id", song.alias("song_id"), "ts", "event_id", F.col("value").alias("weight"), F.col("event_type").alias("type"))


@query
def streamed_history(t: Tables) -> DataFrame:
    """The last 50 rows of each user as a stream's state holds them."""
    folder = new_folder(t.spark, "history")
    streaming.keep_last(event_stream(t), folder, 50).awaitTermination()
    return streaming.current(t.spark, folder)


@query
def streamed_weekly_lists(t: Tables) -> DataFrame:
    """Each user's list of each week that is over a day before the last event."""
    folder = new_folder(t.spark, "weeks")
    streaming.weekly_lists(event_stream(t), folder, 50, "1 day").awaitTermination()
    return t.spark.read.parquet(f"{folder}/lists")


@query
def weekly_mixing(t: Tables) -> DataFrame:
    return history.weekly_mix(t.history(), AS_OF).select("user_id", "song_id", "place")


@query
def weekly_mixing_weights(t: Tables) -> DataFrame:
    return history.weekly_mix(t.history(), AS_OF, exact=True).select("user_id", "song_id", "weight", "seq", "place")


@query
def update_due(t: Tables) -> DataFrame:
    last = t.history().groupBy("user_id").agg(F.max("ts").alias("last_update"))
    return last.select("user_id", history.update_due(F.col("last_update"), "2024-01-29 08:00:00").alias("due"), history.update_due(F.col("last_update"), AS_OF).alias("due_midweek"))


@query
def history_users(t: Tables) -> DataFrame:
    return history.users(t.history())


@query
def latest_items(t: Tables) -> DataFrame:
    """History where a user has one, else songs by a date made of their size."""
    day = F.lit("2024-01-01").cast("timestamp_ntz") - F.make_dt_interval(F.col("p_size"))
    created = t["part"].select(F.col("p_partkey").alias("song_id"), F.when(F.col("p_size") > 20, day).alias("created_at"))
    return history.latest_items(t.likes(), t.history(), created, 20).withColumn("place", F.col("place").cast("long"))


# Features


@query
def engagement_processed(t: Tables) -> DataFrame:
    return features.engagement_processed(t.catalog()).select("song_id", "engagement_rate", "popularity_score")


@query
def engagement_aggregated(t: Tables) -> DataFrame:
    return features.engagement_aggregated(t.catalog()).select("song_id", "engagement_rate", "popularity_score")


@query
def tag_extract(t: Tables) -> DataFrame:
    tags = features.tag_set(F.regexp_replace("p_name", " ", " , "), F.col("p_type"))
    return t["part"].select(F.col("p_partkey").alias("song_id"), F.array_join(tags, "|").alias("tags"))


@query
def tag_parse_rules(t: Tables) -> DataFrame:
    """Prompts cut short by their id stand in for tag texts of all forms."""
    text = F.when(F.col("song_id") % 3 == 0, F.regexp_replace("prompt", ",", "")).when(F.col("song_id") % 3 == 1, F.regexp_replace("prompt", "[,.]", "")).otherwise(F.col("prompt"))
    tags, parsed = F.col("tags"), t.prompts().select("song_id", features.parsed_tags(text).alias("tags"))
    return parsed.select("song_id", F.size(tags).cast("long").alias("n"), features.first_tag_genre(tags).alias("genre"), F.md5(F.array_join(tags, "|").cast("binary")).alias("tags_md5"))


@query
def genre_keyword(t: Tables) -> DataFrame:
    tags = F.split(F.regexp_replace(F.concat_ws(" ", "p_name", F.lower("p_type")), "blue", "blues"), " ")
    return t["part"].select(F.col("p_partkey").alias("song_id"), features.keyword_genre(tags).alias("genre"))


@query
def prompt_features(t: Tables) -> DataFrame:
    return features.prompt_features(t.prompts()).drop("prompt")


@query
def prompt_dedup_best(t: Tables) -> DataFrame:
    scored = t["documents"].select(F.col("doc_id").alias("song_id"), F.col("text").alias("prompt"), (F.col("n_chars") % 97).alias("score"))
    return features.best_by_prompt(scored).select("song_id", "score")


@query
def tag_stats(t: Tables) -> DataFrame:
    return features.tag_stats(t.catalog())


@query
def metadata_zscore_onehot(t: Tables) -> DataFrame:
    return features.scaled_metadata(features.engagement_processed(t.catalog()))


@query
def vector_l2_normalize(t: Tables) -> DataFrame:
    v = features.item_features(t.vectors(), 80, 48)
    return v.select("song_id", F.size("vec").cast("long").alias("size"), r6(norm("vec")).alias("norm"), r6(F.col("vec")[0]).alias("first"), r6(dot("vec", "vec")).alias("square"))


@query
def html_genre_scrape(t: Tables) -> DataFrame:
    return features.html_genres(t["pages"])


@query
def catalog_metadata(t: Tables) -> DataFrame:
    dated = t.catalog().withColumn("user_id", F.col("creator")).withColumn("created_at", F.lit(AS_OF).cast("timestamp_ntz"))
    m = features.metadata(dated)
    return m.select("total_songs", "unique_users", F.explode("genres").alias("genre", "n"))


# Quality


@query
def quality_heuristic(t: Tables) -> DataFrame:
    return quality.heuristic(features.engagement_processed(t.catalog()))


@query
def quality_filter_boost(t: Tables) -> DataFrame:
    songs = features.engagement_processed(t.catalog())
    kept = quality.gate(songs.select("song_id", "popularity_score"), quality.heuristic(songs), 0.3)
    return kept.select("song_id", "quality_score", quality.boosted("popularity_score", "quality_score").alias("boosted"))


@query
def quality_summary(t: Tables) -> DataFrame:
    return quality.summary(quality.heuristic(features.engagement_processed(t.catalog())))


@query
def quality_json_paths(t: Tables) -> DataFrame:
    """Events as stored score records in the four layouts and one without a score."""
    forms = ['{"overall_quality_score": %s}', '{"scores": {"overall_quality_score": %s}}', '{"overall_recommendation_score": %s}', '{"scores": {"overall_recommendation_score": %s}}', '{"title": %s}']
    json = F.lit(None)
    for i, f in enumerate(forms):
        json = F.when(F.col("event_id") % 5 == i, F.format_string(f, F.format_string("%.3f", F.col("value")))).otherwise(json)
    return t["events"].select("event_id", quality.stored_score(json).alias("quality_score")).where("quality_score IS NOT NULL")


def answers(t: Tables) -> DataFrame:
    """Events as answers of a model: JSON in prose, broken JSON with spoken scores, or
    nothing of use."""
    v = F.concat(F.lit("0."), F.lpad((F.floor("value") % 100).cast("string"), 2, "0"))
    good = F.concat(F.lit('Sure: {"content_usefulness": '), v, F.lit(', "production_quality": 0.8, "content_enjoyment": 1.7} ok'))
    spoken = F.concat(F.lit("Content usefulness: "), v, F.lit(' {"x": Production_Quality = 0.25'))
    text = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, spoken).otherwise(F.lit("no idea"))
    return t["events"].select("event_id", text.alias("text"))


@query
def llm_score_parse(t: Tables) -> DataFrame:
    parts = quality.parsed_answer("text")
    return answers(t).select("event_id", *(r6(c).alias(n) for n, c in parts.items()))


@query
def llm_overall(t: Tables) -> DataFrame:
    return answers(t).select("event_id", quality.overall(quality.parsed_answer("text")).alias("overall"))


# Vectors


@query
def user_mean_vector(t: Tables) -> DataFrame:
    m = channels.mean_vectors(t.history(), t.vectors())
    return m.select("user_id", F.posexplode("vec").alias("i", "x")).select("user_id", F.col("i").cast("long").alias("i"), r6("x").alias("x"))


def tower_scores(t: Tables, n: int = 10) -> DataFrame:
    return channels.towers(channels.mean_vectors(t.history(), t.vectors()), t.vectors(), t.history(), n)


@query
def two_tower_identity_topk(t: Tables) -> DataFrame:
    return tower_scores(t)


def tower_nets(t: Tables) -> list[training.Layers]:
    """Both towers, trained on plays against songs that were shown and not played."""
    history, vectors = t.history(), t.vectors()
    negatives = simulate.impression_negatives(shown(t), history.select("user_id", "song_id"), 10)
    users, songs = channels.mean_vectors(history, vectors).select("user_id", "vec"), vectors.select("song_id", "vec")
    users = stored(users, "users")
    examples = stored(training.with_ids(history, negatives, users, vectors), "examples")
    tables = {"user": users, "item": songs, "others": songs}
    chunks = training.packed_ids(examples, training.TOWER, ["user_id", "song_id"], tables, new_folder(t.spark, "chunks"), runs=True)
    return training.fit_towers(chunks, 64, epochs=3, hidden=(64, 32))[0]


def encoded(t: Tables, nets: list[training.Layers]) -> tuple[DataFrame, DataFrame]:
    """Users (user_id, vec) and songs (song_id, vec) behind their towers, written once."""
    users = channels.mean_vectors(t.history(), t.vectors()).select("user_id", training.tower(nets[0])("vec").alias("vec"))
    songs = t.vectors().select("song_id", training.tower(nets[1])("vec").alias("vec"))
    return stored(users, "users"), stored(songs, "songs")


@query
def two_tower_trained_topk(t: Tables) -> DataFrame:
    users, songs = encoded(t, tower_nets(t))
    return channels.towers(users, songs, t.history(), 10)


def served_tables(t: Tables) -> dict[str, tuple[DataFrame, str]]:
    """All that requests are served from, the trained towers' lists among them."""
    t = t.shared()
    users, songs = encoded(t, tower_nets(t))
    near = neighbours.nearest(songs, songs, 20, query="song_id").select(F.col("q").alias("a"), F.col("song_id").alias("b"), F.col("sim").alias("score"))
    catalog = features.engagement_processed(t.catalog())
    return Recommender.tables(
        catalog=catalog, quality=quality.heuristic(catalog), history=t.plays(), likes=t.likes(), item_sims=item_sims(t, 20), user_sims=user_sims(t, 20),
        co_liked=channels.co_liked(t.likes(), 20), tower_lists=channels.towers(users, songs, t.history(), 100), tower_sims=near,
    )


@query
def user_row(t: Tables) -> DataFrame:
    """The row of the user with the most songs, read from one bucket of published interactions."""
    folder = new_folder(t.spark, "registry")
    likes = t.shared().likes()
    registry.publish(t.spark, folder, Recommender.tables(likes=likes))
    most = likes.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").first()
    tables, _ = registry.current(t.spark, folder)
    return registry.rows_of(tables["likes"], "user_id", [most.user_id] if most else []).select("user_id", "song_id", "weight")


@query
def dense_similar_items(t: Tables) -> DataFrame:
    return neighbours.nearest(t.vectors(), t.vectors(), 10, query="song_id")


def prompt_index(t: Tables) -> neighbours.NeighbourIndex:
    return neighbours.NeighbourIndex.build(t.vectors(), new_folder(t.spark, "index"))


def own_vectors(t: Tables) -> DataFrame:
    return t.vectors().select(F.col("song_id").alias("q"), "vec")


@query
def prompt_index_search(t: Tables) -> DataFrame:
    """The ten nearest of each song that is among some user's last 16, from eight cells of the index."""
    wanted = history.last_n(t.history(), 16).select(F.col("song_id").alias("q")).distinct()
    return prompt_index(t).search(own_vectors(t).join(wanted, "q", "left_semi"), 10, 8, keep_self=False)


@query
def similar_prompts(t: Tables) -> DataFrame:
    found = prompt_index(t).search(own_vectors(t), 10, 16, keep_self=False)
    return found.select(F.col("q").alias("a"), F.col("song_id").alias("b"), channels.nearness("sim").alias("score"), "rank")


@query
def index_recall(t: Tables) -> DataFrame:
    """What the index finds of the true ten nearest of 256 songs, by the number of cells asked."""
    return prompt_index(t).audit(own_vectors(t), 10, (4, 8, 16, 32, 64))


def prompt_pool(t: Tables) -> DataFrame:
    """Seeds: a user's last 16 songs. A song's artist is its embedding's label."""
    own = history.last_n(t.history(), 16).select("user_id", "song_id").distinct()
    songs = t.vectors().select("song_id", "label").join(t.prompts(), "song_id").select("song_id", F.col("label").alias("creator"), "prompt")
    mixed = t.vectors().select("song_id", unit("vec").alias("v"))
    # Vectors of a label lie apart; shifted by a common one, near and far differ less.
    shifted = mixed.select("song_id", F.transform("v", lambda x: x + 0.15).alias("vec"))
    wanted = shifted.join(own.select("song_id").distinct(), "song_id", "left_semi")
    near = neighbours.nearest(wanted, shifted, 21, query="song_id", keep_self=True)
    return channels.prompt_candidates(own, near, songs)


@query
def prompt_channel_candidates(t: Tables) -> DataFrame:
    return prompt_pool(t).select("user_id", "song_id", "score", F.array_join("seeds", ",").alias("seeds"))


@query
def prompt_channel_greedy(t: Tables) -> DataFrame:
    return channels.diverse(prompt_pool(t))


@query
def content_match(t: Tables) -> DataFrame:
    songs = features.engagement_processed(t.catalog())
    return channels.content(stored(seeds(t, 8), "seeds"), songs)


def content_scores(t: Tables, n: int = 10) -> DataFrame:
    return channels.content_based(stored(seeds(t, 8), "seeds"), t.vectors(), features.engagement_processed(t.catalog()), n)


@query
def content_knn(t: Tables) -> DataFrame:
    return content_scores(t)


@query
def content_similar_songs(t: Tables) -> DataFrame:
    return channels.content_similar(t.vectors())


@query
def cold_seeds_fallback(t: Tables) -> DataFrame:
    """Item results; users whose seeds are all cold songs get content results."""
    t = t.shared()
    own, few = stored(seeds(t, 2), "seeds"), t.likes().where("song_id % 3 > 0")
    warm = channels.item_cf(own.join(few.select("song_id").distinct(), "song_id", "left_semi"), topk.top_similar(few, "song_id", "user_id", 5), per_seed=5)
    cold = interactions.cold(t.catalog(), few)
    return channels.with_cold_seeds(channels.without(warm, own), own, cold, channels.content_based(own, t.vectors(), features.engagement_processed(t.catalog())))


@query
def incremental_embedding_anti_join(t: Tables) -> DataFrame:
    return t.catalog().select("song_id").join(t.vectors().select("song_id"), "song_id", "left_anti")


# Hybrid


def two_channels(t: Tables) -> dict[str, DataFrame]:
    t = t.shared()
    return {"item_cf": item_cf_scores(t, 30), "user_based": user_cf_scores(t, 30)}


@query
def hybrid_blend(t: Tables) -> DataFrame:
    return hybrid.blend(two_channels(t)).select("user_id", "song_id", "recall_score", "primary_channel")


def recommended(t: Tables, n: int = 10) -> DataFrame:
    return hybrid.recommend(two_channels(t), quality.heuristic(features.engagement_processed(t.catalog())), n)


@query
def hybrid_pipeline(t: Tables) -> DataFrame:
    return recommended(t).select("user_id", "song_id", "recall_score", "quality_score", "fine_score", "primary_channel", "rank")


def four_channels(t: Tables) -> dict[str, DataFrame]:
    t = t.shared()
    prompts = similarity.top(prompt_pool(t), 30, ["user_id"], "score", "song_id")
    return two_channels(t) | {"two_tower": tower_scores(t, 30), "prompt_based": prompts}


def click_rates(t: Tables, candidates: DataFrame) -> DataFrame:
    """A stand-in for a model: click rates from the cosine to a user's mean (none where the cosine is
    not known). The re-rank's stand-in for model scores is a part's size, if a multiple of two."""
    u = channels.mean_vectors(t.history(), t.vectors()).select("user_id", unit("vec").alias("uv"))
    met = candidates.select("user_id", "song_id").join(u, "user_id").join(t.vectors().select("song_id", unit("vec").alias("iv")), "song_id")
    return met.select("user_id", "song_id", r6(1 / (1 + F.exp(-r6(dot("uv", "iv"))))).alias("ctr"))


@query
def hybrid_full(t: Tables) -> DataFrame:
    """All four channels, quality gate, click rates, re-rank."""
    llm = t["part"].where("p_size % 2 = 0").select(F.col("p_partkey").alias("song_id"), (F.col("p_size") / 50).alias("llm_score"))
    best = hybrid.recommend(four_channels(t), quality.heuristic(features.engagement_processed(t.catalog())), 10, ctr=lambda rows: click_rates(t, rows), llm=llm)
    return best.select("user_id", "song_id", "recall_score", "quality_score", "fine_score", "final_score", "primary_channel", "rank")


@query
def similar_songs_hybrid(t: Tables) -> DataFrame:
    t = t.shared()
    items = item_sims(t, 20).select("a", "b", F.col("sim").alias("score"))
    vectors = neighbours.nearest(t.vectors(), t.vectors(), 20, query="song_id").select(F.col("q").alias("a"), F.col("song_id").alias("b"), F.col("sim").alias("score"))
    users = channels.co_liked(t.likes(), 20).drop("rank")
    return hybrid.similar({"item_cf": items, "user_based": users, "two_tower": vectors}).withColumn("rank", F.col("rank").cast("long"))


@query
def explained_channels(t: Tables) -> DataFrame:
    return hybrid.explained(two_channels(t))


@query
def channel_attribution(t: Tables) -> DataFrame:
    return hybrid.attribution(recommended(t))


@query
def llm_rerank(t: Tables) -> DataFrame:
    fine = item_cf_scores(t, 50).select("user_id", "song_id", F.col("score").alias("fine_score"))
    llm = t["part"].where("p_size > 10").select(F.col("p_partkey").alias("song_id"), (F.col("p_size") / 50).alias("llm_score"))
    return similarity.top(hybrid.rerank(fine, llm, 10), 10, ["user_id"], "final_score", "song_id").select("user_id", "song_id", "fine_score", "final_score", "rank")


@query
def din_attention_ctr(t: Tables) -> DataFrame:
    pool = tower_scores(t, 20).select("user_id", "song_id")
    return ranking.click_rates(pool, t.history(), t.vectors(), ranking.Din(64))


@query
def din_trained_ctr(t: Tables) -> DataFrame:
    """Click rates of a model trained on plays against songs that were shown and not played."""
    history, vectors = t.history(), t.vectors()
    plays = history.select("user_id", "song_id").distinct()
    events = plays.withColumn("label", F.lit(1)).unionByName(simulate.impression_negatives(shown(t), plays, 10).select("user_id", "song_id", F.lit(0).alias("label")))
    labelled = stored(ranking.din_examples(events, history, last=12), "labelled")
    examples, songs = stored(training.with_history_ids(labelled, vectors), "examples"), vectors.select("song_id", "vec")
    tables = {"candidate": songs, "history": songs}
    chunks = training.packed_ids(examples, training.CLICK, ["user_id", "song_id"], tables, new_folder(t.spark, "chunks"))
    model, _ = training.fit_din(chunks, 64, epochs=2)
    return ranking.click_rates(tower_scores(t, 20), history, vectors, model)


# Simulation and training sets


@query
def popularity_weights(t: Tables) -> DataFrame:
    return simulate.popularity_weights(features.engagement_processed(t.catalog())).select("song_id", F.round("p", 9).alias("p"))


@query
def genre_preferences(t: Tables) -> DataFrame:
    own = t.likes().join(t.catalog().select("song_id", "genre"), "song_id").select("user_id", "genre")
    return simulate.genre_preferences(own, t.catalog().select("genre"))


@query
def sample_without_replacement(t: Tables) -> DataFrame:
    """Each creator draws ten songs of its favourite genres by affinity."""
    songs = features.engagement_aggregated(t.catalog())
    own = songs.select(F.col("creator").alias("user_id"), "genre")
    weights = songs.select("song_id", (F.col("popularity_score") + 0.5).alias("p"))
    prefs = simulate.genre_preferences(own, songs.select("genre"))
    return simulate.without_replacement(simulate.affinity(weights, prefs, songs), 10).select("user_id", "song_id", "draw")


@query
def draws_by_class(t: Tables) -> DataFrame:
    """As many songs for each user as its activity says, by popularity and the genres of its likes, without a row for
    each user and song. No SQL: draws come from streams of random numbers for each user."""
    likes = t.shared().likes().select("user_id", "song_id")  # read twice
    weights = simulate.popularity_weights(features.engagement_processed(t.catalog()))
    songs = weights.join(t.genres(), "song_id")
    own = likes.join(t.genres(), "song_id").select("user_id", "genre").repartition("user_id").groupBy("user_id", "genre").agg(F.count("*").alias("n"))
    liking = own.select("user_id", "genre", r6(1.2 * F.col("n") / F.sum("n").over(W.partitionBy("user_id"))).alias("liking"))
    # Stored, else a condition on a user's activity is worked out for each of its likes.
    users = stored(simulate.user_activity(likes.select("user_id").distinct()), "users")
    return sampling.draw_without_replacement(songs, users, liking)


@query
def item_classes(t: Tables) -> DataFrame:
    return simulate.item_classes(t.catalog())


@query
def user_activity(t: Tables) -> DataFrame:
    return simulate.user_activity(t.likes().select("user_id").distinct())


@query
def single_user_items(t: Tables) -> DataFrame:
    users = simulate.numbered(t.likes().select("user_id").distinct(), "user_id")
    return simulate.assign_singles(simulate.item_classes(t.catalog()), t.likes().where("song_id % 2 = 0").select("song_id").distinct(), users)


@query
def uniform_negatives(t: Tables) -> DataFrame:
    return simulate.uniform_negatives(t.likes(), t.catalog(), 20)


def shown(t: Tables) -> DataFrame:
    weights = t["embeddings"].select(F.col("vec_id").alias("song_id"), F.lit(1.0).alias("w")).withColumn("w", 1.0 + F.col("song_id") % 4)
    total = weights.agg(F.sum("w").alias("total"))
    p = weights.join(F.broadcast(total)).select("song_id", (F.col("w") / F.col("total")).alias("p"))
    return simulate.impressions(p, t.history().select("user_id").distinct(), 50)


@query
def impression_negatives(t: Tables) -> DataFrame:
    return simulate.impression_negatives(shown(t), t.history().select("user_id", "song_id"), 10)


@query
def hard_negatives(t: Tables) -> DataFrame:
    return simulate.hard_negatives(shown(t), channels.mean_vectors(t.history(), t.vectors()), t.vectors())


@query
def train_val_split(t: Tables) -> DataFrame:
    return simulate.split(t["events"].select("event_id", "user_id"), ["event_id"])


def scored_examples(t: Tables) -> DataFrame:
    """(user_id, song_id, label, score): played and shown songs by cosine to the mean."""
    u = channels.mean_vectors(t.history(), t.vectors()).select("user_id", unit("vec").alias("uv"))
    pos = t.history().select("user_id", "song_id").distinct().withColumn("label", F.lit(1))
    neg = simulate.impression_negatives(shown(t), pos, 10)
    both = pos.unionByName(neg).join(t.vectors().select("song_id", unit("vec").alias("iv")), "song_id").join(u, "user_id")
    return both.select("user_id", "song_id", "label", r6(dot("uv", "iv")).alias("score"))


@query
def infonce_loss(t: Tables) -> DataFrame:
    return ranking.infonce(scored_examples(t))


@query
def bpr_loss(t: Tables) -> DataFrame:
    return ranking.bpr(scored_examples(t))


@query
def tower_training_set(t: Tables) -> DataFrame:
    neg = simulate.impression_negatives(shown(t), t.history().select("user_id", "song_id"), 10)
    ex = ranking.tower_examples(t.history().select("user_id", "song_id", "seq"), neg)
    return ex.select("user_id", "song_id", F.array_join("recent", ",").alias("recent"), F.array_join("negatives", ",").alias("negatives"))


@query
def din_training_set(t: Tables) -> DataFrame:
    pos = t.history().select("user_id", "song_id").distinct().withColumn("label", F.lit(1))
    neg = simulate.impression_negatives(shown(t), t.history().select("user_id", "song_id"), 10)
    ex = ranking.din_examples(pos.unionByName(neg), t.history(), last=12)
    return ex.select("user_id", "song_id", "label", F.array_join("hist", ",", "-").alias("hist"), F.col("size").cast("long").alias("size"))


# Evaluation


def split_by_date(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Plays before a cut date, and songs first played after it as relevant."""
    first = t.lines().groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("song_id")).agg(F.min("o_orderdate").alias("ts"))
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    return first.where(F.col("ts") < cut), first.where(F.col("ts") >= cut).select("user_id", "song_id")


def popular_lists(t: Tables, n: int = 40) -> tuple[DataFrame, DataFrame]:
    """The popular songs of each user's nation before the cut, without known ones."""
    before, relevant = split_by_date(t)
    nation = t["customer"].select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nation"))
    counts = before.join(nation, "user_id").groupBy("nation", "song_id").agg(F.count("*").alias("n"))
    best = similarity.top(counts, n, ["nation"], "n", "song_id", "at")
    lists = nation.join(best, "nation").join(before.select("user_id", "song_id"), ["user_id", "song_id"], "left_anti")
    return lists.select("user_id", "song_id", F.row_number().over(W.partitionBy("user_id").orderBy("at")).cast("long").alias("rank")), relevant


@query
def precision_recall_ndcg_map(t: Tables) -> DataFrame:
    return evaluation.ranking_metrics(*popular_lists(t))


@query
def metrics_over_cases(t: Tables) -> DataFrame:
    return evaluation.over_cases(evaluation.ranking_metrics(*popular_lists(t)))


@query
def diversity(t: Tables) -> DataFrame:
    return evaluation.diversity(popular_lists(t)[0].where("rank <= 10"), t.catalog(), "tags")


@query
def coverage(t: Tables) -> DataFrame:
    return evaluation.coverage(popular_lists(t)[0].where("rank <= 10"), t.catalog())


# Diagnostics


@query
def distribution_stats(t: Tables) -> DataFrame:
    return diagnostics.distribution(diagnostics.counts(t.likes(), "user_id"))


@query
def interaction_buckets(t: Tables) -> DataFrame:
    return diagnostics.buckets(diagnostics.counts(t.likes(), "user_id"), diagnostics.item_counts(t.likes(), t.catalog()))


@query
def popularity_concentration(t: Tables) -> DataFrame:
    return diagnostics.concentration(diagnostics.item_counts(t.likes(), t.catalog()))


@query
def interaction_sparsity(t: Tables) -> DataFrame:
    return diagnostics.sparsity(t.likes(), t.catalog())


@query
def cf_viability(t: Tables) -> DataFrame:
    return diagnostics.viability(t.likes(), t.catalog())


@query
def top_users_items(t: Tables) -> DataFrame:
    return diagnostics.most(t.likes())


@query
def distributions_compared(t: Tables) -> DataFrame:
    plays = diagnostics.item_counts(t.likes(), t.catalog())
    own = diagnostics.item_counts(t.history().select("user_id", "song_id").distinct().withColumn("weight", F.lit(1.0)), t.catalog())
    return diagnostics.compared(own, plays)
