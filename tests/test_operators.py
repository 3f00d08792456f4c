"""Operators that no registered query covers, and invariants."""

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.operators import channels, diagnostics, evaluation, features, history, hybrid, interactions, quality, ranking, similarity, simulate

UI = "user_id long, song_id long, weight double"
few = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
pairs = st.sets(st.tuples(st.integers(0, 6), st.integers(0, 9)), min_size=1, max_size=40)


@few
@given(pairs)
def test_similarity_is_symmetric_and_matches_numpy(spark, ui):
    import numpy as np

    m = np.zeros((7, 10))
    for u, s in ui:
        m[u, s] = 1 + (u * s) % 3
    df = spark.createDataFrame([(u, s, float(m[u, s])) for u, s in ui], UI)
    n = np.linalg.norm(m, axis=0)
    got = {(r.a, r.b): r.sim for r in similarity.cosine(df, "song_id", "user_id").collect()}
    for a in range(10):
        for b in range(10):
            want = m[:, a] @ m[:, b]
            if a != b and want > 0:
                assert got[a, b] == got[b, a] == pytest.approx(want / (n[a] * n[b]), abs=1e-6) and 0 <= got[a, b] <= 1
            else:
                assert (a, b) not in got


@few
@given(pairs, st.integers(1, 5))
def test_last_n_and_exclusions(spark, ui, n):
    rows = spark.createDataFrame([(u, s, i) for i, (u, s) in enumerate(sorted(ui))], "user_id long, song_id long, seq long")
    kept = history.last_n(rows, n)
    assert all(r.c <= n for r in kept.groupBy("user_id").agg(F.count("*").alias("c")).collect())
    sims = similarity.cosine(rows.withColumn("weight", F.lit(1.0)), "song_id", "user_id")
    found = {(r.user_id, r.song_id) for r in channels.item_cf(kept, sims, 10).collect()}
    assert not found & {(r.user_id, r.song_id) for r in kept.collect()}


@few
@given(pairs, pairs)
def test_metrics_lie_between_zero_and_one(spark, rec, rel):
    listed, at = [], {}
    for u, s in sorted(rec):
        at[u] = at.get(u, 0) + 1
        listed.append((u, s, at[u]))
    got = evaluation.ranking_metrics(spark.createDataFrame(listed, "user_id long, song_id long, rank long"), spark.createDataFrame(list(rel), "user_id long, song_id long"), (3, 5)).collect()
    assert len(got) == 2 * len({u for u, _ in rel})
    assert all(0 <= v <= 1 for r in got for v in (r.precision, r.recall, r.ndcg, r.map))


def test_modes_of_interactions(spark):
    entries = spark.createDataFrame([("1", "h", "", "", 1), ("1", "h", "", "", 2), ("2", "", "", "", 1), ("3", "h", "", "", 9)], "id string, user_handle string, user_id string, user_display_name string, song_id long")
    songs = spark.createDataFrame([(1, "c"), (2, "c"), (3, "d")], "song_id long, creator string")
    sim = spark.createDataFrame([("h", 1, 1.0), ("x", 3, 1.0)], "user_id string, song_id long, weight double")
    built = lambda m: {(r.user_id, r.song_id) for r in interactions.build(m, entries, sim, songs).collect()}
    real = {("h", 1), ("h", 2), ("playlist_2", 1)}
    assert built("playlists") == real and built("playlists+simulated") == real | {("x", 3)}
    assert built("creators") == {("c", 1), ("c", 2), ("d", 3)} and built("simulated") == {("h", 1), ("x", 3)}
    assert interactions.merged(interactions.from_playlist_creators(entries, songs), sim).agg(F.max("weight")).first()[0] == 1.0
    with pytest.raises(ValueError):
        interactions.build("other")


def test_simulated_sizes(spark):
    songs = spark.range(200).select(F.col("id").alias("song_id"))
    classes = simulate.item_classes(songs)
    assert {r["class"]: r.n for r in classes.groupBy("class").agg(F.count("*").alias("n")).collect()} == {"cold": 10, "single": 30, "multi": 160}
    k = [r.k for r in simulate.user_activity(spark.range(300).select(F.col("id").alias("user_id"))).collect()]
    assert min(k) >= 3 and max(k) <= 50 and 13 < sum(k) / len(k) < 20  # the mean of Beta(2, 5) is 2/7
    users = spark.range(10).select(F.col("id").alias("user_id"), F.col("id").alias("i"))
    got = simulate.assign_singles(classes, spark.createDataFrame([], "song_id long"), users).collect()
    assert len(got) == 30 and {r.user_id for r in got} <= set(range(10))
    p = simulate.popularity_weights(songs.withColumn("popularity_score", F.col("song_id") * 1.0))
    assert p.agg(F.sum("p")).first()[0] == pytest.approx(1)
    own = spark.createDataFrame([(u, s, 1.0) for u in range(3) for s in range(0, 200, 7)], UI)
    neg = {(r.user_id, r.song_id) for r in simulate.uniform_negatives(own, songs, 12).collect()}
    assert len(neg) == 36 and not any(s % 7 == 0 for _, s in neg)


def test_negatives_of_users_who_have_most_songs(spark):
    songs = spark.range(2000).select(F.col("id").alias("song_id"))
    own = [(1, s) for s in range(1800)] + [(2, s) for s in range(1910)] + [(3, 5)] + [(4, s) for s in range(1000, 1900)] + [(4, s) for s in range(5000, 5950)]
    got = [(r.user_id, r.song_id) for r in simulate.uniform_negatives(spark.createDataFrame(own, "user_id long, song_id long"), songs, 20).collect()]
    assert len(got) == len(set(got)) and not set(got) & set(own)
    assert [sum(u == i for u, _ in got) for i in (1, 2, 3, 4)] == [20] * 4


def test_split_and_numbers(spark):
    rows = spark.range(1003).select(F.when(F.col("id") == 7, 10**12).otherwise(F.col("id")).alias("k"))
    parts = {r.part: r.n for r in simulate.split(rows, ["k"]).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"valid": 200, "train": 803}
    got = {r.k: r.i for r in simulate.numbered(rows, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}


def test_weighted_draws_follow_weights(spark):
    rows = spark.range(3000).crossJoin(spark.createDataFrame([(0, 1.0), (1, 4.0)], "song_id long, w double")).select(F.col("id").alias("user_id"), "song_id", "w")
    got = simulate.without_replacement(rows, 1).groupBy("song_id").count().collect()
    assert {r.song_id: r["count"] / 3000 for r in got}[1] == pytest.approx(0.8, abs=0.03)


def test_training_examples(spark):
    hist = spark.createDataFrame([(1, s, s) for s in range(5)], "user_id long, song_id long, seq long")
    events = spark.createDataFrame([(1, 4, 1), (1, 9, 0), (2, 3, 1), (2, 7, 0)], "user_id long, song_id long, label int")
    got = {(r.user_id, r.song_id): r for r in ranking.din_examples(events, hist, 3).collect()}
    assert set(got) == {(1, 4), (1, 9), (2, 7)}
    assert got[1, 4].hist == [1, 2, 3] and got[1, 9].hist == [2, 3, 4] and got[2, 7].hist == [None] * 3


def test_history_appends(spark):
    schema = "user_id long, song_id long, ts timestamp_ntz, weight double, type string"
    old = spark.createDataFrame([(1, s, datetime(2024, 1, 1 + s), 1.0, "play", s + 1) for s in range(3)], schema + ", seq long")
    new = spark.createDataFrame([(1, 9, datetime(2023, 1, 1), None, None), (2, 9, datetime(2023, 1, 1), 2.0, "like")], schema)
    got = sorted((r.user_id, r.seq, r.song_id, r.weight, r.type) for r in history.append(old, new, 3).collect())
    assert got == [(1, 2, 1, 1.0, "play"), (1, 3, 2, 1.0, "play"), (1, 4, 9, 1.0, "play"), (2, 1, 9, 2.0, "like")]


def test_quality_sources(spark):
    songs = spark.createDataFrame([(1, 10, 5, 0.5), (2, 0, 0, 0.0)], "song_id long, play_count long, upvote_count long, engagement_rate double")
    stored = spark.createDataFrame([(1, 3.0)], "song_id long, quality_score double")
    assert {r.song_id: r.quality_score for r in quality.fit(songs, stored).collect()} == {1: 1.0, 2: 0.0}
    assert {r.song_id: r.quality_score for r in quality.fit(songs, scorer=lambda s: s["play_count"] / 10).collect()} == {1: 1.0, 2: 0.0}
    assert {r.song_id: r.quality_score for r in quality.fit(songs).collect()} == {1: pytest.approx(1, abs=1e-5), 2: 0.0}
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "song_id long, quality_score double")
    assert {r.quality_score for r in quality.into_unit(flat).collect()} == {0.5}


def test_blend_and_click_rates(spark):
    a = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.4)], "user_id long, song_id long, score double")
    b = spark.createDataFrame([(1, 2, 1.0)], "user_id long, song_id long, score double")
    found = {r.song_id: r for r in hybrid.blend({"item_cf": a, "two_tower": b}).collect()}
    assert found[2].channel_scores == {"item_cf": 0.1, "two_tower": 0.35} and found[2].primary_channel == "two_tower" and found[2].recall_score == 0.45
    q = spark.createDataFrame([(1, 0.9), (2, 0.1)], "song_id long, quality_score double")
    ctr = spark.createDataFrame([(1, 1, 0.7)], "user_id long, song_id long, ctr double")
    rec = hybrid.recommend({"item_cf": a, "two_tower": b}, q, ctr=ctr).collect()
    assert [(r.song_id, r.fine_score) for r in rec] == [(1, 0.7)]
    sims = {"item_cf": a.toDF("a", "b", "score"), "two_tower": b.toDF("a", "b", "score")}
    assert [r.b for r in hybrid.similar(sims).orderBy("rank").collect()] == [2, 1]


def test_dense_sample(spark):
    ui = spark.createDataFrame([(1, 5, 2.0), (2, 6, 1.0)], UI)
    assert sorted(tuple(r) for r in diagnostics.sample_matrix(ui).collect()) == [(1, 2.0, 0.0), (2, 0.0, 1.0)]


def test_latest_items_by_source(spark):
    ui = spark.createDataFrame([(u, s, 1.0) for u in (1, 2, 3) for s in (u * 10, u * 10 + 1)], UI)
    told = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "user_id long, song_id long, seq long")
    created = spark.createDataFrame([(20, datetime(2024, 1, 1)), (21, datetime(2024, 1, 2))], "song_id long, created_at timestamp_ntz")
    got = sorted((r.user_id, r.place, r.song_id, r.source) for r in history.latest_items(ui, told, created).collect())
    assert got == [(1, 1, 6, "history"), (1, 2, 5, "history"), (2, 1, 21, "created"), (2, 2, 20, "created"), (3, 1, 30, "order"), (3, 2, 31, "order")]


def test_explanations(spark):
    a = spark.createDataFrame([(1, 1, 1.0, 7), (1, 2, 0.4, 8)], "user_id long, song_id long, score double, primary_seed long")
    b = spark.createDataFrame([(1, 2, 1.0, [3, 4])], "user_id long, song_id long, score double, seeds array<long>")
    got = {(r.channel, r.song_id): r.because for r in hybrid.explained({"item_cf": a, "prompt_based": b}, 1).collect()}
    assert got == {("item-based CF", 1): "7", ("prompt-based", 2): "3,4"}
    named = hybrid.labelled(hybrid.blend({"item_cf": a, "prompt_based": b}), ranked_by_clicks=True).collect()
    assert {(r.song_id, r.stage, r.channel) for r in named} == {(1, "fine rank", "item-based CF"), (2, "fine rank", "prompt-based")}


def test_one_hot_of_genres(spark):
    songs = spark.createDataFrame([(1, "b", 1.0), (2, None, 2.0), (3, "a", 3.0), (4, "c", 3.0)], "song_id long, genre string, duration double")
    songs = songs.withColumns({"popularity_score": F.lit(1.0), "engagement_rate": F.lit(0.5)})
    got = {r.song_id: r for r in features.scaled_metadata(songs).collect()}
    assert {k: r.one_hot for k, r in got.items()} == {1: "010", 2: "", 3: "100", 4: "001"}
    assert got[1].z_popularity_score == 0 and got[1].z_duration < 0 < got[3].z_duration
    assert features.scaled_metadata(songs.where("false")).collect() == []


def test_tags_are_parsed_once(spark):
    from cadenza.plans.queries import tag_parse_rules
    from cadenza.sources.bindings import Tables

    class Few(Tables):
        def prompts(self):
            return spark.createDataFrame([(1, "a. bcd. efg"), (2, "x  y"), (3, None)], "song_id long, prompt string")

    got = tag_parse_rules(Few(spark, ""))
    assert sorted((r.song_id, r.n, r.genre) for r in got.collect()) == [(1, 3, "a"), (2, 2, "x"), (3, 0, "unknown")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 3  # at commas, full stops and white space


def test_playlist_entries_go_to_tasks_in_proportion(spark, tmp_path, monkeypatch):
    from cadenza.operators import interactions
    from cadenza.sources import bindings

    monkeypatch.setattr(bindings, "ENTRIES", 50)
    lines = [(i % 90, i * 7 % 40) for i in range(1000)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i,) for i in range(80)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    t = bindings.Tables(spark, str(tmp_path))
    for songs in (30, 60):  # few, and more than a task takes
        rows = t.entries(spark.range(songs).withColumnRenamed("id", "song_id"))
        assert rows.rdd.getNumPartitions() >= 20
        got = {(r.user_id, r.song_id): r.weight for r in interactions.from_playlists(rows).collect()}
        want = {}
        for o, s in lines:
            if o < 80 and s < songs:
                want[o, s] = want.get((o, s), 0.0) + 1.0
        assert got == want


def test_blended_rows_stay_where_their_user_is(spark):
    """Blended rows, with their maps, were dealt by user and song, by song and by user."""
    import re

    from cadenza.operators import hybrid

    rows = spark.createDataFrame([(u, s, 1.0 / (1 + u + s)) for u in range(6) for s in range(8)], "user_id long, song_id long, score double")
    quality = spark.createDataFrame([(s, s / 7) for s in range(7)], "song_id long, quality_score double")
    channels = {"item_cf": rows.where("song_id < 6"), "user_based": rows.where("song_id > 3")}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        best = hybrid.recommend(channels, quality, 3)
        plan = best._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert not re.search(r"hashpartitioning\(user_id#\w+, song_id#", plan)
    assert len(re.findall(r"Exchange hashpartitioning\(user_id#", plan)) == 1
    want = {}
    for u in range(6):
        found = []
        for s in range(8):
            q, parts = (s / 7 if s < 7 else 0.3), ([0.25] if s < 6 else []) + ([0.25] if s > 3 else [])
            if q >= 0.3:
                found.append((-round(sum(round(w / (1 + u + s), 8) for w in parts), 8), s))
        want[u] = [s for _, s in sorted(found)[:3]]
    got = {u: [r.song_id for r in sorted(best.where(f"user_id = {u}").collect(), key=lambda r: r["rank"])] for u in range(6)}
    assert got == want
