"""Readers, features, history and streams on small fixtures."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cadenza import streaming
from cadenza.operators import evaluation, features, history, quality, similarity
from cadenza.service import Recommender
from cadenza.sources import catalog

SONGS = [
    {"id": "a", "title": "A", "user_id": "u1", "created_at": "2024-01-20T10:00:00+02:00", "audio_url": "x", "play_count": 10, "upvote_count": 4, "comment_count": 1, "display_tags": "EDM", "metadata": {"tags": "Pop, Rock ,,pop", "prompt": "[Verse 1]\nla la\n[chorus]\nhey\n[Bridge]", "duration": 60.0}},
    {"id": "b", "handle": "h", "created_at": "garbage", "play_count": 0, "metadata": {"tags": "Dreamy house. A slow build. ab"}},
    {"title": "none"},
    {"id": "c", "display_name": "d", "metadata": {"tags": "lofi chill beats"}},
    {"id": "d", "metadata": None},
    {"id": "e", "user_id": "", "metadata": {"tags": "x" * 60}},
]


@pytest.fixture
def songs(spark, tmp_path):
    for name, data in (("list", SONGS), ("object", {"songs": SONGS}), ("bad", {"x": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    return tmp_path


def test_aggregated_catalog(spark, songs):
    for name in ("list", "object"):
        rows = {r.song_id: r for r in catalog.aggregated(catalog.raw_songs(spark, f"{songs}/{name}.json")).collect()}
        assert sorted(rows) == ["a", "b", "c", "d", "e"]
        assert [rows[k].user_id for k in "abcde"] == ["u1", "h", "d", "unknown_user_3", "unknown_user_4"]
        assert rows["b"].tags == ["Dreamy house", "A slow build"] and rows["c"].tags == ["lofi", "chill", "beats"]
        assert rows["d"].tags == [] and rows["d"].genre == "unknown" and rows["e"].genre == "x" * 50
        assert rows["a"].engagement_rate == 0.4 and rows["b"].engagement_rate == 0
    assert catalog.aggregated(catalog.raw_songs(spark, f"{songs}/list.json"), 2).count() == 2
    with pytest.raises(Exception, match="neither a list"):
        catalog.raw_songs(spark, f"{songs}/bad.json").collect()


def test_catalog_of_lines(spark, songs):
    with open(f"{songs}/list.json") as f, open(f"{songs}/list.jsonl", "w") as out:
        out.writelines(json.dumps(x) + "\n" for x in json.load(f))
    whole, lines = (catalog.raw_songs(spark, f"{songs}/list.{kind}") for kind in ("json", "jsonl"))
    assert whole.columns == lines.columns
    key = lambda df: sorted(map(str, df.collect()))
    assert key(whole) == key(lines)
    assert key(catalog.aggregated(whole, 3)) == key(catalog.aggregated(lines, 3))


def test_processed_catalog(spark, songs):
    df = catalog.processed(catalog.raw_songs(spark, f"{songs}/list.json"), "2024-01-24 10:00:00")
    catalog.save_processed(df, f"{songs}/out")
    rows = {r.song_id: r for r in catalog.load_processed(spark, f"{songs}/out").collect()}
    a = rows["a"]
    assert a.tags == ["edm", "pop", "rock"] and a.genre == "pop" and a.created_at == datetime(2024, 1, 20, 8)
    assert (a.verse_count, a.chorus_count, a.bridge_count, a.has_structure, a.days_since_creation, a.is_recent) == (1, 1, 1, True, 4, True)
    assert rows["b"].created_at is None and rows["b"].genre is None
    with pytest.raises(FileNotFoundError):
        catalog.load_processed(spark, f"{songs}/nowhere")


def test_playlists(spark, tmp_path):
    p = {"id": "1", "user_handle": "h", "song_ids": ["a", "b"]}
    nested = {"result": {"playlist": {"result": [{"id": "2", "playlist_clips": [{"clip": {"id": "z"}}]}]}}}
    for name, data, want in (("list", [p], ["a", "b"]), ("keyed", {"playlists": [p]}, ["a", "b"]), ("any", {"x": [p], "y": [p], "n": 1}, ["a", "b", "a", "b"]), ("nested", nested, ["z"])):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
        got = catalog.playlist_entries(catalog.playlists(spark, f"{tmp_path}/{name}.json")).collect()
        assert [r.song_id for r in got] == want


def test_history_embeddings_and_scores(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"user_history": {"u": [{"song_id": "a", "timestamp": "2024-01-01T00:00:00"}, {"song_id": "b", "weight": 2.0, "type": "like"}]}, "last_update": None}))
    (tmp_path / "bad.json").write_text("no json")
    rows = catalog.history(spark, f"{tmp_path}/h.json").orderBy("seq").collect()
    assert [(r.song_id, r.weight, r.type, r.seq) for r in rows] == [("a", 1.0, "play", 1), ("b", 2.0, "like", 2)]
    assert catalog.history(spark, f"{tmp_path}/bad.json").count() == 0
    (tmp_path / "e.json").write_text(json.dumps({"a": [1.0, 2.0]}))
    assert catalog.embeddings(spark, f"{tmp_path}/e.json").collect()[0].embedding == [1.0, 2.0]
    (tmp_path / "q.json").write_text(json.dumps({"a": {"overall_quality_score": 0.1}, "b": {"scores": {"overall_quality_score": 0.2}}, "c": {"overall_recommendation_score": 0.3}, "d": {"scores": {"overall_recommendation_score": 0.4}}, "e": {}}))
    assert {r.song_id: r.quality_score for r in catalog.stored_scores(spark, f"{tmp_path}/q.json").collect()} == {"a": 0.1, "b": 0.2, "c": 0.3, "d": 0.4}


def test_cosine_by_hand(spark):
    ui = spark.createDataFrame([(u, s, 1.0) for u, songs in {"u1": "abc", "u2": "ab", "u3": "cd", "u4": "e"}.items() for s in songs], "user_id string, song_id string, weight double")
    got = {(r.a, r.b): r.sim for r in similarity.cosine(ui, "song_id", "user_id").collect()}
    assert got["a", "b"] == got["b", "a"] == 1 and got["a", "c"] == got["b", "c"] == 0.5 and got["c", "d"] == pytest.approx(0.707107)
    assert not any("e" in k for k in got)


def test_metrics_by_hand(spark):
    rec = spark.createDataFrame([("u", s, i + 1) for i, s in enumerate("abcde")], "user_id string, song_id string, rank long")
    rel = spark.createDataFrame([("u", "a"), ("u", "d"), ("u", "x"), ("v", "a")], "user_id string, song_id string")
    got = {r.user_id: r for r in evaluation.ranking_metrics(rec, rel, (5,)).collect()}
    assert (got["u"].precision, got["u"].recall, got["u"].map) == (0.4, 0.666667, 0.75)
    assert got["u"].ndcg == pytest.approx((1 + 1 / 2.321928) / (1 + 1 / 1.584963 + 0.5), abs=1e-6)
    assert (got["v"].precision, got["v"].ndcg, got["v"].map) == (0, 0, 0)


def test_weekly_mix_by_hand(spark):
    rows = [("old", f"s{i}", datetime(2024, 1, 1 + i), i) for i in range(6)]
    rows += [("mix", f"s{i}", datetime(2024, 1, 10 + i), i) for i in range(5)] + [("mix", f"t{i}", datetime(2024, 1, 23, i), 5 + i) for i in range(3)]
    df = spark.createDataFrame([(u, s, t, 1.0, q) for u, s, t, q in rows], "user_id string, song_id string, ts timestamp_ntz, weight double, seq long")
    got = {}
    for r in history.weekly_mix(df, "2024-01-24 10:00:00", 4).orderBy("place").collect():
        got.setdefault(r.user_id, []).append(r.song_id)
    # The cap of four leaves one old row and three new ones to the mixed user.
    assert got == {"old": ["s5", "s4", "s3", "s2"], "mix": ["t2", "t1", "s4"]}


def test_answers(spark):
    texts = ['ok {"production_quality": 1.5, "content_enjoyment": 0.25}', "production quality: 0.8", "nothing", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(*(c.alias(n) for n, c in quality.parsed_answer("text").items())).collect()
    assert [r.production_quality for r in got] == [1.0, 0.8, 0.5, 0.5] and got[0].content_enjoyment == 0.25


def test_feature_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "vec array<double>")
    assert [r.vec for r in features.item_features(df, 3).collect()] == [[0.6, 0.8, 0.0], [0.0, 0.0, 0.0]]
    m = spark.createDataFrame([({"b": [3.0], "a": [1.0, 2.0]},)], "m map<string,array<double>>")
    assert m.select(features.audio_vector("m")).first()[0] == [1.0, 2.0, 3.0]


def test_streamed_history(spark, tmp_path):
    from datetime import timedelta

    start = datetime(2024, 1, 1)
    events = lambda k: spark.createDataFrame([("u", f"s{k}{i}", start + timedelta(days=k, hours=i), None, None) for i in range(4)], streaming.EVENT)
    for k in range(2):
        events(k).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(streaming.EVENT).json(f"{tmp_path}/in")
        q = streaming.maintain(stream, f"{tmp_path}/out", 5)
        q.awaitTermination()
    rows = streaming.current(spark, f"{tmp_path}/out").orderBy("seq").collect()
    assert [r.song_id for r in rows] == ["s03", "s10", "s11", "s12", "s13"] and {r.weight for r in rows} == {1.0}


def test_service(spark):
    songs = spark.createDataFrame([(i, f"t{i}", ["x"], "g", 10.0 - i) for i in range(5)], "song_id long, title string, tags array<string>, genre string, popularity_score double")
    sims = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.5), (1, 2, 0.4)], "a long, b long, sim double")
    hist = spark.createDataFrame([(9, 0, 1)], "user_id long, song_id long, seq long")
    r = Recommender(songs, sims, songs.select("song_id", F.lit(0.5).alias("quality_score")), hist)
    assert [x.song_id for x in r.recommend(9).orderBy("rank").collect()] == [1, 2]
    assert [x.song_id for x in r.recommend(song_ids=[1]).collect()] == [2]
    assert [x.b for x in r.similar(0, 1).collect()] == [1] and r.info()["songs"] == 5
    # A user with songs of a session, exclusions, and someone of whom nothing is known.
    assert [x.song_id for x in r.recommend(9, song_ids=[1]).collect()] == [2]
    assert [x.song_id for x in r.recommend(9, exclude_song_ids=[1]).collect()] == [2]
    assert [x.song_id for x in r.recommend(77, n=2, exclude_song_ids=[0]).orderBy("rank").collect()] == [1, 2]
    likes = spark.createDataFrame([(9, 0, 1.0), (8, 0, 1.0), (8, 3, 1.0)], "user_id long, song_id long, weight double")
    every = hist.unionByName(spark.createDataFrame([(8, 0, 1), (8, 3, 2)], "user_id long, song_id long, seq long"))
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (4, [1.0, 0.1])], "song_id long, vec array<double>")
    r = Recommender(songs, sims, r.quality, every, user_sims=spark.createDataFrame([(9, 8, 0.7)], "a long, b long, sim double"), likes=likes, vectors=vectors)
    assert {x.song_id: x.primary_channel for x in r.recommend(9).collect()} == {1: "item_cf", 2: "item_cf", 3: "user_based", 4: "content"}
    with pytest.raises(ValueError):
        r.recommend()


def test_refresh_once_a_week(spark, tmp_path):
    from cadenza.__main__ import due

    assert due(spark, str(tmp_path), "2024-01-24 08:00:00")
    spark.sql("SELECT timestamp_ntz '2024-01-22 08:00:00' AS at").write.parquet(f"{tmp_path}/refreshed")
    assert not due(spark, str(tmp_path), "2024-01-24 08:00:00") and due(spark, str(tmp_path), "2024-01-29 08:00:00")
