"""Published versions, requests that read one bucket, and training that repeats itself."""

import json
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import channels, training
from cadenza.service import Recommender
from cadenza.sources import registry

FOLDER = "/root/testdata/sf0.001"
SIM = "a long, b long, sim double"


def test_one_bucket_is_read(spark, tmp_path):
    likes = spark.createDataFrame([(u, s, 1.0) for u in range(40) for s in range(u % 7)] + [(None, 1, 1.0)], "user_id long, song_id long, weight double")
    registry.bucketed(likes, "user_id", f"{tmp_path}/likes", 8)
    table = spark.read.parquet(f"{tmp_path}/likes")
    assert table.count() == likes.count()
    for user in (5, 6, 39, 77):
        found = registry.rows_of(table, "user_id", [user])
        assert sorted(r.song_id for r in found.collect()) == list(range(user % 7 if user < 40 else 0))
        plan = found._jdf.queryExecution().executedPlan().toString()
        filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
        assert re.search(r"\(bucket_of_8#\d+ = \d\)", filters[1]) and "EqualTo(user_id," in filters[2]
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        leaf.executeColumnar().getNumPartitions()
        assert leaf.metrics().apply("numPartitions").value() <= 1
    assert sorted({r.user_id for r in registry.rows_of(table, "user_id", [5, 6, 77]).collect()}) == [5, 6]
    assert registry.rows_of(table, "user_id", []).count() == 0
    names = spark.createDataFrame([("x", 1), ("y", 2)], "user_id string, n int")
    registry.bucketed(names, "user_id", f"{tmp_path}/names", 8)
    assert [r.n for r in registry.rows_of(spark.read.parquet(f"{tmp_path}/names"), "user_id", ["y"]).collect()] == [2]
    assert [r.n for r in registry.rows_of(names, "user_id", ["x"]).collect()] == [1]


def test_versions(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(ValueError):
        registry.current(spark, folder)
    of = lambda x: {"facts": (spark.createDataFrame([(1, x)], "a long, x long"), "a")}
    assert registry.publish(spark, folder, of(10), {"weights": {"item_cf": 2.0}}, 4) == 1
    before = registry.current(spark, folder)[0]["facts"]
    # Tables of a version that was not finished are not seen.
    registry.bucketed(of(99)["facts"][0], "a", f"{folder}/tables-lost/facts", 4)
    assert registry.current(spark, folder)[0]["facts"].first().x == 10
    assert registry.publish(spark, folder, of(20), buckets=4) == 2
    assert registry.current(spark, folder)[0]["facts"].first().x == 20 and before.first().x == 10
    assert registry.back_to(spark, folder, 1) == 3
    tables, facts = registry.current(spark, folder)
    assert tables["facts"].first().x == 10 and facts == {"weights": {"item_cf": 2.0}}
    with pytest.raises(ValueError):
        registry.back_to(spark, folder, 8)


def test_loaded_recommender(spark, tmp_path):
    songs = spark.createDataFrame([(i, f"t{i}", ["x"], "g", 10.0 - i) for i in range(6)], "song_id long, title string, tags array<string>, genre string, popularity_score double")
    tables = {
        "catalog": songs, "quality": songs.select("song_id", F.lit(0.5).alias("quality_score")),
        "item_sims": spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.5), (1, 2, 0.4)], SIM), "user_sims": spark.createDataFrame([(9, 8, 0.7)], SIM),
        "history": spark.createDataFrame([(9, 0, 1), (8, 0, 1), (8, 3, 2)], "user_id long, song_id long, seq long"),
        "likes": spark.createDataFrame([(9, 0, 1.0), (8, 0, 1.0), (8, 3, 1.0)], "user_id long, song_id long, weight double"),
        "tower_lists": spark.createDataFrame([(9, 4, 0.8), (8, 5, 0.9)], "user_id long, song_id long, score double"),
        "tower_sims": spark.createDataFrame([(0, 5, 0.6)], "a long, b long, score double"),
        "co_liked": spark.createDataFrame([(0, 3, 1.0)], "a long, b long, score double"),
    }
    weights = {"item_cf": 0.5, "user_based": 0.25, "two_tower": 0.25}
    registry.publish(spark, str(tmp_path), Recommender.tables(**tables), {"weights": weights}, 4)
    served, given = Recommender.load(spark, str(tmp_path)), Recommender(**tables, weights=weights)
    for ask in ({"user_id": 9}, {"user_id": 9, "exclude_song_ids": [1]}, {"song_ids": [0]}, {"user_id": 77, "n": 2}, {"user_id": 9, "song_ids": [1], "n": 2}):
        rows = lambda r, ask=ask: sorted((x["rank"], x.song_id, x.fine_score, x.primary_channel) for x in r.recommend(**ask).collect())
        assert rows(served) == rows(given) != []
    assert {x.song_id: x.primary_channel for x in served.recommend(9).collect()} == {1: "item_cf", 2: "item_cf", 3: "user_based", 4: "two_tower"}
    assert {x.song_id: x.primary_channel for x in served.recommend(song_ids=[0]).collect()}[5] == "two_tower"
    assert {x.b for x in served.similar(0).collect()} == {1, 2, 3, 5} and served.info()["weights"] == weights
    assert [tuple(r) for r in served.user_row(8).orderBy("song_id").collect()] == [(0, 1.0), (3, 1.0)]


def test_training_repeats_itself(spark, tmp_path):
    """Bit for bit the same towers however examples are spread, and songs as numpy ranks them."""
    rng = np.random.default_rng(4)
    vec = {i: rng.standard_normal(4) for i in range(30)}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in vec.items()], "song_id long, vec array<double>")
    plays = spark.createDataFrame([(u, (u * 7 + k) % 30) for u in range(50) for k in range(6)], "user_id long, song_id long")
    shown = spark.createDataFrame([(u, (u * 7 + 6 + k) % 30) for u in range(50) for k in range(12)], "user_id long, song_id long")
    users = spark.createDataFrame([(u, rng.standard_normal(4).tolist()) for u in range(50)], "user_id long, vec array<double>")
    nets = []
    for tasks in (1, 5):
        examples = training.with_vectors(plays.repartition(tasks), shown, users, vectors).repartition(tasks)
        assert examples.count() == 300 and all(len(r.others) == 10 for r in examples.select("others").collect())
        chunks = training.packed(examples, training.TOWER, ["user_id", "song_id"], f"{tmp_path}/{tasks}", 16)
        got, losses = training.fit_towers(chunks.repartition(tasks), 4, epochs=4, hidden=(8, 4))
        nets.append(training._flat(got))
    assert (nets[0] == nets[1]).all() and losses[-1] < losses[0]
    songs = vectors.select("song_id", training.tower(got[1])("vec").alias("vec"))
    found = channels.towers(users.select("user_id", training.tower(got[0])("vec").alias("vec")), songs, plays, 3)
    encode = lambda net, x: training.unit(training.forward(net, x)[0])[0]
    items = encode(got[1], np.stack([vec[i] for i in range(30)]))
    known = {}
    for r in plays.collect():
        known.setdefault(r.user_id, set()).add(r.song_id)
    best = {}
    for r in found.collect():
        best.setdefault(r.user_id, {})[r["rank"]] = (r.song_id, r.score)
    for u in users.collect():
        score = np.round(items @ encode(got[0], np.array([u.vec]))[0], 6)
        want = sorted((-s, i) for i, s in enumerate(score) if i not in known[u.user_id])[:3]
        assert [best[u.user_id][k + 1][1] for k in range(3)] == pytest.approx([-s for s, _ in want], abs=2e-6)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_refresh_and_ask(spark, tmp_path, capsys):
    """The weekly refresh trains the towers and publishes what requests are served from."""
    from cadenza.__main__ import main

    main(["refresh", FOLDER, str(tmp_path)])
    served = Recommender.load(spark, f"{tmp_path}/served")
    user = served.tower_lists.agg(F.min("user_id")).first()[0]
    main(["ask", str(tmp_path), "--user", str(user), "-n", "5"])
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["rank"] for x in lines] == [1, 2, 3, 4, 5] and len({x["song_id"] for x in lines}) == 5


def test_click_examples_and_training(spark, tmp_path):
    """Histories in their order without songs that have no vector; the model is the same bit for bit
    however examples are spread."""
    vec = {i: [float(i), 1.0] for i in range(6)}
    vectors = spark.createDataFrame(list(vec.items()), "song_id long, vec array<double>")
    rows = [(u, u % 6, u % 2, [3, 99, u % 5, None]) for u in range(40)] + [(50, 77, 1, [1]), (51, 1, 0, [99])]
    examples = spark.createDataFrame(rows, "user_id long, song_id long, label int, hist array<long>")
    found = training.with_histories(examples, vectors)
    assert {(r.user_id, r.song_id, r.label, tuple(map(tuple, r.history)), tuple(r.candidate)) for r in found.collect()} == {
        (u, s, y, tuple(tuple(vec[i]) for i in h[:3] if i in vec), tuple(vec[s])) for u, s, y, h in rows if u < 50}
    models = []
    for tasks in (1, 4):
        chunks = training.packed(found, training.CLICK, ["user_id", "song_id"], f"{tmp_path}/{tasks}", 8).repartition(tasks)
        model, losses = training.fit_din(chunks, 2, epochs=3)
        models.append(training._flat([model.attention, model.click]))
    assert (models[0] == models[1]).all() and losses[-1] < losses[0]
