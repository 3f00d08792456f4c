"""Pruned top-k similarity against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import channels, topk

UI = "user_id long, song_id long, weight double"


def all_pairs(rows, k, cosine=True):
    items, norm = {}, {}
    for u, s, w in rows:
        items.setdefault(s, {})[u] = w
        norm[s] = norm.get(s, 0) + w * w
    out = set()
    for a, x in items.items():
        met = []
        for b, y in items.items():
            dot = sum(w * y[u] for u, w in x.items() if u in y)
            score = round(dot / (norm[a] ** 0.5 * norm[b] ** 0.5) + 1e-12, 6) if cosine else dot
            if a != b and score > 0:
                met.append((-score, b))
        out |= {(a, b, -s, i + 1) for i, (s, b) in enumerate(sorted(met)[:k])}
    return out


def rows_of(seed, users, songs, hot=()):
    random.seed(seed)
    pairs = {(random.randrange(users), int(random.random() ** 2 * songs)) for _ in range(users * 6)}
    pairs |= {(1000 + i, s) for i, size in enumerate(hot) for s in random.sample(range(songs), size)}
    return [(u, s, float(random.choice([1, 1, 2, 5]))) for u, s in sorted(pairs)]


def found(df):
    return {tuple(r) for r in df.select("a", "b", "sim", "rank").collect()}


@pytest.mark.parametrize(("light", "products"), [(1024, 1 << 21), (12, 1 << 21), (3, 1 << 21), (1024, 300), (12, 100), (0, 100)])
@pytest.mark.parametrize("cosine", [True, False])
def test_against_all_pairs(spark, light, products, cosine):
    rows = rows_of(light + products, 60, 90, hot=(80, 60, 30))
    got = found(topk.top_similar(spark.createDataFrame(rows, UI), "song_id", "user_id", 4, cosine, light, products))
    assert got == all_pairs(rows, 4, cosine)


def test_small_matrices_and_blocks(spark, monkeypatch):
    for name, value in (("CELLS", 64), ("BLOCK_ITEMS", 5), ("BLOCK_ENTRIES", 20), ("TILE", 2)):
        monkeypatch.setattr(topk, name, value)
    rows = rows_of(7, 40, 50, hot=(45, 40, 40, 40))
    df = spark.createDataFrame(rows, UI)
    assert found(topk.top_similar(df, "song_id", "user_id", 3, light=6)) == all_pairs(rows, 3)
    assert found(topk.top_similar(df, "user_id", "song_id", 3, light=5)) == all_pairs([(s, u, w) for u, s, w in rows], 3)


def test_halves_round_up_and_ties_go_to_the_least_id(spark):
    # 64 users have song 1, and six of them another song that 255 strangers share: 1 / (8 * 16) = 0.0078125
    rows = [(u, 1, 1.0) for u in range(64)] + [(u, 2 + u, 1.0) for u in range(6)] + [(1000 * (u + 1) + i, 2 + u, 1.0) for u in range(6) for i in range(255)]
    for light in (1024, 1):
        got = found(topk.top_similar(spark.createDataFrame(rows, UI), "song_id", "user_id", 3, light=light))
        assert {r for r in got if r[0] == 1} == {(1, 2, 0.007813, 1), (1, 3, 0.007813, 2), (1, 4, 0.007813, 3)}


def test_a_user_with_all_songs_makes_few_pairs(spark, monkeypatch):
    """Songs in groups that many light users share: what one user with all songs adds is never
    enough, so no blocks meet and only pairs inside groups are looked at again."""
    groups, size = 100, 6
    rows = [(g * 40 + i, g * size + s, 1.0) for g in range(groups) for i in range(40) for s in range(size) if (i + s) % 8]
    rows += [(-1, s, 1.0) for s in range(groups * size)]
    made, blocks = [], []
    sums, pairs = topk._with_heavy, topk.block_pairs
    monkeypatch.setattr(topk, "_with_heavy", lambda light, *a: (made.append(light.where("more").count()), sums(light, *a))[1])
    monkeypatch.setattr(topk, "block_pairs", lambda *a: (blocks.append(pairs(*a).count()), pairs(*a))[1])
    monkeypatch.setattr(topk, "BLOCK_ITEMS", 50)
    got = found(topk.top_similar(spark.createDataFrame(rows, UI), "song_id", "user_id", 3, light=100))
    assert got == all_pairs(rows, 3)
    assert made == [groups * size * (size - 1)] and blocks == [0]  # of 359,400 pairs


def test_ids_that_are_texts(spark):
    rows = rows_of(3, 20, 25)
    df = spark.createDataFrame(rows, UI).select(F.format_string("u%05d", "user_id").alias("user_id"), F.format_string("s%05d", "song_id").alias("song_id"), "weight")
    got = {(int(a[1:]), int(b[1:]), s, r) for a, b, s, r in found(topk.top_similar(df, "song_id", "user_id", 3))}
    assert got == all_pairs(rows, 3)


def test_special_inputs(spark):
    empty = spark.createDataFrame([], UI)
    assert topk.top_similar(empty, "song_id", "user_id", 3).collect() == []
    lone = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0), (None, 2, 1.0), (3, None, 1.0), (1, 3, 0.0)], UI)
    assert topk.top_similar(lone, "song_id", "user_id", 3).collect() == []
    with pytest.raises(ValueError):
        topk.top_similar(spark.createDataFrame([(1, 1, -1.0)], UI), "song_id", "user_id", 3)


def test_co_liked_shares(spark):
    rows = rows_of(5, 30, 30)
    got = {(r.a, r.b, r.score, r["rank"]) for r in channels.co_liked(spark.createDataFrame(rows, UI), 4).collect()}
    want = all_pairs([(u, s, 1.0) for u, s, _ in rows], 4, cosine=False)
    best = {a: n for a, _, n, i in want if i == 1}
    assert got == {(a, b, round(n / best[a], 6), i) for a, b, n, i in want}


def test_lists_go_to_few_blocks_where_neighbours_in_id_are_liked_together(spark, monkeypatch):
    rows = [(g * 10 + u, g * 10 + s, 1.0 + (u + s) % 3) for g in range(40) for u in range(10) for s in range(10)]
    made, parts = [], topk._parts_of
    monkeypatch.setattr(topk, "_parts_of", lambda *a: (made.append(parts(*a).count()), parts(*a))[1])
    assert found(topk.top_similar(spark.createDataFrame(rows, UI), "song_id", "user_id", 3, products=500)) == all_pairs(rows, 3)
    assert made[0] <= 400 * 3  # of 400 lists, in 80 blocks


@pytest.mark.parametrize(("light", "products"), [(1024, 300), (12, 100), (1024, 1 << 21)])
def test_blocks_take_turns(spark, monkeypatch, light, products):
    """All lists lay on disk at a time, however many there were."""
    turns, take = [], topk.in_turns
    monkeypatch.setattr(topk, "in_turns", lambda n, *a: (turns.append(n), take(n, *a))[1])
    monkeypatch.setattr(topk, "TURN", 2000)
    rows = rows_of(11, 60, 90, hot=(80, 60, 30))
    for cosine in (True, False):
        assert found(topk.top_similar(spark.createDataFrame(rows, UI), "song_id", "user_id", 4, cosine, light, products)) == all_pairs(rows, 4, cosine)
    assert min(turns) > 1


def test_lists_are_sent_in_few_bytes(spark, monkeypatch):
    """An entry took 32 bytes in each block that its list was sent to."""
    made, parts = [], topk._parts_of
    monkeypatch.setattr(topk, "_parts_of", lambda *a: (made.append(parts(*a).agg(F.sum(F.length("data"))).first()[0]), parts(*a))[1])
    random.seed(2)
    rows = [(u, s, 1.0) for u in range(400) for s in random.sample(range(5000), 30)]
    assert found(topk.top_similar(spark.createDataFrame(rows, UI), "song_id", "user_id", 3)) == all_pairs(rows, 3)
    assert made[0] <= 400 * 30 * 4


def test_packed_numbers_are_what_they_were():
    for x in ([], [5], [2**62, -(2**63), 2**63 - 1, 0], [7, 7, 7], list(range(-300, 300))):
        for kind in (np.int32, np.int64):
            if kind is np.int64 or not x or max(map(abs, x)) < 2**31:
                out = topk._unpacked(memoryview(topk._packed(np.array(x, kind), np.arange(3))), 2)
                assert out[0].tolist() == x and out[1].tolist() == [0, 1, 2]
    for x in ([0.5, 2.0], [1.0, 40.0], [1e300, 3.0], [2.0**53, 1.0], [3.0]):
        assert topk._unpacked(memoryview(topk._packed(np.array(x))), 1)[0].tolist() == x


def test_promising_scores_hold_the_best_of_each_group():
    rng = np.random.default_rng(3)
    for slack in (0.0, 1e-3):
        for _ in range(40):
            k, sizes = int(rng.integers(1, 4)), rng.choice([1, 2, 9, 30, 100], 12)
            raw, starts = rng.integers(0, rng.choice([2, 5, 1000]), sizes.sum()).astype(float), np.cumsum(sizes) - sizes
            ok = topk._promising(starts, sizes, raw, k, slack)
            for i, n in zip(starts, sizes, strict=True):
                assert ok[i + np.argsort(-raw[i : i + n], kind="stable")[:k]].all()
