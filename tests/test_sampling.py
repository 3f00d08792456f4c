"""Alias tables and draws by class against their weights."""

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import sampling, simulate
from cadenza.sources.scratch import following, placed, sums_before


def shares(rows):
    """The exact probability of each song from an alias table."""
    out = Counter()
    for r in rows:
        keep = Fraction(r.keep)
        out[r.song_id] += keep / len(rows)
        out[r.other] += (1 - keep) / len(rows)
    return out


@pytest.mark.parametrize("case", ["equal", "one", "steep", "zeros", "random", "few heavy", "one heavy"])
def test_alias_table_has_the_weights(spark, case):
    random.seed(case)
    w = {"equal": [1.0] * 50, "one": [1.0], "steep": [2.0**-i for i in range(60)], "zeros": [0.0, 3.0, 0.0, 1.0, 0.0], "random": [random.random() ** 4 for _ in range(300)], "few heavy": [0.001] * 90 + [5.0, 7.0, 6.5], "one heavy": [1.0] + [1e-9] * 40}[case]
    p = [x / sum(w) for x in w]
    table = sampling.alias_table(spark.createDataFrame([(10 * i, x) for i, x in enumerate(p)], "song_id long, p double")).collect()
    assert sorted(r.slot for r in table) == list(range(len(p))) and all(0 <= r.keep <= 1 for r in table)
    got = shares(table)
    assert all(abs(got[10 * i] - x) <= len(p) * 2**-40 for i, x in enumerate(p))


def test_alias_special_inputs(spark):
    frame = lambda rows: spark.createDataFrame(rows, "song_id long, p double")
    assert sampling.alias_table(frame([])).collect() == []
    odd = shares(sampling.alias_table(frame([(1, None), (2, -1.0), (3, 0.5), (None, 0.5)])).collect())
    assert {k: v for k, v in odd.items() if v} == {3: 1}
    assert set(shares(sampling.alias_table(frame([(1, 0.0), (2, 0.0)])).collect()).values()) == {Fraction(1, 2)}
    assert simulate.impressions(frame([]), spark.range(3).withColumnRenamed("id", "user_id")).collect() == []


def test_impressions_follow_the_weights_by_one_equi_join(spark):
    p = [0.5, 0.25, 0.125, 0.0625, 0.0625]
    weights = spark.createDataFrame(list(enumerate(p)), "song_id long, p double")
    users = spark.range(4000).withColumnRenamed("id", "user_id")
    drawn = sampling.draws(sampling.alias_table(weights), users, 5, "x")
    n = {r.song_id: r["count"] for r in drawn.groupBy("song_id").count().collect()}
    assert sum((n[i] - 20_000 * x) ** 2 / (20_000 * x) for i, x in enumerate(p)) < 25  # chi-squared, four degrees
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan.split("BroadcastNestedLoopJoin BuildRight, Inner")[-1] and "Cartesian" not in plan


def test_order_helpers_do_not_depend_on_ranges(spark):
    random.seed(1)
    rows = [(random.randrange(10**6), random.choice([None, i])) for i in range(500)]
    rows = list({a: (a, b) for a, b in rows}.values())
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    order = sorted(rows)
    assert {r.a: r.i for r in placed(df, "a").collect()} == {a: i for i, (a, _) in enumerate(order)}
    sums = {r.a: r.s for r in sums_before(df, "a", s=F.coalesce("b", F.lit(0)).cast("long")).collect()}
    assert sums == {a: sum(b or 0 for _, b in order[:i]) for i, (a, _) in enumerate(order)}
    next_ = {r.a: r.n for r in following(df, "a", n=F.col("b")).collect()}
    assert next_ == {a: next((b for _, b in order[i + 1 :] if b is not None), None) for i, (a, _) in enumerate(order)}


SONGS = [(i, "rock" if i % 3 == 0 else "pop" if i % 3 == 1 else None, x) for i, x in enumerate([0.3, 0.2, 0.11, 0.1, 0.09, 0.07, 0.06, 0.04, 0.02, 0.01])]


def drawn(spark, users, k, likes=((1, "rock", 1.5), (1, "jazz", 2.0), (1, None, 9.0))):
    """likes: of user 1, given to all."""
    songs = spark.createDataFrame([*SONGS, (90, "pop", 0.0), (91, "pop", None), (None, "pop", 0.4)], "song_id long, genre string, p double")
    everyone = spark.range(users).select(F.col("id").alias("user_id"), F.lit(k).alias("k"))
    liked = spark.createDataFrame(list(likes), "user_id long, genre string, liking double").drop("user_id").crossJoin(everyone.select("user_id"))
    return sampling.draw_without_replacement(songs, everyone, liked)


def test_draws_by_class_are_successive_draws(spark):
    """First draws and ordered pairs have the probabilities of draws one after the other."""
    w = {i: p * (2.5 if g == "rock" else 1.0) for i, g, p in SONGS}
    total, n = sum(w.values()), 12_000
    rows = drawn(spark, n, 3).collect()
    first = Counter(r.song_id for r in rows if r.draw == 1)
    assert sum((first[i] - n * x / total) ** 2 / (n * x / total) for i, x in w.items()) < 35  # nine degrees
    by = {}
    for r in sorted(rows, key=lambda r: r.draw):
        by.setdefault(r.user_id, []).append(r.song_id)
    assert all(len(set(x)) == 3 for x in by.values()) and len(by) == n
    pairs = Counter((x[0], x[1]) for x in by.values())
    chi = sum((pairs[a, b] - e) ** 2 / e for a in w for b in w if a != b and (e := n * w[a] / total * w[b] / (total - w[a])) >= 5)
    assert chi < 150  # about 80 degrees


def test_draws_by_class_agree_with_a_row_for_each_user_and_song(spark):
    songs = spark.createDataFrame(SONGS, "song_id long, genre string, p double")
    users, k = 4000, 4
    old = spark.range(users).withColumnRenamed("id", "user_id").crossJoin(songs.select("song_id", (F.col("p") * F.when(F.col("genre") == "rock", 2.5).otherwise(1.0)).alias("w")))
    a = Counter(r.song_id for r in simulate.without_replacement(old, k).collect())
    b = Counter(r.song_id for r in drawn(spark, users, k).collect())
    assert all(abs(a[i] - b[i]) < 5 * math.sqrt(users) for i, _, _ in SONGS)


def test_draws_are_the_same_again_and_take_all_if_there_are_few(spark, monkeypatch):
    one, two = (sorted(map(tuple, drawn(spark, 60, 5).collect())) for _ in range(2))
    assert one == two
    all_ = drawn(spark, 20, 50).collect()
    assert Counter(r.user_id for r in all_) == {u: len(SONGS) for u in range(20)}
    assert drawn(spark, 5, 0).collect() == []
    # A first time that is far too short: rounds go on from the same draws.
    real = sampling._time
    monkeypatch.setattr(sampling, "_time", lambda rate, size, wanted: real(rate, size, wanted / 40))
    assert sorted(map(tuple, drawn(spark, 60, 5, ()).collect())) == sorted(map(tuple, drawn(spark, 60, 5, ()).collect()))


def test_rows_are_in_proportion_to_draws(spark):
    for n in (10**3, 10**6):
        rate, size = 2.0 ** -np.arange(10), np.full(10, n)
        until = sampling._time(rate, size, 52)
        assert len(sampling._keys(rate, size, until, [1, 2])[0]) < 110


def test_following_values_take_one_pass(spark):
    from cadenza.sources.scratch import following

    values = [None if i % 7 else i for i in range(500)]
    df = spark.createDataFrame([((i * 37) % 500, values[(i * 37) % 500]) for i in range(500)], "i long, x long")
    got = following(df, "i", y=df["x"])
    want = {i: next((x for x in values[i + 1 :] if x is not None), None) for i in range(500)}
    assert {r.i: r.y for r in got.collect()} == want
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()


def test_keys_end_once_enough_songs_are_sure():
    """What is left out comes after the k songs that come first, however fates and shares fall."""
    rng = np.random.default_rng(5)
    for user in range(200):
        start, size, k = np.array([0, 40, 90, 40, 90]), np.array([40, 50, 300, 7, 60]), int(rng.integers(1, 30))
        factor = np.array([1, 1, 1, 0.7, 1.5])
        rate = factor * 2.0 ** np.array([-3, -4, -5, -4, -5])
        share = 0.5 + 0.5 * rng.random(390)
        until = sampling._time(rate, size, 2 * k + 12)
        first, made = [], []
        for keys in (sampling._keys(rate, size, until, [3, user]), sampling._keys(rate, size, until, [3, user], k, start)):
            which, places, at, u, late = keys
            best = {}
            for c, i, t, x, y in zip(which, start[which] + places, at, u, late, strict=True):
                key = t if x < share[i] else t + y / (share[i] * rate[c])
                best[i] = min(best.get(i, math.inf), key)
            first.append(sorted((t, i) for i, t in best.items() if t <= until)[:k])
            made.append(len(which))
        assert first[0] == first[1] and made[1] <= made[0]
    assert made[1] < made[0]


def test_draws_do_not_depend_on_how_cells_travel(spark, monkeypatch):
    few = sorted(map(tuple, drawn(spark, 40, 4).collect()))
    monkeypatch.setattr(sampling, "MOST_CELLS", 0)
    assert sorted(map(tuple, drawn(spark, 40, 4).collect())) == few
