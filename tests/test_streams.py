"""Keyed state of streams under replays, late rows and empty inputs, against loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cadenza import streaming
from cadenza.operators.history import weekly_mix

EVENT = "event_id long, user_id long, song_id long, ts timestamp_ntz, weight double"
START = datetime(2024, 1, 1)


def events(seed, n, days=35):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(9)]), START + timedelta(minutes=rng.randrange(days * 1440)), 0.5 * (i % 3)) for i in range(n)]
    return [*rows, (n, 3, 1, None, 1.0)]


def fed(spark, folder, batches, run):
    """The stream of some files, each of which is a run of its own."""
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(spark.readStream.schema(EVENT).parquet(f"{folder}/in")).awaitTermination()


def test_last_rows_under_replays_and_late_rows(spark, tmp_path):
    rows = events(1, 400)
    shuffled = random.Random(2).sample(rows, len(rows))
    batches = [shuffled[:150], shuffled[100:300], shuffled[250:], shuffled[:50]]  # overlaps are replays
    fed(spark, tmp_path, batches, lambda s: streaming.keep_last(s, f"{tmp_path}/out", 7))
    got = sorted(tuple(r) for r in streaming.last_rows(spark, f"{tmp_path}/out").select("user_id", "event_id", "song_id", "ts", "weight").collect())
    want = []
    for user in (1, 2, 3):
        mine = sorted((r for r in rows if r[1] == user and r[3]), key=lambda r: (r[3], r[2] is not None, r[2] or 0, r[0]))
        want += [(r[1], r[0], r[2], r[3], r[4]) for r in mine[-7:]]
    assert [g[1] for g in got] == [w[1] for w in sorted(want)] and len(got) == 21
    assert {g[1:] for g in got} == {w[1:] for w in want}


def test_many_rows_of_one_user_in_one_batch(spark, tmp_path):
    rows = [(i, 1, i % 50, START + timedelta(seconds=(i * 7919) % 20_000), 1.0) for i in range(20_000)]
    fed(spark, tmp_path, [rows], lambda s: streaming.keep_last(s, f"{tmp_path}/out", 20))
    got = {r.ts for r in streaming.last_rows(spark, f"{tmp_path}/out").collect()}
    assert got == {START + timedelta(seconds=k) for k in range(19_980, 20_000)}


def test_weekly_lists_against_weekly_mix(spark, tmp_path):
    rows = [(r[0], r[1], r[2] or 0, r[3], r[4]) for r in events(3, 300) if r[3]]
    rows.sort(key=lambda r: r[3])
    rng = random.Random(4)
    cuts = [rows[:80], rows[70:200], rows[200:]]  # replays
    for c in cuts:
        rng.shuffle(c)
    fed(spark, tmp_path, cuts, lambda s: streaming.weekly_lists(s, f"{tmp_path}/out", 6, "2 days"))
    got = {(r.user_id, r.week_end, r.place, r.song_id, r.ts, r.event_id) for r in spark.read.parquet(f"{tmp_path}/out/lists").collect()}
    seen = spark.createDataFrame([(r[1], r[2], r[3], r[4], r[0]) for r in rows if r[1]], "user_id long, song_id long, ts timestamp_ntz, weight double, event_id long")
    want, last = set(), max(r[3] for r in rows)
    for week in range(1, 6):
        end = START + timedelta(days=7 * week)
        if end > last - timedelta(days=2):
            continue
        before = seen.where(F.col("ts") < F.lit(end))
        before = before.withColumn("seq", F.expr("row_number() over (partition by user_id order by ts, song_id, event_id)").cast("long"))
        active = {r[1] for r in rows if end - timedelta(days=7) <= r[3] < end}
        by = {(r.user_id, r.seq): r for r in before.collect()}
        want |= {(r.user_id, end, r.place, r.song_id, by[r.user_id, r.seq].ts, by[r.user_id, r.seq].event_id) for r in weekly_mix(before, str(end - timedelta(days=1)), 6).collect() if r.user_id in active}
    assert want and got == want


def test_streams_of_nothing(spark, tmp_path):
    assert streaming.current(spark, f"{tmp_path}/none").count() == 0
    fed(spark, tmp_path, [[(1, None, 1, START, 1.0), (2, 1, 1, None, 1.0)]], lambda s: streaming.keep_last(s, f"{tmp_path}/out", 5))
    assert streaming.current(spark, f"{tmp_path}/out").count() == 0


def test_weeks_of_one_user_are_values_of_their_own(spark, tmp_path):
    rows = [(i, 1, i % 7, START + timedelta(hours=12 * i), None if i % 2 else 1.0) for i in range(70)]  # five weeks
    fed(spark, tmp_path, [rows], lambda s: streaming.keep_last(s, f"{tmp_path}/last", 70))
    fed(spark, tmp_path, [rows], lambda s: streaming.weekly_lists(s, f"{tmp_path}/weeks", 70, "1 day"))
    state = lambda f: spark.read.format("statestore").option("stateVarName", "rows").load(f"{tmp_path}/{f}/checkpoint")
    assert [len(r.user_map_value["list"]) for r in state("last").collect()] == [70]  # one value, not one for each row
    assert sorted(len(r.user_map_value["list"]) for r in state("weeks").collect()) == [14, 56]  # weeks that are over are one
    assert streaming.last_rows(spark, f"{tmp_path}/weeks").count() == 70
