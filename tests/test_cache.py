"""Results kept by fingerprint, and exports of history and embeddings."""

import pytest
from pyspark.sql import functions as F

from cadenza.sources import cache, catalog
from cadenza.sources.scratch import new_folder

ROWS = [(i, f"s{i}" if i % 4 else None, i / 3) for i in range(200)] + [(7, "s7", 7 / 3)] * 3
KIND = "k long, name string, x double"


def test_fingerprint_sees_rows_but_not_their_order(spark):
    df = spark.createDataFrame(ROWS, KIND)
    p = cache.fingerprint(df, "a")
    assert p == cache.fingerprint(spark.createDataFrame(ROWS[::-1], KIND).repartition(7), "a") == cache.fingerprint(df.select("x", "name", "k"), "a")
    others = [ROWS[:-1], [*ROWS, ROWS[0]], [(0, "", 0.0), *ROWS[1:]], [(1, None, 0.0), (0, "s1", 1 / 3), *ROWS[2:]], []]
    found = [cache.fingerprint(spark.createDataFrame(r, KIND), "a") for r in others] + [cache.fingerprint(df, "b"), cache.fingerprint(df.withColumnRenamed("x", "y"), "a"), cache.fingerprint(df.withColumn("k", F.col("k").cast("int")), "a")]
    assert len({p, *found}) == 1 + len(found)


def test_cached_results_are_made_once_and_never_stale(spark):
    folder, made = new_folder(spark, "test"), []

    def compute(df):
        made.append(1)
        return df.groupBy("name").agg(F.sum("x").alias("x"))

    df = spark.createDataFrame(ROWS, KIND)
    one = {tuple(r) for r in cache.cached(df, folder, compute, 1).collect()}
    assert one == {tuple(r) for r in cache.cached(df.orderBy(F.desc("k")), folder, compute, 1).collect()} and len(made) == 1
    changed = df.withColumn("x", F.when(F.col("k") == 5, 99.0).otherwise(F.col("x")))
    two = {r.name: r.x for r in cache.cached(changed, folder, compute, 1).collect()}
    assert two["s5"] == 99.0 and len(made) == 2
    cache.cached(df, folder, compute, 2)
    assert len(made) == 3


def test_a_result_that_was_cut_short_does_not_count(spark):
    folder, df = new_folder(spark, "test"), spark.createDataFrame(ROWS, KIND)
    with pytest.raises(Exception, match="division|DIVIDE"):
        cache.cached(df, folder, lambda d: d.select(F.raise_error(F.lit("division")).cast("int").alias("x")))
    assert cache.cached(df, folder, lambda d: d.select("k")).count() == len(ROWS)


def test_only_changed_buckets_are_computed(spark):
    folder, seen = new_folder(spark, "test"), []

    def compute(df):
        seen.append(df.count())
        return df.select("k", "name", (F.col("x") * 2).alias("y"))

    def check(df):
        got = sorted(map(str, cache.cached_rows(df, folder, ["k"], compute, "v1", buckets=16).collect()))
        assert got == sorted(map(str, df.select("k", "name", (F.col("x") * 2).alias("y")).collect()))

    df = spark.createDataFrame(ROWS, KIND)
    check(df)
    check(df.repartition(5))
    assert seen == [203]
    check(df.where("k <> 9"))  # a row goes
    check(df.unionByName(spark.createDataFrame([(900, "new", 1.0)], KIND)))  # a row comes
    assert len(seen) == 3 and all(0 < n < 50 for n in seen[1:])
    check(df)  # as before: nothing to do
    assert len(seen) == 3
    assert cache.cached_rows(spark.createDataFrame([], KIND), folder, ["k"], compute, "v1", buckets=16).collect() == []


def test_history_and_embeddings_come_back(spark):
    rows = [(f"u{u}", f'song "{s}" é', s, None if s == 3 else 0.5 * s, "play" if s % 2 else "like") for u in range(30) for s in range(1, 5)]
    df = spark.createDataFrame(rows, "user_id string, song_id string, seq long, weight double, type string").withColumn("ts", F.expr("timestamp_ntz'2024-01-02 03:04:05.123456' + make_interval(0, 0, 0, cast(seq as int))"))
    path = new_folder(spark, "test")
    catalog.save_history(df, path, keys_per_file=4)
    want = df.withColumn("weight", F.coalesce("weight", F.lit(1.0)))  # the reader's default
    names = ["user_id", "song_id", "ts", "weight", "type", "seq"]
    assert len(catalog.history(spark, path).inputFiles()) > 3
    assert sorted(map(str, catalog.history(spark, path).select(*names).collect())) == sorted(map(str, want.select(*names).collect()))
    vectors = spark.createDataFrame([(f"s{i}", [0.1 * i, -1.5]) for i in range(25)], "song_id string, embedding array<float>")
    path = new_folder(spark, "test")
    catalog.save_embeddings(vectors, path, keys_per_file=10)
    assert sorted(map(str, catalog.embeddings(spark, path).collect())) == sorted(map(str, vectors.collect()))
    path = new_folder(spark, "test")
    catalog.save_history(df.limit(0), path)
    assert spark.read.text(path).count() == 0
