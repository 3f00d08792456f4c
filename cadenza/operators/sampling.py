"""Weighted draws without a row for each user and song.

With replacement: an alias table. Each of n songs has a slot of equal size; a song whose weight is below
the mean leaves the rest of its slot to one heavier song. Who fills whose slot follows from two running sums,
of what light songs lack and of what heavy ones have over, laid on one line: a light song is filled by
the heavy one whose stretch holds its start, and a heavy song that a light one overdraws is itself
filled by the next. Sums are integers, so the table is exact and does not depend on partitions. A
draw is one equi-join with a slot.

Without replacement: a user's songs are those with the least keys, exponential draws with the songs' weights as
rates. Songs are put in classes by powers of two of their weight. In a class, keys with the class's upper
rate come in order from a few draws each (order statistics) and fall on random places of the class; a key is
then kept with the song's share of that rate, else delayed by another draw, which gives it exactly the
song's own rate. Only keys up to a time by which enough are to be expected are made; users for whom they are
not enough get twice the time until nobody is short. Keys are not made once enough of those before are sure. What a user likes more than others is a second process over the classes of those
genres alone; the earlier key of a song counts. So rows are in proportion to the draws.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import uniform
from cadenza.sources.scratch import following, placed, stored, sums_before

UNITS = 2**40  # of weight 1
EXACT = "decimal(38,0)"
NEARLY_HALF = 0.4999  # of a class's rate, which its songs have but for rounding
MOST_CELLS = 1 << 16  # classes of genres that every task is sent


def alias_table(weights: DataFrame) -> DataFrame:
    """(slot, song_id, keep, other) for weights (song_id, p) with p from 0 to 1: a draw of a slot, each as
    likely, is song_id with probability keep, else other. Nulls and weights below 0 count as 0; if
    all are 0, songs are equally likely."""
    songs = placed(weights.where("song_id IS NOT NULL").select("song_id", F.round(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(0.0)) * UNITS).cast("long").alias("w")), "song_id", out="slot")
    total = songs.agg(F.count("*").alias("n"), F.greatest(F.sum("w"), F.lit(0)).cast(EXACT).alias("all"))
    songs = songs.join(F.broadcast(total)).withColumn("own", F.when(F.col("all") > 0, F.col("w").cast(EXACT) * F.col("n")).otherwise(0).cast(EXACT))
    over = (F.col("own") - F.col("all")).cast(EXACT)
    sums = sums_before(songs.withColumn("over", over), "slot", lack=F.greatest(-over, F.lit(0)).cast(EXACT), spare=F.greatest(over, F.lit(0)).cast(EXACT))
    sums = stored(sums.withColumns({"lack_end": (F.col("lack") + F.greatest(-F.col("over"), F.lit(0))).cast(EXACT), "spare_end": (F.col("spare") + F.greatest("over", F.lit(0))).cast(EXACT)}), "sums")
    # On one line: where heavy songs are used up, where light ones start, and where these end.
    heavy = sums.where("over > 0").select(F.col("spare_end").alias("at"), F.lit(0).alias("kind"), "slot", F.col("song_id").alias("heavy"), F.lit(None).cast(EXACT).alias("end"))
    light = sums.where("over < 0")
    starts = light.select(F.col("lack").alias("at"), F.lit(1).alias("kind"), "slot", F.lit(None).cast(dict(sums.dtypes)["song_id"]).alias("heavy"), F.lit(None).cast(EXACT).alias("end"))
    ends = light.select(F.col("lack_end").alias("at"), F.lit(2).alias("kind"), "slot", F.lit(None).cast(dict(sums.dtypes)["song_id"]).alias("heavy"), F.col("lack_end").alias("end"))
    line = following(heavy.unionByName(starts).unionByName(ends), "at", "kind", "slot", other=F.col("heavy"), drawn=F.col("end")).where("kind < 2")
    met = sums.join(line.select("slot", "at", "kind", "other", "drawn"), "slot", "left")
    left = F.when(F.col("kind") == 0, F.col("all") - (F.coalesce("drawn", F.col("at")) - F.col("at"))).when(F.col("kind") == 1, F.col("own")).otherwise(F.col("all"))
    keep = F.when(F.col("all") > 0, left.cast("double") / F.col("all").cast("double")).otherwise(1.0)
    return met.select("slot", "song_id", keep.alias("keep"), F.coalesce("other", F.col("song_id")).alias("other"))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to all tasks by a hash: rows that are small but much work would else be put together in few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def draws(table: DataFrame, users: DataFrame, m: int, seed: str) -> DataFrame:
    """(user_id, d, song_id): m draws with replacement for each user from an alias table."""
    n = table.agg(F.count("*").alias("n"))
    rows = spread(users.select("user_id"), "user_id").select("user_id", F.explode(F.sequence(F.lit(1), F.lit(m))).alias("d")).join(F.broadcast(n))
    rows = rows.select("user_id", "d", F.floor(uniform(f"{seed}/slot", "user_id", "d") * F.col("n")).cast("long").alias("slot"), uniform(f"{seed}/side", "user_id", "d").alias("u"))
    return rows.join(table, "slot").select("user_id", "d", F.when(F.col("u") < F.col("keep"), F.col("song_id")).otherwise(F.col("other")).alias("song_id"))


def _keys(rate: np.ndarray, size: np.ndarray, until: float, seed: list[int], k: int = 0, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the classes the keys up to a time, in order: class, place (distinct and random), time, and two more draws for
    each, by which it is kept or delayed. A class that has keys takes its draws from a stream of its own, so that a
    later time only adds to them. k: keys that come after k songs are sure to have theirs are not made; a song,
    start and place, has half its class's rate at least, so a first draw below that keeps its key, and a delay is bounded."""
    heads = np.random.default_rng(seed).exponential(size=len(rate)) / (rate * size)
    some = np.flatnonzero(heads <= until)
    some = some[np.argsort(heads[some], kind="stable")]
    heap, streams = list(zip(heads[some].tolist(), some.tolist(), strict=True)), {}  # what is in order is a heap
    which, places, times, first, second = [], [], [], [], []
    sure, of = [], {}  # by when songs have their keys, in order, and for each
    while heap:
        t, c = heap[0]
        if k and len(sure) >= k and t > sure[k - 1]:
            break
        if c not in streams:
            streams[c] = [np.random.default_rng([*seed, c]), 0, {}, int(size[c]), float(rate[c])]
        stream, i, moved, n, r = streams[c]
        j = int(stream.integers(i, n))
        place, u, v = moved.get(j, j), stream.random(), stream.random()
        moved[j] = moved.get(i, i)
        which.append(c)
        places.append(place)
        times.append(t)
        first.append(u)
        second.append(v)
        if k:
            song, by = int(start[c]) + place, t if u < NEARLY_HALF else t - math.log1p(-v) / (NEARLY_HALF * r)
            if (old := of.get(song)) is None or by < old:
                if old is not None:
                    del sure[bisect_left(sure, old)]
                of[song] = by
                insort(sure, by)
        streams[c][1] = i = i + 1
        after = t + stream.exponential() / (r * (n - i)) if i < n else math.inf
        if i < n and after <= until:
            heapreplace(heap, (after, c))
        else:
            heappop(heap)
    return np.array(which, np.int64), np.array(places, np.int64), np.array(times, np.float64), np.array(first, np.float64), -np.log1p(-np.array(second, np.float64))


def _time(rate: np.ndarray, size: np.ndarray, wanted: float) -> float:
    """By when so many keys, or a twentieth less, are to be expected; infinite if that is nearly all."""
    if wanted >= size.sum() - 0.5:
        return float("inf")
    t = 0.0
    for _ in range(200):  # Newton's steps come from below: what is expected by a time grows ever slower
        left = np.exp(-rate * t)
        short = wanted - float((size * (1 - left)).sum())
        if short <= 0.05 * wanted:
            break
        t += short / float((size * rate * left).sum())
    return t


def draw_without_replacement(songs: DataFrame, users: DataFrame, likes: DataFrame, seed: int = 42) -> DataFrame:
    """(user_id, song_id, draw): for users (user_id, k) the k songs (song_id, genre, p), or all if they are fewer, that
    successive draws without replacement give, with weights p * (1 + liking), where likes (user_id,
    genre, liking) has what a user likes some genres more than others, 0 or more. Songs with
    p of 0 or less, or null, are never drawn. Ids are integers."""
    spark = users.sparkSession
    classed = songs.where("p > 0 AND song_id IS NOT NULL").withColumn("class", F.floor(F.log2("p")).cast("int"))
    lined = stored(placed(classed.select("class", F.coalesce("genre", F.lit("")).alias("genre"), F.col("genre").isNull().alias("none"), "song_id", "p"), "class", "genre", "none", "song_id"), "lined")
    cells = lined.groupBy("class", "genre", "none").agg(F.min("i").alias("first"), F.count("*").alias("size"))
    classes = [tuple(r) for r in cells.groupBy("class").agg(F.min("first"), F.sum("size")).orderBy("class").collect()]  # 2,100 powers of two at most
    if not classes:
        return spark.createDataFrame([], "user_id long, song_id long, draw long")
    # A user's liked genres go to tasks by number, and the cells of all genres to every task, while these are few.
    known = cells.where("NOT none").select("genre", "class", "first", "size")
    few = cells.count() <= MOST_CELLS
    held = sorted(map(tuple, known.collect())) if few else []
    genres = sorted({x[0] for x in held})
    liked = likes.where("liking > 0 AND genre IS NOT NULL").select(F.col("user_id").cast("long").alias("user_id"), "genre", F.col("liking").cast("double").alias("liking"))
    if few:
        numbers = spark.createDataFrame(list(zip(genres, range(len(genres)), strict=True)), "genre string, g long")
        liked = liked.join(F.broadcast(numbers), "genre").select("user_id", F.struct("g", "liking").alias("x"))
    else:
        liked = liked.join(known, "genre").select("user_id", F.struct(F.col("class").cast("long").alias("class"), "first", "size", "liking").alias("x"))
    own = liked.groupBy("user_id").agg(F.collect_list("x").alias("own"))
    asked = stored(users.where("k > 0 AND user_id IS NOT NULL").select(F.col("user_id").cast("long").alias("user_id"), F.col("k").cast("int").alias("k")).join(own, "user_id", "left"), "asked")
    cell = np.array([x[1:] for x in held], np.int64).reshape(-1, 3)
    bounds = np.searchsorted(np.array([x[0] for x in held], object), np.array(genres, object)) if genres else np.zeros(0, np.int64)
    bounds = np.append(bounds, len(held))

    def generate(times: int):
        def more_of(values: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
            """(class, first, size) and liking of a user's cells, in their order."""
            liking = values.field("liking").to_numpy(zero_copy_only=False)
            if few:
                g = values.field("g").to_numpy(zero_copy_only=False)
                n = bounds[g + 1] - bounds[g]
                at = np.repeat(bounds[g] - np.cumsum(n) + n, n) + np.arange(n.sum())
                more, liking = cell[at], np.repeat(liking, n)
            else:
                more = np.stack([values.field(x).to_numpy(zero_copy_only=False) for x in ("class", "first", "size")], axis=1)
            order = np.lexsort((liking, more[:, 1], more[:, 0]))
            return more[order], liking[order]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, first, size = (np.array(x, np.int64) for x in zip(*classes, strict=True))
            for b in batches:
                rows, count = [], 0
                for at_row, (user, k) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                    own = b.column(2)[at_row].values
                    more, liking = more_of(own) if own is not None and len(own) else (np.zeros((0, 3), np.int64), np.zeros(0))
                    factor = np.append(np.ones(len(c)), liking)
                    rate = factor * 2.0 ** (np.append(c, more[:, 0]) + 1)
                    start, sizes = np.append(first, more[:, 1]), np.append(size, more[:, 2])
                    until = _time(rate, sizes, (2 * k + 12) * 2.0**times)
                    # Where equal song ids made one song of two, the next round makes more, and all if that is all.
                    which, places, at, u, late = _keys(rate, sizes, until, [seed, user % 2**64], 0 if times or math.isinf(until) else k, start)
                    n = len(which)
                    rows.append((np.full(n, user), np.full(n, k, np.int32), np.full(n, until), start[which] + places, at, factor[which], u, late))
                    count += n
                    if count >= 20_000:
                        yield packed(rows)
                        rows, count = [], 0
                if rows:
                    yield packed(rows)

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=["user_id", "k", "until", "i", "at", "factor", "u", "late"])

        return run

    done, left, times = None, asked, 0
    while True:
        dealt = left.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id")  # small rows, much work
        made = dealt.mapInArrow(generate(times), "user_id long, k int, until double, i long, at double, factor double, u double, late double")
        share = F.col("p") / F.pow(F.lit(2.0), F.col("class") + 1)
        key = F.when(F.col("u") < share, F.col("at")).otherwise(F.col("at") + F.col("late") / (F.col("p") * F.col("factor")))
        # Dealt by user at once: hardly any song comes twice, and a user's rows are put in order next.
        met = made.join(lined.select("i", "song_id", "p", "class"), "i").select("user_id", "song_id", key.alias("key"), "until", "k").repartition("user_id")
        keyed = met.groupBy("user_id", "song_id").agg(F.min("key").alias("key"), F.first("until").alias("until"), F.first("k").alias("k"))
        place = F.row_number().over(W.partitionBy("user_id").orderBy("key", "song_id")).cast("long")
        # Keys after `until` are not all known; before it they are.
        found = stored(keyed.where(F.col("key") <= F.col("until")).withColumn("draw", place).where(F.col("draw") <= F.col("k")), "draws")
        ready = found.groupBy("user_id").agg(F.count("*").alias("n"), F.first("k").alias("k"), F.first("until").alias("until")).where("n = k OR until = double('Infinity')").select("user_id")
        part = found.join(ready, "user_id", "left_semi").select("user_id", "song_id", "draw")
        done = part if done is None else done.unionByName(part)
        left, times = stored(left.join(ready, "user_id", "left_anti"), "left"), times + 1
        if left.isEmpty():
            return done
