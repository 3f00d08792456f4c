"""Click-rate ranking with attention over history, training sets and losses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import r6
from cadenza.sources.scratch import stored

from .history import last_n


ENTRIES = 1 << 17  # ids of candidates and histories in a bucket, about


class Din:
    """Weights of the attention and click-rate networks: small arrays."""

    def __init__(self, size: int, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        layer = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a), np.zeros(b))
        self.attention = [layer(2 * size, 64), layer(64, 32), layer(32, 1)]
        self.click = [layer(2 * size, 128), layer(128, 64), layer(64, 1)]

    @staticmethod
    def run(layers, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(layers):
            x = x @ w + b
            if i < len(layers) - 1:
                x = np.maximum(x, 0)
        return x[..., 0]

    def rate(self, candidates: np.ndarray, history: np.ndarray) -> np.ndarray:
        """Click rates of candidates [c, d] for one history [h, d]."""
        c, h = len(candidates), len(history)
        pairs = np.concatenate([np.broadcast_to(history[None], (c, h, history.shape[1])), np.broadcast_to(candidates[:, None], (c, h, candidates.shape[1]))], axis=2)
        a = self.run(self.attention, pairs)
        a = np.exp(a - a.max(axis=1, keepdims=True))
        interest = (a / a.sum(axis=1, keepdims=True)) @ history
        return 1 / (1 + np.exp(-self.run(self.click, np.concatenate([interest, candidates], axis=1))))


def click_rates(candidates: DataFrame, history: DataFrame, vectors: DataFrame, model: Din, last: int = 50) -> DataFrame:
    """(user_id, song_id, ctr); 0.5 without a history or vector. A user's candidates (a
    recall stage's, in up to 16 lists) meet the history (last n) as one row of ids and are
    scored by one call. Vectors are sent once to each bucket of users that asks for them."""
    spark = candidates.sparkSession
    known = last_n(history.join(vectors.select("song_id"), "song_id", "left_semi"), last)
    lists = known.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "song_id"))), lambda x: x["song_id"].cast("long")).alias("hist"))
    met = candidates.select("user_id", "song_id").groupBy("user_id", F.pmod(F.xxhash64("song_id"), F.lit(16)).alias("part")).agg(F.collect_list(F.col("song_id").cast("long")).alias("c")).join(lists, "user_id", "left")
    met = stored(met.select(F.col("user_id").cast("long").alias("user_id"), "c", F.coalesce("hist", F.array().cast("array<bigint>")).alias("hist")), "asked")
    entries = met.agg(F.coalesce(F.sum(F.size("c") + F.size("hist")), F.lit(0))).first()[0]
    buckets = max(-(-entries // ENTRIES), 2 * spark.sparkContext.defaultParallelism)
    met = met.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)))
    asked = met.select(F.col("bucket").alias("b"), F.explode(F.array_union("c", "hist")).alias("song_id")).distinct()
    asked = asked.join(vectors.select(F.col("song_id").cast("long").alias("song_id"), "vec"), "song_id")
    shared = spark.sparkContext.broadcast(model)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("song_id")
        ids, vec, out = right["song_id"].to_numpy(), right["vec"].combine_chunks().flatten().to_numpy().reshape(right.num_rows, -1), []
        for user, c, h in zip(*(left[x] for x in ("user_id", "c", "hist")), strict=True):
            c, h = c.values.to_numpy(), h.values.to_numpy()
            at = np.minimum(np.searchsorted(ids, c), max(0, len(ids) - 1))
            ctr, known = np.full(len(c), 0.5), ids[at] == c if len(ids) else np.zeros(len(c), bool)
            if known.any() and len(h):
                ctr[known] = shared.value.rate(vec[at[known]], vec[np.searchsorted(ids, h)])
            out.append((np.full(len(c), user.as_py()), c, ctr))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(cols, names=["user_id", "song_id", "ctr"])

    left, right = (df.repartition(buckets, b).groupBy(b) for df, b in ((met, "bucket"), (asked, "b")))
    return left.cogroup(right).applyInArrow(run, "user_id long, song_id long, ctr double").withColumn("ctr", r6("ctr"))


def ranked(rates: DataFrame, excludes: DataFrame, n: int = 10) -> DataFrame:
    """The n best by click rate, exclusions first."""
    from .similarity import top

    return top(rates.join(excludes.select("user_id", "song_id"), ["user_id", "song_id"], "left_anti"), n, ["user_id"], "ctr", "song_id")


def tower_examples(positives: DataFrame, negatives: DataFrame, k: int = 10, last: int = 8) -> DataFrame:
    """(user_id, song_id, recent, negatives): for each positive the user's last
    positives and up to k negatives. Users need both kinds."""
    recent = last_n(positives, last).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "song_id"))), lambda x: x["song_id"]).alias("recent"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy("song_id"))
    few = negatives.withColumn("n", place).where(F.col("n") <= k).groupBy("user_id").agg(F.array_sort(F.collect_list("song_id")).alias("negatives"))
    return positives.select("user_id", "song_id").join(recent, "user_id").join(few, "user_id")


def din_examples(events: DataFrame, history: DataFrame, last: int = 50) -> DataFrame:
    """(user_id, song_id, label, hist, size): labelled songs with the user's last songs,
    without the song itself if it is positive, filled with null up to `last`. Rows
    without a history stay only if negative."""
    lists = last_n(history, last + 1).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "song_id"))), lambda x: x["song_id"]).alias("all"))
    met = events.join(lists, "user_id", "left").withColumn("all", F.coalesce("all", F.array().cast("array<bigint>")))
    own = F.when(F.col("label") == 1, F.array_remove("all", F.col("song_id"))).otherwise(F.col("all"))
    met = met.withColumn("hist", F.slice(own, F.greatest(F.lit(1), F.size(own) - last + 1), F.lit(last)))
    met = met.withColumn("size", F.size("hist")).where("size > 0 OR label = 0")
    return met.select("user_id", "song_id", "label", F.concat("hist", F.array_repeat(F.lit(None).cast("bigint"), F.lit(last) - F.col("size"))).alias("hist"), "size")


def infonce(scores: DataFrame, temperature: float = 0.1) -> DataFrame:
    """(user_id, song_id, loss) from (user_id, song_id, label, score): each positive
    against the user's negatives."""
    neg = scores.where("label = 0").groupBy("user_id").agg(F.sum(F.exp(F.col("score") / temperature)).alias("others"))
    e = F.exp(F.col("score") / temperature)
    return scores.where("label = 1").join(neg, "user_id").select("user_id", "song_id", r6(-F.ln(e / (e + F.col("others")))).alias("loss"))


def bpr(scores: DataFrame) -> DataFrame:
    """(user_id, song_id, loss): the mean of ln(1 + e^-(positive - negative))."""
    pos = scores.where("label = 1").select("user_id", "song_id", F.col("score").alias("p"))
    pairs = pos.join(scores.where("label = 0").select("user_id", F.col("score").alias("q")), "user_id")
    return pairs.groupBy("user_id", "song_id").agg(r6(F.avg(F.log1p(F.exp(F.col("q") - F.col("p"))))).alias("loss"))
