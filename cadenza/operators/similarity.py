"""Cosine similarity of items or users over interactions: all pairs (topk.py has the best only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import r6


def cosine(ui: DataFrame, of: str, over: str) -> DataFrame:
    """(a, b, sim) for all a <> b of column `of` that share a value of `over`.

    A sparse matrix product: pairs a < b meet on the shared key, their products are
    summed with map-side partial sums, and each pair is mirrored once after that."""
    norms = ui.groupBy(of).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    known = ui.join(norms, of)  # norms travel with the few interactions, not with the many pairs
    side = lambda x: known.select(F.col(over).alias("k"), F.col(of).alias(x), F.col("weight").alias(f"w{x}"), F.col("norm").alias(f"n{x}"))
    pairs = side("a").join(side("b"), "k").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    sims = pairs.select("a", "b", r6(F.col("dot") / (F.col("na") * F.col("nb"))).alias("sim"))
    both = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return sims.select(both.alias("p"), "sim").select("p.a", "p.b", "sim")


def top(df: DataFrame, k: int, by: list[str], score: str, tie: str, rank: str = "rank") -> DataFrame:
    """The k rows of each group with the highest score, ties by the least id."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), tie))
    return df.withColumn(rank, place.cast("long")).where(F.col(rank) <= k)
