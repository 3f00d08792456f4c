"""Connected components as Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored, tidy

CHUNK = 1 << 18  # edges that a task looks at together


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node that it reaches) that join what the edges join, one at most for each node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while (least[a] != least[b]).any():
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (least[least] != least).any():
            least = least[least]
    moved = least != np.arange(len(nodes))
    return nodes[moved], nodes[least[moved]]


def _contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """Fewer edges (u, v) or as many, v < u, that join the same nodes: those a task reads become stars, a chunk of
    them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        batch = lambda u, v: pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        for b in batches:
            us.append(b.column(0).to_numpy())
            vs.append(b.column(1).to_numpy())
            held += b.num_rows
            if held >= chunk:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                if len(u) > chunk // 2:
                    yield batch(u, v)
                    u, v = u[:0], v[:0]
                us, vs, held = [u], [v], len(u)
        yield batch(*forest(np.concatenate(us), np.concatenate(vs)))
        release()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _stars(e: DataFrame) -> bool:
    """Whether each node of edges (u, v) either points to one other or is pointed to."""
    ends = e.select(F.col("u").alias("x"), "v").unionByName(e.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("v")))
    nodes = ends.groupBy("x").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.isnull("v")).alias("met"))
    return not nodes.where("low < high OR (met AND low IS NOT NULL)").agg(F.count("*")).first()[0]


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, comp) for each node of edges (a, b): comp is the least node reachable.

    Large-star and small-star steps (Kiveris et al., 2014): each node's neighbours
    are pointed at the least of them until all point at the component's least node. Before each
    step tasks make stars of the edges that they read, so few steps or none are left.
    A step is a minimum for each node, which Spark combines before the shuffle, and
    a join, whose skew (a node with very many neighbours) is left to AQE; each round is
    written to the shared folder. No edges: no rows."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct(), "edges")
    while True:
        e = stored(_contracted(e, chunk), "edges")
        if _stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
        tidy(edges.sparkSession)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
