"""Embedding near-duplicates by NN-descent.

Equal vectors of a label form a class, which is compared once. A neighbour graph
over the classes starts from random-hyperplane orders: in each table vectors are sorted
by the signs of their projections and then by one more projection, and neighbours in
that order are compared, so a bucket of any size is split as far as it takes and
costs in proportion to it. The graph is refined by joins of neighbours of neighbours: at
each vector, the vectors of its list and of the lists it stands in are compared with one
another, and a pair goes on if it betters the list of either. Rounds end when few lists
change. Of pairs that meet the threshold none is lost: a join gives out what its vectors
are joined to by them, whether a list has room or not.

Lists hold K neighbours. One whose neighbours all meet the threshold is saturated, as
there may be more. Its neighbours are then in its component; the list is enlarged by the K
nearest outside of the component, and descent goes on with both. Two components with any
compared pair within MARGIN of the threshold are compared whole, block by block. All this
is repeated until no components are joined any more. Links of each vector are counted
within its component, block by block, so no task holds more than two blocks and only
counts leave it.

Recall is audited: the links of a uniform sample of AUDIT vectors, or five times as many where
fewer than AUDIT_LINKS of them have links, are found by brute force; what counts is how
many of those vectors have all their links inside their component. Links that leave it are kept.
More hyperplane tables are added while too few are whole. If that never ends, the vectors of each label
are compared completely, block by block; a task gives out one link for each two components it finds
joined. Where links are so rare that the second sample has fewer than AUDIT_LINKS too and none
of them is lost, at most 3 / (5 AUDIT) of all vectors (0.015 %) have a lost one, at 95 % confidence.

No task gets all members of a large component or all copies of a vector: what is said of
those is copied to SALT places that their rows are dealt to.

Results for special inputs: vectors that are null, zero, empty or hold null or
non-finite components and rows without a label link with nothing (component_id is
their own vec_id); vectors of different lengths are never compared; equal rows are
vectors of their own; a null vec_id is never a component_id unless all of a component
are null, and kept is false for it; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, temporary_tables
from .components import components

THRESHOLD = 0.93
MARGIN = 0.1
NEIGHBOURS = 6
TABLES = 16
BITS = 40
ROUNDS = 6
STEP = 3  # places along an order
BLOCK = 1000
SALT = 64
AUDIT = 4096
AUDIT_LINKS = 400  # of which 2 % are 8

log = logging.getLogger(__name__)


def _unit(column, size: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows with a class key or null; one class for each different
    vector of a label, its components as 8-byte numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v, label in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                x = v.as_py()
                ok = label is not None and bool(x) and None not in x
                x = np.array(x, np.float64) if ok else None
                out.append(x.tobytes() if ok and np.isfinite(x).all() and 0 < np.linalg.norm(x) < np.inf else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])

    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = stored(source.mapInArrow(run, "vec_id long, label string, vec binary"), "vectors")
    found = rows.where("vec IS NOT NULL").groupBy("label", "vec").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    return rows, stored(found.select(F.monotonically_increasing_id().alias("cid"), "label", "vec", F.octet_length("vec").alias("size"), "least_id", "copies"), "classes")


def _buckets(classes: DataFrame, tables: range, bits: int = BITS) -> DataFrame:
    """Compared pairs (a, b, sim) of vectors that stand near each other in an order."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            sizes = np.array(b.column(3)) // 8
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                x = _unit(part.column(2), size)
                for t in tables:
                    if (t, size) not in planes:
                        planes[t, size] = np.random.default_rng([t, size]).standard_normal((size, bits + 1))
                    far = x @ planes[t, size]
                    sig = (far[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), part.column(1), part.column(3).cast(pa.int32()), pa.array(sig, pa.int64()), pa.array(far[:, bits]), part.column(0), part.column(2)], names=["t", "label", "size", "sig", "far", "cid", "vec"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.Table | None = None
        for b in batches:
            now = pa.Table.from_batches([b])
            whole = pa.concat_tables([before.slice(max(0, len(before) - STEP)), now]) if before else now
            fresh, before = len(whole) - len(now), whole
            key = whole.select(["t", "label", "size"]).to_pandas()
            group = (key != key.shift()).any(axis=1).cumsum().to_numpy()
            cid, raw = whole["cid"].to_numpy(), whole["vec"]
            for size in np.unique(key["size"]):
                at = np.flatnonzero((key["size"] == size).to_numpy())
                x = _unit(raw.take(pa.array(at)), size // 8)
                for d in range(1, STEP + 1):
                    i = np.flatnonzero((group[at[d:]] == group[at[:-d]]) & (at[d:] >= fresh)) if len(at) > d else np.empty(0, int)
                    sim = np.einsum("ij,ij->i", x[i], x[i + d])
                    p, q = cid[at[i]], cid[at[i + d]]
                    yield _pairs(p, q, sim)

    dealt = classes.select("cid", "label", "vec", "size").mapInArrow(signed, "t int, label string, size int, sig long, far double, cid long, vec binary")
    dealt = dealt.repartitionByRange("t", "label", "size", "sig", "far", "cid").sortWithinPartitions("t", "label", "size", "sig", "far", "cid")
    return dealt.mapInArrow(near, "a long, b long, sim double").groupBy("a", "b").agg(F.first("sim").alias("sim"))


def _pairs(p: np.ndarray, q: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q), pa.int64()), pa.array(np.maximum(p, q), pa.int64()), pa.array(sim, pa.float64())], names=["a", "b", "sim"])


def _merged(*pairs: DataFrame) -> DataFrame:
    every = reduce(DataFrame.unionByName, [p.select("a", "b", "sim") for p in pairs])
    return every.groupBy("a", "b").agg(F.first("sim").alias("sim"))


def _ends(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """pairs (a, b, sim) with the components of both."""
    return pairs.join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b")


def _lists(pairs: DataFrame, comp: DataFrame, k: int) -> DataFrame:
    """The lists (u, v, sim, own) of vectors: among compared pairs the k nearest in
    their component and as many outside. comp: (cid, comp)."""
    p = _ends(pairs, comp).withColumn("own", F.col("ca") == F.col("cb"))
    both = p.select(F.col("a").alias("u"), F.col("b").alias("v"), "sim", "own").unionByName(p.select(F.col("b").alias("u"), F.col("a").alias("v"), "sim", "own"))
    return _nearest(both, k)


def _nearest(both: DataFrame, k: int) -> DataFrame:
    return both.withColumn("r", F.row_number().over(W.partitionBy("u", "own").orderBy(F.desc("sim"), "v"))).where(f"r <= {k}").drop("r")


def _join_neighbours(graph: DataFrame, classes: DataFrame, comp: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs (a, b, sim) of neighbours of a vector that better a list of theirs, and
    without sim what threshold links among them join."""
    least = lambda own: F.when(F.count_if(own) >= k, F.min(F.when(own, F.col("sim")))).otherwise(-2.0)
    worst = graph.groupBy(F.col("u").alias("v")).agg(least(F.col("own")).alias("inside"), least(~F.col("own")).alias("outside"))
    around = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "own")).groupBy("u", "v", "own").agg(F.first("sim").alias("sim"))
    known = classes.select(F.col("cid").alias("v"), "vec").join(comp.toDF("v", "comp"), "v").join(worst, "v")
    lists = _nearest(around, 2 * k).select("u", "v").join(known, "v").groupBy("u").agg(F.collect_list(F.struct("v", "comp", "inside", "outside", "vec")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                column = b.column(0).slice(i, 512)
                m, lengths = column.flatten(), np.array(column.value_lengths())
                cid, c, inside, outside = (m.field(j).to_numpy() for j in range(4))
                vec = m.field(4).to_pylist()
                starts = np.cumsum(lengths) - lengths
                size = np.array([len(vec[s]) for s in starts])
                for n, w in {(int(n), int(w)) for n, w in zip(lengths, size, strict=True) if n > 1}:
                    at = starts[(lengths == n) & (size == w)][:, None] + np.arange(n)
                    x = _matrix([vec[j] for j in at.ravel()]).reshape(len(at), n, -1)
                    sim = x @ x.transpose(0, 2, 1)
                    same = c[at][:, :, None] == c[at][:, None, :]
                    bar = np.where(same, inside[at][:, :, None], outside[at][:, :, None])
                    g, p, q = np.nonzero(np.triu(sim > np.minimum(bar, bar.transpose(0, 2, 1)), 1))
                    yield _pairs(cid[at[g, p]], cid[at[g, q]], sim[g, p, q])
                    near = (sim >= threshold) & ~same
                    first, before = np.tile(np.arange(n), (len(at), 1)), None
                    while before is None or (first != before).any():  # the first that links reach
                        before = first
                        first = np.minimum(first, np.where(near, first[:, None, :], n).min(axis=2))
                    g, p = np.nonzero(first < np.arange(n))
                    yield _pairs(cid[at[g, p]], cid[at[g, first[g, p]]], np.full(len(g), np.nan))

    return lists.select("m").mapInArrow(run, "a long, b long, sim double")


def _descend(pairs: DataFrame, classes: DataFrame, comp: DataFrame, k: int, rounds: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(lists, links) when few lists change any more."""
    graph = stored(_lists(pairs, comp, k), "graph")
    links = pairs.where(F.col("sim") >= threshold).select("a", "b")
    for _ in range(rounds):
        found = stored(_join_neighbours(graph, classes, comp, k, threshold), "found")
        links = links.unionByName(found.where("isnan(sim)").select("a", "b"))
        old = graph.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "sim")
        before = graph.select("u", "v", F.lit(True).alias("known"))
        graph = stored(_lists(_merged(old, found.where("NOT isnan(sim)")), comp, k).join(before, ["u", "v"], "left"), "graph")
        n, changed = graph.agg(F.count("*"), F.count_if(F.col("known").isNull())).first()
        graph = graph.drop("known")
        if changed <= 0.02 * n:
            break
    edges = graph.where(F.col("sim") >= threshold).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return graph, links.unionByName(edges)


def _joined(comp: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """comp (cid, comp) after links (a, b) between vectors, and how many it joined."""
    between = links.distinct().join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b").where("ca <> cb")
    to = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).toDF("comp", "to")
    out = stored(comp.join(to, "comp", "left").select("cid", F.coalesce("to", "comp").alias("comp"), F.col("to").isNotNull().alias("new")), "components")
    return out.drop("new"), out.where("new").count()


def _members(classes: DataFrame, comp: DataFrame) -> DataFrame:
    """The classes of components of two and more, with the component's size if that is
    over BLOCK."""
    sizes = comp.groupBy("comp").agg(F.count("*").alias("n"))
    large = sizes.where(f"n > {BLOCK}").select("comp", "n", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    held = comp.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALT))).join(large, ["comp", "salt"], "left")
    return stored(classes.join(held, "cid"), "members")


def _with(members: DataFrame, facts: DataFrame) -> DataFrame:
    """members joined with what is said of their components (comp, ...); for large
    ones at SALT places, so that no task gets all members of one."""
    copied = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    large = members.where("n IS NOT NULL")
    hot = large.join(copied.join(large.select("comp").distinct(), "comp", "left_semi"), ["comp", "salt"])
    return hot.unionByName(members.where("n IS NULL").join(facts, "comp"), allowMissingColumns=True)


def _near_components(pairs: DataFrame, graph: DataFrame, comp: DataFrame, members: DataFrame, least: float, threshold: float, block: int) -> DataFrame:
    """Links (a, b) between components with a compared pair of a similarity of `least`
    or more: the larger one's members are compared with those of all others near it."""
    sizes = comp.groupBy("comp").agg(F.count("*").alias("size"))
    compared = _merged(pairs, graph.where("NOT own").select(F.col("u").alias("a"), F.col("v").alias("b"), "sim")).where(F.col("sim") >= least)
    met = _ends(compared, comp).where("ca <> cb").select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).distinct()
    met = met.join(sizes.toDF("ca", "na"), "ca").join(sizes.toDF("cb", "nb"), "cb").where("na > 1 OR nb > 1")
    near = stored(met.select(F.when(F.col("na") >= F.col("nb"), F.col("ca")).otherwise(F.col("cb")).alias("g"), F.when(F.col("na") >= F.col("nb"), F.col("cb")).otherwise(F.col("ca")).alias("comp"), F.greatest("na", "nb").alias("left"), F.least("na", "nb").alias("right")), "near")
    parts = near.groupBy("g").agg(F.ceil(F.first("left") / block).cast("int").alias("p_of"), F.ceil(F.sum("right") / block).cast("int").alias("q_of"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    left = _with(members, parts.withColumnRenamed("g", "comp")).select(F.col("comp").alias("g"), one("p_of").alias("p"), every("q_of").alias("q"), F.lit(True).alias("left"), "comp", "vec")
    right = _with(members, near.join(parts, "g").select("comp", "g", "p_of", "q_of")).select("g", every("p_of").alias("p"), one("q_of").alias("q"), F.lit(False).alias("left"), "comp", "vec")

    def compare(t: pa.Table) -> pa.Table:
        near, comps = np.array(t["left"]), t["comp"].to_numpy()
        left, right = np.flatnonzero(near), np.flatnonzero(~near)
        hit: set[int] = set()
        vecs = t["vec"].to_pylist()
        for size in {len(v) for v in vecs}:
            x, y = ([i for i in side if len(vecs[i]) == size] for side in (left, right))
            if x and y:
                hit |= set(comps[y][(_matrix([vecs[i] for i in y]) @ _matrix([vecs[i] for i in x]).T >= threshold).any(1)].tolist())
        own = int(comps[left[0]]) if len(left) else 0
        return pa.table({"a": pa.array([own] * len(hit), pa.int64()), "b": pa.array(sorted(hit), pa.int64())})

    return left.unionByName(right).groupBy("g", "p", "q").applyInArrow(compare, "a long, b long")


def _counted(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(cid, links): vectors linked directly to each class of a component, other
    than its own copies, compared in blocks."""
    sizes = members.groupBy("comp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("size")).where("size > 1").drop("size")
    dealt = _with(members, sizes).withColumn("i", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # Block i meets every block j once, as the pair (least, greatest).
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("comp", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "cid", "vec", "copies")

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        p, q = key[1].as_py(), key[2].as_py()
        i, cid, copies = t["i"].to_numpy(), t["cid"].to_numpy(), t["copies"].to_numpy()
        x = np.stack([np.frombuffer(v, np.float64) for v in t["vec"].to_pylist()])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        left, right = np.flatnonzero(i == p), np.flatnonzero(i == q)
        near = x[left] @ x[right].T >= threshold
        if p == q:
            np.fill_diagonal(near, False)
            return pa.table({"cid": pa.array(cid[left], pa.int64()), "links": pa.array(near @ copies[right], pa.int64())})
        return pa.table({"cid": pa.array(np.concatenate([cid[left], cid[right]]), pa.int64()), "links": pa.array(np.concatenate([near @ copies[right], near.T @ copies[left]]), pa.int64())})

    return dealt.groupBy("comp", "p", "q").applyInArrow(compare, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def _matrix(vecs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _asked(held: DataFrame, asked: DataFrame, threshold: float, block: int) -> DataFrame:
    """(cid, lost, other): a row for each asked vector that a block of its label links, lost if any of these
    links leaves its component, and a row with `other` for each two components found joined. Blocks
    of asked vectors meet blocks of all vectors of their label; asked labels are no more than asked
    vectors, so what is broadcast is bounded by the sample."""
    of_label = asked.groupBy("label", "size").agg(F.ceil(F.count("*") / block).cast("int").alias("ps"))
    blocks = held.join(F.broadcast(of_label), ["label", "size"], "left_semi").groupBy("label", "size").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("qs"))
    dealt = F.broadcast(of_label.join(F.broadcast(blocks), ["label", "size"]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64(F.lit("deal"), "cid"), F.col(n)).cast("int")
    names = ["label", "size", "p", "q", "cid", "comp", "vec"]
    left = asked.join(dealt, ["label", "size"]).withColumn("p", one("ps")).withColumn("q", every("qs")).select(*names, F.lit(True).alias("left"))
    right = held.join(dealt, ["label", "size"]).withColumn("q", one("qs")).withColumn("p", every("ps")).select(*names, F.lit(False).alias("left"))

    def compare(t: pa.Table) -> pa.Table:
        is_left, cid, c, x = np.array(t["left"]), t["cid"].to_numpy(), t["comp"].to_numpy(), _matrix(t["vec"].to_pylist())
        u, v = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        near = (x[u] @ x[v].T >= threshold) & (cid[u][:, None] != cid[v])
        away = near & (c[u][:, None] != c[v])
        linked = near.any(1)
        i, j = np.nonzero(away)
        _, first = np.unique(np.stack([c[u[i]], c[v[j]]]), axis=1, return_index=True)
        ids = np.concatenate([cid[u[linked]], cid[u[i[first]]]])
        lost = np.concatenate([away.any(1)[linked], np.ones(len(first), bool)])
        other = pa.array([None] * int(linked.sum()) + cid[v[j[first]]].tolist(), pa.int64())
        return pa.table({"cid": pa.array(ids, pa.int64()), "lost": pa.array(lost), "other": other})

    return left.unionByName(right).groupBy("label", "size", "p", "q").applyInArrow(compare, "cid long, lost boolean, other long")


def audit(classes: DataFrame, comp: DataFrame, threshold: float, sample: int = AUDIT, links: int = AUDIT_LINKS, block: int = BLOCK) -> tuple[int, int, DataFrame]:
    """(whole, linked, lost): of a uniform sample of vectors, compared with all by brute force,
    how many have links, how many of these all of them inside their component, and the links
    (a, b) that leave it. About `sample` vectors are compared and, if fewer than `links` of them have
    links, four times as many once more. The sample is a table; only counts come to the driver."""
    held = stored(classes.join(comp, "cid").select("cid", "label", "size", "vec", "comp", F.pmod(F.xxhash64(F.lit("audit"), "cid"), F.lit(2**40)).alias("h")), "held")
    n, done, found = held.count(), 0.0, []
    whole = linked = 0
    for size in (sample, 4 * sample):
        upto = 1.0 if n <= 2 * size else min(1.0, done + size / n)
        asked = held.where((F.col("h") >= int(done * 2**40)) & (F.col("h") < int(upto * 2**40)))
        found.append(stored(_asked(held, asked, threshold, block), "audited"))
        seen = found[-1].groupBy("cid").agg(F.max("lost").alias("lost")).agg(F.count("*"), F.count_if(~F.col("lost"))).first()
        linked, whole, done = linked + seen[0], whole + seen[1], upto
        if done >= 1 or linked >= links:
            break
    log.info("audit: %d of %d linked vectors whole, %.4g of %d vectors compared", whole, linked, done, n)
    return whole, linked, reduce(DataFrame.unionByName, found).where("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b"))


def _links_by_blocks(classes: DataFrame, comp: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b): a link for each two components that a pair of blocks of a label joins."""
    held = classes.join(comp, "cid").select("label", "size", "cid", "comp", "vec", F.pmod(F.xxhash64("cid"), F.lit(SALT)).alias("salt"))
    sizes = held.groupBy("label", "size").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = held.join(sizes, ["label", "size", "salt"]).withColumn("i", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "size", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "cid", "comp", "vec")

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        i, cid, c, x = t["i"].to_numpy(), t["cid"].to_numpy(), t["comp"].to_numpy(), _matrix(t["vec"].to_pylist())
        left, right = np.flatnonzero(i == key[2].as_py()), np.flatnonzero(i == key[3].as_py())
        u, v = np.nonzero((x[left] @ x[right].T >= threshold) & (c[left][:, None] != c[right]))
        u, v = left[u], right[v]
        _, first = np.unique(np.stack([np.minimum(c[u], c[v]), np.maximum(c[u], c[v])]), axis=1, return_index=True)
        return pa.table({"a": pa.array(cid[u[first]], pa.int64()), "b": pa.array(cid[v[first]], pa.int64())})

    return dealt.groupBy("label", "size", "p", "q").applyInArrow(compare, "a long, b long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, k: int = NEIGHBOURS, tables: int = TABLES, rounds: int = ROUNDS, block: int = BLOCK, recall: float = 0.98) -> DataFrame:
    """A row for each row of vectors: vec_id, n_links (other vectors linked
    directly), component_id (the least vec_id reachable by links) and kept."""
    with temporary_tables(vectors.sparkSession):
        return _near_duplicate_vectors(vectors, threshold, k, tables, rounds, block, recall)


def _near_duplicate_vectors(vectors: DataFrame, threshold: float, k: int, tables: int, rounds: int, block: int, recall: float) -> DataFrame:
    rows, classes = _classes(vectors)
    comp, pairs = classes.select("cid", F.col("cid").alias("comp")), None
    for attempt in range(4):  # more tables while the audit finds too many links missing
        more = _buckets(classes, range(attempt * tables, (attempt + 1) * tables))
        pairs = stored(more if pairs is None else _merged(pairs, more), "pairs")
        graph, joined = None, 1
        while joined:  # lists of saturated vectors are enlarged outside their components
            known = pairs if graph is None else _merged(pairs, graph.where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"), "sim"))
            graph, links = _descend(known, classes, comp, k, rounds, threshold)
            comp, joined = _joined(comp, links)
            graph = _regrouped(graph, comp)
            near = _near_components(pairs, graph, comp, _members(classes, comp), threshold - MARGIN, threshold, block)
            comp, more = _joined(comp, near)
            joined += more
        whole, linked, lost = audit(classes, comp, threshold)
        if whole < linked:  # what the audit finds is kept
            comp, _ = _joined(comp, lost)
        if whole >= recall * linked:
            break
    else:  # no number of tables did: all others exactly
        comp, _ = _joined(comp, _links_by_blocks(classes, comp, threshold, block))
    members = _members(classes, comp)
    counts = _counted(members, threshold, block)
    least = members.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    of_class = _with(members, least).join(counts, "cid", "left").select("label", "vec", "copies", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    out = _labelled(rows, stored(of_class, "labels"))
    component = F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _regrouped(graph: DataFrame, comp: DataFrame) -> DataFrame:
    ends = graph.drop("own").join(comp.toDF("u", "cu"), "u").join(comp.toDF("v", "cv"), "v")
    return ends.select("u", "v", "sim", (F.col("cu") == F.col("cv")).alias("own"))


def _labelled(rows: DataFrame, of_class: DataFrame) -> DataFrame:
    """rows with what is said of their class; rows of a vector with many copies meet
    it at SALT places."""
    many = of_class.where(f"copies > {BLOCK}").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = stored(rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALT))).join(many, ["label", "vec", "salt"], "left"), "met").drop("salt")
    few = met.where("copies IS NULL").select("vec_id", "label", "vec").join(of_class.where(f"copies <= {BLOCK}"), ["label", "vec"], "left")
    return stored(met.where("copies IS NOT NULL").unionByName(few).drop("vec", "label"), "labelled", keep=True)
