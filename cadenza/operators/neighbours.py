"""A neighbour index kept as tables: leaders, and cells of vectors around them.

Leaders are vectors chosen by hash, about the square root of all and LEADERS at most, so that
they can be sent to every task. A vector belongs to the cell of its nearest leader, and to
those of the next `spill` - 1. Cells are cut into blocks of up to BLOCK vectors in order of their angle to
the leader, so that a block is a ring around it. A query is joined with cells by their number:

* search() asks the `probes` nearest cells, as approximate indexes do; audit() measures what that
  finds of the true neighbours of a sample.
* exact() asks the nearest cell for k neighbours first and then each ring that could hold a nearer
  one than the k-th, by the triangle inequality of angles: no neighbour is missed, and how much is
  skipped depends on how the vectors lie.

Queries and vectors meet as matrices; only the best k of a block for a query become rows. add()
puts new vectors into the cells that are there, so an index grows without being built again.

Special inputs: rows without a vector are left out; a vector of zeros has cosine 0 with all; vectors of
another size than the index's are an error; an id that is in the index already is not added again;
an empty table gives an index without cells that finds nothing. Ids are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import r6
from cadenza.sources.scratch import new_folder, stored

from .similarity import top
from .topk import rounded

LEADERS = 1 << 14  # at most: what is sent to every task
BLOCK = 512  # vectors in a block, queries in a batch
CELL_PART = 1 << 16  # vectors of a cell that one task packs
TASKS = 4  # pairs of groups of queries and of vectors for each core, at least, where there are so many batches
GROUP_BYTES = 1 << 27  # of the vectors of a group; more make more groups
TOGETHER = 8  # blocks multiplied at a time
SLACK = 1e-5  # of an angle, for rounding
BLOCKS = "cell int, block long, low double, high double, own boolean, ids array<bigint>, m binary"


def _units(column: pa.Array, size: int) -> np.ndarray:
    """Vectors at length one; zeros stay."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    if (lengths != size).any():
        raise ValueError(f"a vector has not {size} parts")
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(length > 0, length, 1.0)


def _listed(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1)))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _first(sim: np.ndarray, count: int) -> np.ndarray:
    """For each row the places of its greatest values, ties to the least place."""
    sim, out = sim.copy(), []
    for _ in range(min(count, sim.shape[1])):
        out.append(sim.argmax(axis=1))
        sim[np.arange(len(sim)), out[-1]] = -np.inf
    return np.stack(out, axis=1) if out else np.zeros((len(sim), 0), int)


@dataclass
class Leaders:
    """Unit vectors of the leaders, in order of their ids."""

    ids: np.ndarray
    m: np.ndarray

    @property
    def size(self) -> int:
        return self.m.shape[1]

    def cosines(self, vectors: np.ndarray) -> np.ndarray:
        return rounded((vectors @ self.m.T).reshape(-1)).reshape(len(vectors), -1)


def _assigned(vectors: DataFrame, leaders, count: int, names: str) -> DataFrame:
    """(names, vec, cell, nth, angle) of each vector and its `count` nearest leaders."""
    key, kind = names.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = leaders.value
        for b in batches:
            if b.num_rows:
                v = _units(b.column(1), own.size)
                for i in range(0, len(v), BLOCK):
                    sim = own.cosines(v[i : i + BLOCK])
                    cells = _first(sim, count)
                    row = np.repeat(np.arange(len(sim)), cells.shape[1])
                    took = pa.array(row + i)
                    nth = np.tile(np.arange(cells.shape[1]), len(sim))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(took), _listed(v[row + i]), pa.array(cells.reshape(-1), pa.int32()), pa.array(nth, pa.int32()), pa.array(_angle(sim[row, cells.reshape(-1)]))], names=[key, "vec", "cell", "nth", "angle"])

    return vectors.mapInArrow(run, f"{key} {kind}, vec array<double>, cell int, nth int, angle double")


def _dealt(batches: int, queries: int, blocks: int, vectors: int, size: int, cores: int) -> tuple[int, int]:
    """How many groups to make of queries and of vectors. Each side is sent once to each group of the
    other, so the smaller one is sent to more: the least bytes that give every core its pairs of groups."""
    least_x, least_y = (max(1, -(-n * size * 8 // GROUP_BYTES)) for n in (queries, vectors))
    wanted = min(TASKS * cores, batches * blocks)
    best = None
    for y in {max(least_y, min(blocks, 1 << i)) for i in range(wanted.bit_length() + 1)}:
        x = max(least_x, min(batches, -(-wanted // y)))
        best = min(best or (math.inf,), (queries * y + vectors * x, y, x))
    return max(1, best[2]), best[1]


def _packed(rows: DataFrame, first: int) -> DataFrame:
    """Rows (song_id, vec, cell, nth, angle), sorted by cell, nth > 0 and angle, as BLOCKS, which are
    numbered from first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        kind: tuple | None = None

        def block() -> pa.RecordBatch:
            ids, vecs, angles = zip(*held, strict=True)
            cells = [[kind[0]], [first + (at << 32) + made], [min(angles)], [max(angles)], [not kind[1]], [list(ids)], [np.concatenate(vecs).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["cell", "block", "low", "high", "own", "ids", "m"])

        for b in batches:
            vecs = b.column(1)
            for i, (song, cell, nth, angle) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True)):
                if held and (kind != (cell, nth > 0) or len(held) == BLOCK):
                    yield block()
                    held, made = [], made + 1
                kind = (cell, nth > 0)
                held.append((song, vecs[i].values.to_numpy(zero_copy_only=False).astype(np.float64), angle))
        if held:
            yield block()

    return rows.mapInArrow(run, BLOCKS)


FOUND = "q long, song_id long, sim double"


def _multiplied(pairs: DataFrame, k: int, keep_self: bool) -> DataFrame:
    """The best k of each block for each query of a batch. pairs: qs, qm, out (for each query
    what it must not find), ids, m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c) for c in ("qs", "qm", "out", "ids", "m")]
            for qs, qm, out, ids, m in zip(*cols, strict=True):
                qs, ids = qs.values.to_numpy(), ids.values.to_numpy()
                sim = np.frombuffer(qm.as_buffer()).reshape(len(qs), -1) @ np.frombuffer(m.as_buffer()).reshape(len(ids), -1).T
                if not keep_self:
                    sim[qs[:, None] == ids[None, :]] = -np.inf
                for row, x in enumerate(out):
                    if x.is_valid and len(x.values):
                        sim[row, np.isin(ids, x.values.to_numpy())] = -np.inf
                yield _best(qs, ids, sim, k)

    return pairs.mapInArrow(run, FOUND)


def _places(ids: np.ndarray, sim: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, rounded cosine) of the best k of each row, ties to the least id; -inf and what is below a row's
    floor are not found."""
    order = np.argsort(ids, kind="stable")
    ids, sim = ids[order], sim[:, order]
    ok = np.isfinite(sim) if floor is None else sim >= floor[:, None]
    if k * 4 < len(ids) and np.count_nonzero(ok) > 4 * k * len(sim):  # only what may be among the best is rounded and sorted
        ok &= sim >= np.partition(sim, len(ids) - k, axis=1)[:, len(ids) - k, None] - 2e-6
    row, col = np.nonzero(ok)
    row, col, s = _cut(row, col, rounded(sim[row, col]), k)
    return row, ids[col], s


def _cut(row: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k of each row with the greatest s, ties to the least id."""
    order = np.lexsort((ids, -s, row))
    row, ids, s = row[order], ids[order], s[order]
    ok = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[ok], ids[ok], s[ok]


def _best(qs: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int) -> pa.RecordBatch:
    row, song, s = _places(ids, sim, k)
    return pa.RecordBatch.from_arrays([pa.array(qs[row]), pa.array(song), pa.array(s)], names=["q", "song_id", "sim"])


def _products(pairs: DataFrame, blocks: DataFrame, k: int, keep_self: bool, tasks: int) -> DataFrame:
    """The best k of each query in each group of blocks. pairs: a row for each batch of queries and group of blocks
    (x, y: both groups) with qs, qm, the blocks it asks (near), the least cosines that are asked for (floor, or
    null) and what is not to be found: places in qs (out_q) and ids (out_id). blocks: x, y, block, ids, m."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = {b: i for i, b in enumerate(right["block"].to_pylist())}
        out = []
        for qs, qm, near, floor, row, song in zip(*(left[c] for c in ("qs", "qm", "near", "floor", "out_q", "out_id")), strict=True):
            qs, found = qs.values.to_numpy(), []
            queries = np.frombuffer(qm.as_buffer()).reshape(len(qs), -1)
            least = floor.values.to_numpy() - SLACK if floor.is_valid else np.full(len(qs), -2.0)
            asked = sorted(at[b] for b in near.values.to_pylist())
            for i in range(0, len(asked), TOGETHER):
                some = asked[i : i + TOGETHER]
                ids = np.concatenate([right["ids"][j].values.to_numpy() for j in some])
                sim = queries @ np.concatenate([np.frombuffer(right["m"][j].as_buffer()).reshape(-1, queries.shape[1]) for j in some]).T
                if not keep_self or row.is_valid:
                    order = np.argsort(ids, kind="stable")
                    for r, x in ([] if keep_self else [(np.arange(len(qs)), qs)]) + ([(row.values.to_numpy(), song.values.to_numpy())] if row.is_valid else []):
                        first = np.searchsorted(ids[order], x)
                        n = np.searchsorted(ids[order], x, "right") - first
                        sim[np.repeat(r, n), order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]] = -np.inf
                r, x, s = _places(ids, sim, k, least)
                found.append((r, x, s))
                full = np.bincount(r, minlength=len(qs)) >= k
                last = np.flatnonzero(np.append(r[1:] != r[:-1], True)) if len(r) else np.zeros(0, int)
                kth = np.full(len(qs), -2.0)
                kth[r[last]] = s[last]
                least = np.where(full, np.maximum(least, kth - SLACK), least)
            r, x, s = _cut(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
            out.append((qs[r], x, s))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], names=["q", "song_id", "sim"])

    left, right = (df.repartition(tasks, "x", "y").groupBy("x", "y") for df in (pairs, blocks))
    return left.cogroup(right).applyInArrow(run, FOUND)


def _batches(queries: DataFrame) -> DataFrame:
    """Queries (cell, q, vec, out) in batches (cell, qs, qm, out) of up to BLOCK that share a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def batch() -> pa.RecordBatch:
            qs, vecs, outs = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([list(qs)], pa.list_(pa.int64())), pa.array([np.concatenate(vecs).tobytes()], pa.binary()), pa.array([list(outs)], pa.list_(pa.list_(pa.int64())))], names=["cell", "qs", "qm", "out"])

        for b in batches:
            vecs = b.column(2)
            for i, (at, q, out) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3)), strict=True)):
                if held and (at != key or len(held) == BLOCK):
                    yield batch()
                    held = []
                key = at
                held.append((q, vecs[i].values.to_numpy(zero_copy_only=False).astype(np.float64), out))
        if held:
            yield batch()

    # A cell that very many queries share is dealt to several tasks.
    salted = queries.select("cell", "q", "vec", "out").repartition("cell", F.pmod(F.xxhash64("q"), F.lit(8))).sortWithinPartitions("cell")
    return salted.mapInArrow(run, "cell int, qs array<bigint>, qm binary, out array<array<bigint>>")


class NeighbourIndex:
    """Tables of an index in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        rows = spark.read.parquet(f"{folder}/leaders").orderBy("song_id").collect()  # LEADERS at most
        self.count, self.spill = len(rows), rows[0].spill if rows else 1
        m = np.array([r.vec for r in rows], np.float64).reshape(self.count, len(rows[0].vec) if rows else 0)
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m = m / np.where(length > 0, length, 1.0)
        self._leaders = spark.sparkContext.broadcast(Leaders(np.array([r.song_id for r in rows], np.int64), m))

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, leaders: int | None = None, spill: int = 2, cell: int = 1, seed: str = "leaders", song: str = "song_id", vec: str = "vec") -> NeighbourIndex:
        """An index of vectors in a new folder. leaders: their number; else the square root of all, or
        fewer, so that cells have `cell` vectors on average."""
        spark = vectors.sparkSession
        known = vectors.select(F.col(song).cast("long").alias("song_id"), F.col(vec).cast("array<double>").alias("vec")).where("song_id IS NOT NULL AND vec IS NOT NULL")
        n = known.count()
        m = min(LEADERS, leaders or min(math.isqrt(max(0, n - 1)) + 1, n // cell + 1))
        # The first by hash: each task keeps m rows at most.
        known.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("song_id").cast("string")).cast("binary")), "song_id").limit(m if n else 0).withColumn("spill", F.lit(spill)).write.parquet(f"{folder}/leaders")
        own = cls(spark, folder)
        own._write(known, "error")
        return own

    def _write(self, known: DataFrame, mode: str) -> None:
        if not self.count:
            self.spark.createDataFrame([], BLOCKS).write.mode(mode).parquet(f"{self.folder}/cells")
            return
        rows = stored(_assigned(known, self._leaders, self.spill, "song_id bigint"), "assigned")
        sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / CELL_PART).alias("parts"))  # a row for each leader
        dealt = rows.join(F.broadcast(sizes), "cell").repartition("cell", F.pmod(F.xxhash64("song_id"), "parts")).sortWithinPartitions("cell", F.col("nth") > 0, "angle", "song_id")
        first = 0 if mode == "error" else self.cells().agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]
        _packed(dealt.select("song_id", "vec", "cell", "nth", "angle"), first).write.mode(mode).parquet(f"{self.folder}/cells")

    def cells(self) -> DataFrame:
        return self.spark.read.schema(BLOCKS).parquet(f"{self.folder}/cells")

    def members(self) -> DataFrame:
        """(song_id, cell, block) of all vectors, those in further cells too."""
        return self.cells().select(F.explode("ids").alias("song_id"), "cell", "block")

    def add(self, vectors: DataFrame, song: str = "song_id", vec: str = "vec") -> None:
        """Put vectors into the index whose ids are not in it."""
        new = vectors.select(F.col(song).cast("long").alias("song_id"), F.col(vec).cast("array<double>").alias("vec")).where("song_id IS NOT NULL AND vec IS NOT NULL")
        if not self.count:
            raise ValueError("an index that was built without vectors has no leaders")
        new = new.dropDuplicates(["song_id"]).join(self.members().select("song_id").distinct(), "song_id", "left_anti")
        self._write(new, "append")

    def _queries(self, queries: DataFrame) -> DataFrame:
        return queries.select(F.col("q").cast("long").alias("q"), F.col("vec").cast("array<double>").alias("vec")).where("q IS NOT NULL AND vec IS NOT NULL")

    def search(self, queries: DataFrame, k: int, probes: int = 8, exclude: DataFrame | None = None, keep_self: bool = True) -> DataFrame:
        """(q, song_id, sim, rank): for queries (q, vec) the k nearest by cosine in their `probes` nearest cells,
        without the pairs (q, song_id) of exclude; keep_self=False: without q itself."""
        if not self.count:
            return self.spark.createDataFrame([], FOUND + ", rank long")
        asked = _assigned(self._queries(queries), self._leaders, probes, "q bigint").select("q", "vec", "cell")
        if exclude is None:
            asked = asked.withColumn("out", F.lit(None).cast("array<bigint>"))
        else:
            out = exclude.select(F.col("q").cast("long").alias("q"), F.col("song_id").cast("long").alias("song_id")).join(self.members().select("song_id", "cell").distinct(), "song_id")
            asked = asked.join(out.groupBy("q", "cell").agg(F.collect_set("song_id").alias("out")), ["q", "cell"], "left")
        found = _multiplied(_batches(asked).join(self.cells().select("cell", "ids", "m"), "cell"), k, keep_self)
        return top(found.distinct(), k, ["q"], "sim", "song_id")  # the same song may be met in two cells

    def exact(self, queries: DataFrame, k: int, exclude: DataFrame | None = None, keep_self: bool = True) -> DataFrame:
        """As search, but no neighbour is missed. Queries are asked in batches that share their nearest
        cell: a batch meets a ring if one of its queries needs that."""
        if not self.count:
            return self.spark.createDataFrame([], FOUND + ", rank long")
        own, leaders = self.cells().where("own"), self._leaders
        asked = _assigned(self._queries(queries), leaders, 1, "q bigint").select("cell", "q", "vec", F.lit(None).cast("array<bigint>").alias("out"))
        batches = stored(_batches(asked).select("cell", F.xxhash64("cell", F.monotonically_increasing_id(), "qs").alias("batch"), "qs", "qm"), "batches")
        places = batches.select("batch", F.posexplode("qs").alias("place", "q"))

        counts = [tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.size(ids)), F.lit(0))).first()) for df, ids in ((batches, "qs"), (own, "ids"))]
        x, y = _dealt(*counts[0], *counts[1], leaders.value.size, self.spark.sparkContext.defaultParallelism)
        x, y = F.pmod(F.xxhash64("batch"), F.lit(x)).alias("x"), F.pmod(F.xxhash64("block"), F.lit(y)).alias("y")
        outs = None
        if exclude is not None:
            out = exclude.select(F.col("q").cast("long").alias("q"), F.col("song_id").cast("long").alias("song_id")).distinct().join(own.select(y, F.explode("ids").alias("song_id")), "song_id").join(places, "q")
            outs = out.groupBy("batch", "y").agg(F.collect_list("place").alias("out_q"), F.collect_list("song_id").alias("out_id"))
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

        def ask(pairs: DataFrame, floor: DataFrame | None = None) -> DataFrame:
            # Vectors are sent to groups, not to pairs, however many pairs there are.
            near = stored(pairs.groupBy("batch", y).agg(F.collect_list("block").alias("near")), "near")
            if outs is None:
                met = near.withColumns({"out_q": F.lit(None).cast("array<int>"), "out_id": F.lit(None).cast("array<bigint>")})
            else:
                met = near.join(outs, ["batch", "y"], "left")
            rows = batches.select("batch", "qs", "qm")
            rows = rows.withColumn("floor", F.lit(None).cast("array<double>")) if floor is None else rows.join(floor, "batch")
            met = met.join(rows, "batch").withColumn("x", x)
            blocks = own.select("block", "ids", "m", y).join(F.broadcast(near.select(x, "y").distinct()), "y")
            return _products(met, blocks, k, keep_self, tasks)

        found = stored(top(ask(batches.select("batch", "cell").join(own.select("cell", "block"), "cell").drop("cell")), k, ["q"], "sim", "song_id"), "found")
        kth = F.when(F.col("rank") == k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "sim"))))
        worst = places.join(found.where(F.col("rank") == k).select("q", kth.alias("worst")), "q", "left").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("worst", F.lit(math.pi)).alias("worst")))).alias("w"))
        worst = stored(worst.select("batch", F.col("w.worst").alias("worst")), "worst")
        spans = {r.cell: (r.low, r.high) for r in own.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # a row for each leader
        low, high = (np.array([spans.get(c, (np.inf, -np.inf))[i] for c in range(self.count)]) for i in (0, 1))

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                for batch, cell, qm, w in zip(*(b.column(c) for c in ("batch", "cell", "qm", "worst")), strict=True):
                    reach = w.values.to_numpy()[:, None] + SLACK
                    angle = _angle(leaders.value.cosines(np.frombuffer(qm.as_buffer()).reshape(-1, leaders.value.size)))
                    ok = (angle - reach <= high) & (angle + reach >= low) & np.isfinite(low)
                    ok[:, cell.as_py()] = False  # asked already
                    cells = np.flatnonzero(ok.any(axis=0))
                    least, most = np.where(ok, angle - reach, np.inf).min(axis=0)[cells], np.where(ok, angle + reach, -np.inf).max(axis=0)[cells]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), batch.as_py())), pa.array(cells, pa.int32()), pa.array(least), pa.array(most)], names=["batch", "cell", "least", "most"])

        far = batches.join(worst, "batch").select("batch", "cell", "qm", "worst").mapInArrow(run, "batch bigint, cell int, least double, most double")
        rings = own.select("cell", "block", "low", "high")
        more = ask(far.join(rings, "cell").where("low <= most AND high >= least").select("batch", "block"), worst.select("batch", F.transform("worst", F.cos).alias("floor")))
        return top(found.drop("rank").unionByName(more), k, ["q"], "sim", "song_id")

    def audit(self, queries: DataFrame, k: int, probes: tuple[int, ...] = (8,), sample: int = 256, seed: str = "audit") -> DataFrame:
        """(probes, queries, wanted, found, recall): what search() with so many probes finds of the true k nearest
        of `sample` queries chosen by hash."""
        chosen = stored(self._queries(queries).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("q").cast("string")).cast("binary")), "q").limit(sample), "chosen")
        true = stored(self.exact(chosen, k, keep_self=False).select("q", "song_id"), "true")
        rows = []
        for p in probes:
            got = self.search(chosen, k, p, keep_self=False).select("q", "song_id", F.lit(1).alias("got"))
            n = F.count("*")
            rows.append(true.join(got, ["q", "song_id"], "left").agg(F.lit(p).alias("probes"), F.countDistinct("q").alias("queries"), n.alias("wanted"), F.count("got").alias("found"), r6(F.count("got") / F.greatest(n, F.lit(1))).alias("recall")))
        return reduce(DataFrame.unionByName, rows)


def nearest(queries: DataFrame, items: DataFrame, k: int, query: str = "q", item: str = "song_id", keep_self: bool = False, exclude: DataFrame | None = None) -> DataFrame:
    """(q, song_id, sim, rank): exact nearest items by cosine over an index made for these items. Both
    sides have vec."""
    index = NeighbourIndex.build(items.select(F.col(item).alias("song_id"), "vec"), new_folder(items.sparkSession, "index"), spill=1, cell=BLOCK)
    return index.exact(queries.select(F.col(query).alias("q"), "vec"), k, exclude, keep_self)
