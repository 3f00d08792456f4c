"""The most similar items (or users) over interactions, exactly and without all pairs.

Two items meet where a user has both. Users are split by the number of their items:

* Light users' lists are multiplied as they are, which makes at most LIGHT products for each
  interaction. Lists go to the blocks of items they hold, many in a row, in as few bytes as their
  numbers need, and a task sums up the products of its block in matrices and keeps the best: no pair of items
  is a row. An item with very many products is summed in parts. Where lists sent to blocks would take more
  than TURN bytes, blocks take turns, so disk holds the lists of one turn at a time.
* What heavy users add to a pair is at most the product of the two items' norms over heavy users
  alone (Cauchy-Schwarz), as in the suffix bounds of all-pairs joins. The k-th best score over
  light users is a bound from below, t. A pair that shares light users is looked at again only
  if its score plus that product reaches t; a pair that shares none only if the product
  itself does. Items with heavy users are packed in dense blocks, by the least norm that
  may pair with them (t over their own) on one side and by norm on the other, so most pairs of blocks
  are never formed.

So a user with a million items costs products only with items that could be among the best, not a
million squared. Scores are rounded, then ties go to the least id.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import r6
from cadenza.sources.scratch import in_turns, let_go, placed, stored, sums_before

LIGHT = 1024  # items of a user up to which its list is multiplied as it is
PRODUCTS = 1 << 22  # of a task, about
CELLS = 1 << 22  # of a matrix of sums
TURN = 1 << 31  # bytes of lists that are sent to blocks at a time, about
ENTRY = 6  # bytes of a packed list's entry, about
SPAN = 1 << 20  # of ids that are places at once
SEND = 1 << 22  # bytes of packed lists handed on at a time
BLOCK_ITEMS, BLOCK_ENTRIES, TILE = 512, 1 << 18, 1024  # of a dense block; users multiplied at a time
SLACK = 2e-6  # bounds are compared with rounded scores


def rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves up, as Spark rounds."""
    scaled = x * 1e6
    out = np.floor(scaled + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _shrunk(x: np.ndarray) -> bytes:
    """Numbers in as few bytes as they need: whole ones less their least, the first bytes of all, then the second and so on;
    others as they are."""
    least, width = 0, 9
    if not len(x):
        return struct.pack("<qbq", 0, 0, 0)
    if x.dtype != np.float64 or np.isfinite(x).all() and np.abs(x).max() < 2**53 and not (x % 1).any() and not np.signbit(x[x == 0]).any():
        whole = x.astype(np.int64)
        least, most = int(whole.min()), int(whole.max())
        width = ((most - least).bit_length() + 7) // 8
    head = struct.pack("<qbq", len(x), width, least)
    if width == 9:
        return head + x.tobytes()
    bytes_of = (whole.astype(np.uint64) - np.uint64(least & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
    return head + np.ascontiguousarray(bytes_of[:, :width].T).tobytes()


def _grown(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    """The numbers that _shrunk packed from a place on, and the place behind them."""
    n, width, least = struct.unpack_from("<qbq", data, at)
    at += struct.calcsize("<qbq")
    if width == 9:
        return np.frombuffer(data, np.float64, n, at), at + 8 * n
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view(np.int64).reshape(-1) + least, at + n * width


def _packed(*columns: np.ndarray) -> bytes:
    raw = b"".join(map(_shrunk, columns))
    return struct.pack("<q", len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: memoryview, count: int) -> list[np.ndarray]:
    raw = memoryview(pa.decompress(data[8:], struct.unpack_from("<q", data)[0], "zstd", asbytes=True))
    out, at = [], 0
    for _ in range(count):
        x, at = _grown(raw, at)
        out.append(x)
    return out


def _places_of(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start to start + size - 1 of each, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _parts_of(items: DataFrame, lists: DataFrame, turn: int = 0, turns: int = 1) -> DataFrame:
    """(block, data): lists with items of a block, many in a row, packed: for each list its size and which of its places
    are the block's, then ids, weights and norms of all. Ids are kept as steps. Norms travel squared: sums of whole weights
    are whole, and shrink well. Of several turns only the blocks of one are dealt."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {c: k for k, c in enumerate(b.schema.names)}
            off = b.column(at["block"]).offsets.to_numpy().astype(np.int64)
            key, ids, *rest = (b.column(at[c]).flatten().to_numpy(zero_copy_only=False) for c in ("block", "i", "w", "n2", "h2"))
            start, size = off[:-1] - off[0], np.diff(off)
            row = np.repeat(np.arange(b.num_rows), size)
            step = np.diff(ids, prepend=0)
            step[start[size > 0]] = ids[start[size > 0]]
            # A run: places of a list, next to each other, that are of the same block.
            new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])) if len(row) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(row)))
            if turns > 1:  # an item that is summed in parts has all of them in one turn
                ok = np.where(key[first] < 0, ids[first], key[first]) % turns == turn
                first, count = first[ok], count[ok]
            if not len(first):
                continue
            order = np.argsort(key[first], kind="stable")
            first, count = first[order], count[order]
            blocks, begin = np.unique(key[first], return_index=True)
            out, held = [], 0
            for block, lo, hi in zip(blocks.tolist(), begin, np.append(begin[1:], len(first)), strict=True):
                runs, counts = first[lo:hi], count[lo:hi]
                lists = row[runs]
                took = _places_of(start[lists], size[lists])
                out.append((block, _packed(size[lists], runs - start[lists], counts, step[took], *(x[took] for x in rest))))
                held += len(out[-1][1])
                if held > SEND:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["block", "data"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["block", "data"])

    return lists.mapInArrow(deal, "block long, data binary")


class _Lists:
    """The lists of a block: sizes, ids, weights and squared norms, of all lists one after the other; own holds the places of
    the block's items in them, and row the list of each."""

    def __init__(self, t: pa.Table) -> None:
        parts = [_unpacked(memoryview(x.as_buffer()), 7) for x in t.column("data")]
        self.size, first, count, step, *rest = (np.concatenate(c) for c in zip(*parts, strict=True))
        self.w, self.n2, self.h2 = (x.astype(np.float64) for x in rest)
        self.start = np.cumsum(self.size) - self.size
        ids = np.cumsum(step)  # steps of a list begin with its first id
        before = (ids - step)[self.start]
        self.ids = ids - np.repeat(before, self.size)
        self.row = np.repeat(np.arange(len(self.size)), count)
        self.own = _places_of(self.start + first, count)


def _numbered(lists: _Lists) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, the place of each entry's id in them, and the norms at these places. Where ids lie
    close, those between them have places too, which saves sorting."""
    least, most = int(lists.ids.min()), int(lists.ids.max())
    if most - least < max(SPAN, 4 * len(lists.ids)):
        ids, item = np.arange(least, most + 1), lists.ids - least
        n, h = np.zeros(len(ids)), np.zeros(len(ids))
        n[item], h[item] = lists.n2, lists.h2
    else:
        ids, first, item = np.unique(lists.ids, return_index=True, return_inverse=True)
        n, h = lists.n2[first], lists.h2[first]
    return ids, item, np.sqrt(n), np.sqrt(h)


def _added(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values. Whole values that have room behind their key are sorted with it."""
    bits = int(value.max()).bit_length()
    if bits <= 40 and int(key.max()).bit_length() + bits < 63 and not (value % 1).any():
        both = np.sort((key << bits) | value.astype(np.int64))
        key, value = both >> bits, both & ((1 << bits) - 1)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[first], np.add.reduceat(value, first).astype(np.float64)
    key, inverse = np.unique(key, return_inverse=True)
    return key, np.bincount(inverse, value)


def _sums(lists: _Lists, ids: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the lists of a block, by and by: (item of the block, other item, sum of products), items as places in
    ids, in order of both; a whole item at a time."""
    start, size, w = lists.start, lists.size, lists.w
    at, row = lists.own, lists.row
    order = np.argsort(item[at], kind="stable")
    at, row = at[order], row[order]
    a, n = item[at], size[row]
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))  # of each item
    made = np.append(0, np.cumsum(n))
    dense = made[-1] * 16 >= len(starts) * len(ids)
    first = 0
    while first < len(starts):
        # As many items as fit: cells of a dense matrix, else products.
        if dense:
            last = min(len(starts), first + max(1, CELLS // len(ids)))
        else:
            last = max(first + 1, int(np.searchsorted(made[starts], made[starts[first]] + CELLS, "right")) - 1)
        lo, hi = starts[first], starts[last] if last < len(starts) else len(a)
        k = n[lo:hi]
        other = np.repeat(start[row[lo:hi]] - (made[lo:hi] - made[lo]), k) + np.arange(made[hi] - made[lo])
        local = np.repeat(np.searchsorted(starts[first:last], np.arange(lo, hi), "right") - 1, k)
        key, value = local * len(ids) + item[other], np.repeat(w[at[lo:hi]], k) * w[other]
        if dense:
            sums = np.bincount(key, value, (last - first) * len(ids))
            key = np.flatnonzero(sums)
            sums = sums[key]
        else:
            key, sums = _added(key, value)
        x, y = a[starts[first:last]][key // len(ids)], key % len(ids)
        ok = (x != y) & (sums > 0)
        yield x[ok], y[ok], sums[ok]
        first = last


def _promising(starts: np.ndarray, sizes: np.ndarray, raw: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Which scores may be among the best k of their group: not less than the k-th of the greatest of 4k stretches of a
    group. Groups lie one after the other; without slack the first k of equal ones are enough."""
    group = np.repeat(np.arange(len(starts)), sizes)
    m = 4 * k
    large = np.flatnonzero(sizes > 2 * m)
    least = np.full(len(starts), -np.inf)
    if len(large):
        cuts = starts[large, None] + sizes[large, None] * np.arange(m) // m
        most = np.maximum.reduceat(raw[: starts[large[-1]] + sizes[large[-1]]], cuts.reshape(-1))
        # A stretch that ends before groups that are not large takes them in too.
        ends = np.append(cuts.reshape(-1)[1:], starts[large[-1]] + sizes[large[-1]]).reshape(-1, m)[:, -1]
        for i in np.flatnonzero(ends > starts[large] + sizes[large]):
            most[i * m + m - 1] = raw[cuts[i, -1] : starts[large[i]] + sizes[large[i]]].max()
        least[large] = np.partition(most.reshape(-1, m), m - k, axis=1)[:, m - k]
    if slack:
        return raw >= least[group] - slack
    ok = raw >= least[group]
    equal = raw == least[group]
    before = np.cumsum(equal) - equal
    return ok & ~(equal & (before - before[starts][group] >= k))


def _best_of(k: int, cosine: bool, whole: bool):
    """A function of a block's lists that gives (a, b, dot, na, nb, t, more): the best k of each item, and
    those that heavy users could bring among them (more); t is the score of the k-th. If light users
    are the whole of it: (a, b, sim, rank)."""

    def best(t: pa.Table) -> pa.Table:
        out = []
        lists = _Lists(t)
        ids, item, n, h = _numbered(lists)
        for x, y, dot in _sums(lists, ids, item):
            if not len(x):
                continue
            raw = dot / (n[x] * n[y]) if cosine else dot
            starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            sizes = np.diff(np.append(starts, len(x)))
            some = np.flatnonzero(_promising(starts, sizes, raw, k, SLACK if cosine else 0.0))
            u, v = x[some], y[some]
            score = rounded(raw[some]) if cosine else raw[some]
            order = np.lexsort((v, -score, u))
            some, u, v, score = some[order], u[order], v[order], score[order]
            first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
            count = np.diff(np.append(first, len(u)))
            place = np.arange(len(u)) - np.repeat(first, count)
            if whole:
                ok = (place < k) & (score > 0)
                out.append([ids[u[ok]], ids[v[ok]], score[ok], place[ok] + 1])
                continue
            kth = np.repeat(np.where(count >= k, score[np.minimum(first + k - 1, len(u) - 1)], 0.0), sizes)
            bound = raw + h[x] * h[y] / (n[x] * n[y] if cosine else 1.0)
            ok = (h[x] > 0) & (bound >= kth - SLACK)
            ok[some[place < k]] = True
            out.append([ids[x[ok]], ids[y[ok]], dot[ok], n[x[ok]], n[y[ok]], kth[ok], (h[x] > 0)[ok]])
        names = ["a", "b", "sim", "rank"] if whole else ["a", "b", "dot", "na", "nb", "t", "more"]
        if not out:
            kinds = {"a": pa.int64(), "b": pa.int64(), "rank": pa.int64(), "more": pa.bool_()}
            return pa.Table.from_arrays([pa.array([], kinds.get(c, pa.float64())) for c in names], names=names)
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return best


def _partial(t: pa.Table) -> pa.Table:
    """All sums of a part of an item's lists, with norms."""
    out = []
    lists = _Lists(t)
    ids, item, n, h = _numbered(lists)
    for x, y, dot in _sums(lists, ids, item):
        out.append([ids[x], ids[y], dot, n[x], n[y], h[x], h[y]])
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b", "dot", "na", "nb", "ha", "hb"])


def _score(cosine: bool) -> Column:
    return r6(F.col("dot") / (F.col("na") * F.col("nb"))) if cosine else F.col("dot")


FOUND = "a long, b long, dot double, na double, nb double, t double, more boolean"


def _ranked(found: DataFrame, k: int, cosine: bool) -> DataFrame:
    place = F.row_number().over(W.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return found.withColumn("sim", _score(cosine)).where("sim > 0").withColumn("rank", place.cast("long")).where(F.col("rank") <= k).select("a", "b", "sim", "rank")


def _light(known: DataFrame, k: int, cosine: bool, split: bool, whole: bool, most: int) -> DataFrame:
    """What light users alone give, as FOUND; if they are the whole of it, (a, b, sim, rank). most: the entries that are sent to
    blocks at most."""
    entry = F.struct("i", "w", "n2", "h2", "block")
    lists = known.groupBy("u").agg(F.array_sort(F.collect_list(entry)).alias("l")).select(*(F.col(f"l.{c}").alias(c) for c in ("i", "w", "n2", "h2", "block")))
    turns = 1
    if most * ENTRY > TURN:
        lists = stored(lists, "lists")
        let_go(lists.sparkSession)
        sent = lists.agg(F.sum(F.size("i").cast("long") * F.size(F.array_distinct("block")))).first()[0] or 0
        turns = max(1, -(-sent * ENTRY // TURN))

    def one(turn: int) -> DataFrame:
        dealt = _parts_of(known, lists, turn, turns)
        found = dealt.where("block >= 0").groupBy("block").applyInArrow(_best_of(k, cosine, whole), "a long, b long, sim double, rank long" if whole else FOUND)
        if not split:
            return found
        sums = dealt.where("block < 0").groupBy("block").applyInArrow(_partial, "a long, b long, dot double, na double, nb double, ha double, hb double")
        sums = sums.groupBy("a", "b").agg(F.sum("dot").alias("dot"), *(F.first(c).alias(c) for c in ("na", "nb", "ha", "hb")))
        if whole:
            return found.unionByName(_ranked(sums, k, cosine))
        scale = F.col("na") * F.col("nb") if cosine else F.lit(1.0)
        sums = sums.withColumn("s", _score(cosine)).withColumn("place", F.row_number().over(W.partitionBy("a").orderBy(F.desc("s"), "b")))
        kth = F.coalesce(F.max(F.when(F.col("place") == k, F.col("s"))).over(W.partitionBy("a")), F.lit(0.0))
        sums = sums.withColumn("t", kth).withColumn("more", F.col("ha") > 0)
        return found.unionByName(sums.where((F.col("place") <= k) | F.col("more") & (F.col("dot") / scale + F.col("ha") * F.col("hb") / scale >= F.col("t") - SLACK)).select(*found.columns))

    return in_turns(turns, one, "turn")


BLOCKS = "block long, edge double, ids array<bigint>, n array<double>, norm array<double>, t array<double>, sizes array<int>, users array<bigint>, w array<double>, distinct_users array<bigint>"


def _dense(vectors: DataFrame, by: Column) -> DataFrame:
    """Items (i, n, norm, t, v) with their heavy users in blocks, in order of `by`, whose least value is edge."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        made, held, at = 0, 0, TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            users = [x["u"] for r in rows for x in r["v"]]
            out = {"block": (at << 32) + made, "edge": min(r["by"] for r in rows), "ids": [r["i"] for r in rows], "n": [r["n"] for r in rows], "norm": [r["norm"] for r in rows], "t": [r["t"] for r in rows]}
            out |= {"sizes": [len(r["v"]) for r in rows], "users": users, "w": [x["w"] for r in rows for x in r["v"]], "distinct_users": sorted(set(users))}
            return pa.RecordBatch.from_pylist([out], schema=kind)

        for b in batches:
            for r in b.to_pylist():
                if rows and (len(rows) == BLOCK_ITEMS or held + len(r["v"]) > BLOCK_ENTRIES):
                    yield block()
                    rows, made, held = [], made + 1, 0
                rows.append(r)
                held += len(r["v"])
        if rows:
            yield block()

    out = vectors.sparkSession.createDataFrame([], BLOCKS).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(out)
    return stored(vectors.withColumn("by", by).repartitionByRange("by").sortWithinPartitions("by").mapInArrow(pack, out), "blocks")


def _multiply(k: int, cosine: bool):
    """A function of pairs of blocks that gives (a, b, dot, na, nb): for each item of the first the
    best k of the second that reach its t."""

    def matrix(sizes, users, w, tile):
        at = np.searchsorted(tile, users)
        ok = (at < len(tile)) & (tile[np.minimum(at, len(tile) - 1)] == users)
        out = np.zeros((len(sizes), len(tile)))
        out[np.repeat(np.arange(len(sizes)), sizes)[ok], at[ok]] = w[ok]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x, y = ({c: np.asarray(b.column(b.schema.get_field_index(f"{s}_{c}"))[r].values) for c in ("ids", "n", "norm", "t", "sizes", "users", "w")} for s in "xy")
                both = np.intersect1d(x["users"], y["users"])
                dot = np.zeros((len(x["ids"]), len(y["ids"])))
                for i in range(0, len(both), TILE):
                    tile = both[i : i + TILE]
                    dot += matrix(x["sizes"], x["users"], x["w"], tile) @ matrix(y["sizes"], y["users"], y["w"], tile).T
                score = dot / (x["n"][:, None] * y["n"][None, :]) if cosine else dot
                ok = (dot > 0) & (score >= x["t"][:, None] - SLACK) & (x["ids"][:, None] != y["ids"][None, :])
                row, col = np.nonzero(ok)
                s = rounded(score[row, col]) if cosine else score[row, col]
                order = np.lexsort((y["ids"][col], -s, row))
                row, col = row[order], col[order]
                starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
                place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
                row, col = row[place < k], col[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x["ids"][row], y["ids"][col], dot[row, col], x["n"][row], y["n"][col])], names=["a", "b", "dot", "na", "nb"])

    return run


def block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(x, y): blocks that share a heavy user and whose norms are large enough for each other."""
    x = left.select(F.col("block").alias("x"), F.col("edge").alias("least"), F.explode("distinct_users").alias("u"))
    y = right.select(F.col("block").alias("y"), (-F.col("edge")).alias("most"), F.explode("distinct_users").alias("u"))
    return x.join(y, "u").where(F.col("most") >= F.col("least") - SLACK).select("x", "y").distinct()


def _with_heavy(light: DataFrame, heavy: DataFrame, k: int, cosine: bool) -> DataFrame:
    """(a, b, dot, na, nb) of all pairs that can be among the best, for items with heavy users."""
    light = stored(light, "light")
    own = light.where("more")
    # Pairs known from light users: what heavy users add to them.
    a = heavy.select(F.col("i").alias("a"), "u", F.col("w").alias("wa"))
    b = heavy.select(F.col("i").alias("b"), "u", F.col("w").alias("wb"))
    added = own.select("a", "b").join(a, "a").join(b, ["u", "b"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("add"))
    met = own.join(added, ["a", "b"], "left").select("a", "b", (F.col("dot") + F.coalesce("add", F.lit(0.0))).alias("dot"), "na", "nb")
    # Pairs that heavy users alone make.
    t = own.groupBy(F.col("a").alias("i")).agg(F.max("t").alias("t"))
    norm = F.col("h") / F.col("n") if cosine else F.col("h")
    vectors = heavy.groupBy("i").agg(F.first("n").alias("n"), F.first(norm).alias("norm"), F.array_sort(F.collect_list(F.struct("u", "w"))).alias("v")).join(t, "i", "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
    vectors = stored(vectors.select("i", "n", "norm", "t", "v"), "vectors")
    left, right = _dense(vectors, F.col("t") / F.col("norm")), _dense(vectors, -F.col("norm"))
    names = ("ids", "n", "norm", "t", "sizes", "users", "w")
    pairs = block_pairs(left, right)
    for side, blocks in (("x", left), ("y", right)):
        pairs = pairs.join(blocks.select(F.col("block").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in names)), side)
    alone = pairs.mapInArrow(_multiply(k, cosine), "a long, b long, dot double, na double, nb double").join(own.select("a", "b"), ["a", "b"], "left_anti")
    return met.unionByName(alone).unionByName(light.where("NOT more").select("a", "b", "dot", "na", "nb"))


def top_similar(ui: DataFrame, of: str, over: str, k: int, cosine: bool = True, light: int = LIGHT, products: int = PRODUCTS) -> DataFrame:
    """(a, b, sim, rank): for each value a of column `of` the k others with the greatest cosine of their
    weights over column `over` (cosine=False: the greatest sum of products), above 0; ties go to the
    least b. ui has one row for each pair of both, and weights that are not negative.

    Ids that are not integers are numbered in their order first. light: how many
    items a user may have for its list to be multiplied as it is; products: how many a task makes."""
    numbers = {}
    for c in (of, over):
        if dict(ui.dtypes)[c] not in {"tinyint", "smallint", "int", "bigint"}:
            numbers[c] = placed(ui.select(c).where(F.col(c).isNotNull()).distinct(), c, out="_i")
            ui = ui.join(numbers[c], c).drop(c).withColumnRenamed("_i", c)
    e = ui.select(F.col(of).cast("long").alias("i"), F.col(over).cast("long").alias("u"), F.col("weight").cast("double").alias("w")).where("i IS NOT NULL AND u IS NOT NULL AND w <> 0")
    e = stored(e.join(e.groupBy("u").agg(F.count("*").alias("d")), "u"), "interactions")
    square, few = F.col("w") * F.col("w"), F.col("d") <= light
    items = e.groupBy("i").agg(F.sum(square).alias("n2"), F.sum(F.when(few, 0.0).otherwise(square)).alias("h2"), F.sum(F.when(few, F.col("d")).otherwise(0)).alias("made"), F.min("w").alias("least"))
    items = stored(items, "items")
    most, total, strong, least = items.agg(F.coalesce(F.max("made"), F.lit(0)), F.coalesce(F.sum("made"), F.lit(0)), F.coalesce(F.max("h2"), F.lit(0.0)), F.coalesce(F.min("least"), F.lit(0.0))).first()
    if least < 0:
        raise ValueError("weights must not be negative")
    # Items with more products than a task makes have blocks of their own, one for each part of their users; the
    # others are cut into ranges of equal numbers of products, so a list goes to few blocks where ids that
    # lie near each other are liked together, and to no more than it has items anywhere.
    parts = F.ceil(F.col("made") / products)
    own = -1 - F.pmod(F.xxhash64("i", F.pmod(F.xxhash64("u"), parts)), F.lit(2**62))
    items = sums_before(items.select("i", "n2", "h2", "made"), "i", before=F.when(F.col("made") > products, 0).otherwise(F.col("made")))
    known = e.join(items, "i").withColumn("block", F.when(parts > 1, own).otherwise(F.floor(F.col("before") / products))).drop("made", "before")
    best = _light(known.where(few), k, cosine, most > products, not strong > 0, total)
    if strong > 0:
        best = _ranked(_with_heavy(best, stored(known.where(~few).withColumns({"n": F.sqrt("n2"), "h": F.sqrt("h2")}), "heavy"), k, cosine), k, cosine)
    if of in numbers:
        name = lambda c: numbers[of].select(F.col("_i").alias(c), F.col(of).alias(f"_{c}"))
        best = best.join(name("a"), "a").join(name("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "sim", "rank")
    return best
