"""Ranked lexical search over inverted lists, by branch and bound.

index() cuts all rows into ranges of some thousand documents, where they are read, and
writes for each range a row with its documents' sizes and a row for each term with the
documents that hold it and how often: packed arrays, so that a term of all documents has a
row for each range and no more.

search() takes queries in sets of bounded size. Number and length of documents and the number
that hold each term come from the index; a term's share in a document's score follows from them.
For each range of documents a hierarchical max tree for each term has, for blocks of 16, 256, ...
documents, the greatest share the term has in one of them. A query goes best first: the node with the
highest sum of its terms' maxima is opened next, down to documents, and the search ends when that sum is
below the lowest score kept; nodes with an equal sum are opened, as they may hold documents that
win the tie. One range in 16, by hash, is searched first: the scores found there are bounds
for the rest, where most ranges then end at their root. So each range gives at most k rows a query, whatever order
ranges are searched in, and the k best of these are the answer.

A task holds one range: up to SHARD_DOCS documents and SHARD_TERMS terms (a single longer text is a
range of its own).

Results for special inputs: null and empty texts and those without terms are found by nothing and count
nowhere; queries without terms, or whose terms no document holds, have no rows; equal queries (id and text) count once, and
those that share an id but no text are ranked each for itself; equal documents are
found each; a document without a key comes after those of equal score with one; very long
texts are taken whole; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_long, release, stored

# Fixed values of the score: a thousand times the natural logarithm, and lengths in hundredths.
UNIT, SCALE, FLAT, SLOPE, GAIN = 1000, 1_000_000_000, 10, 90, 8
FAN = 16  # children of a node
SHARD_DOCS, SHARD_TERMS = 1 << 12, 1 << 21
QUERIES, QUERY_TERMS = 20_000, 1 << 19  # of a set of queries
FIRST = 16  # one range in so many is searched first

# A-Z in lower case; other ASCII but letters and digits as blanks.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def _bytes(column: pa.Array) -> Iterator[bytes | None]:
    return (x.as_buffer().to_pybytes() if x.is_valid else None for x in column.cast(pa.large_string()))


INDEX = "shard long, term string, places array<int>, counts array<int>, ids array<bigint>"


class _Range:
    """Documents of a range of the index, and its rows."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.known: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []

    def add(self, key: int | None, terms: list[bytes]) -> None:
        known = self.known
        self.ids.append(key)
        self.sizes.append(len(terms))
        self.terms.append(np.fromiter((known.setdefault(t, len(known)) for t in terms), np.int64, len(terms)))

    def rows(self, shard: int) -> pa.RecordBatch:
        """First the documents: ids, and their sizes in counts; then a row for each term."""
        n = len(self.ids)
        held = np.concatenate(self.terms) * n + np.repeat(np.arange(n), self.sizes)
        pairs, counts = np.unique(held, return_counts=True)
        term, place = pairs // n, pairs % n
        starts = np.searchsorted(term, np.arange(len(self.known) + 1))
        rows = 1 + len(self.known)
        offsets = np.append(0, starts + n)
        places = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.append(np.arange(n), place), pa.int32()))
        amounts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.append(self.sizes, counts), pa.int32()))
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.full(rows, n)), pa.int32()), pa.array(self.ids, pa.int64()))
        names = pa.array([None, *self.known], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows, shard), pa.int64()), names, places, amounts, ids], names=["shard", "term", "places", "counts", "ids"])


def index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The index of docs, a table in the shared folder: for each range (shard) of documents a row
    without term with ids and sizes (counts), and a row for each term with the places of
    documents in ids and how often each holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made, held, at = _Range(), 0, 0, TaskContext.get().partitionId()
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), _bytes(b.column(1)), strict=True):
                if terms := terms_of(t):
                    own.add(k, terms)
                    held += len(terms)
                if len(own.ids) >= shard_docs or held >= shard_terms:
                    yield own.rows((at << 32) + made)
                    own, made, held = _Range(), made + 1, 0
        if own.ids:
            yield own.rows((at << 32) + made)
        release()

    return stored(as_long(docs, key, text).mapInArrow(run, INDEX), "lexical", keep=True)


def _query_sets(queries: DataFrame, text: str, key: str) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Distinct queries with their distinct terms, in sets that are fit to broadcast."""
    found: list[tuple[int | None, list[str]]] = []
    held = 0
    for row in as_long(queries, key, text).distinct().toLocalIterator():
        if terms := sorted({t.decode() for t in terms_of(row[1].encode() if row[1] else None)}):
            found.append((row[0], terms))
            held += len(terms)
        if len(found) == QUERIES or held >= QUERY_TERMS:
            yield found
            found, held = [], 0
    if found:
        yield found


def weight(n: int, df: int) -> int:
    return math.floor(UNIT * math.log((2 * n + 2) / (2 * df + 1)))


class MaxTree:
    """Terms' shares in the scores of a range's documents, and their maxima over blocks of
    documents: levels[0] has blocks of FAN documents, each later one of FAN nodes of the one before."""

    def __init__(self, n: int, lists: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """lists: for each term its documents, ascending, and its shares."""
        blocks = -(-n // FAN)
        level = np.zeros((len(lists), blocks), np.int64)
        for t, (d, c) in enumerate(lists):
            np.maximum.at(level[t], d // FAN, c)
        self.levels = [level]
        while level.shape[1] > 1:
            level = np.pad(level, ((0, 0), (0, -level.shape[1] % FAN))).reshape(len(lists), -1, FAN).max(axis=2)
            self.levels.append(level)
        # Each document's terms and shares, one document after the other.
        docs = np.concatenate([d for d, _ in lists])
        order = np.argsort(docs, kind="stable")
        self.term = np.repeat(np.arange(len(lists)), [len(d) for d, _ in lists])[order]
        self.share = np.concatenate([c for _, c in lists])[order]
        self.start = np.searchsorted(docs[order], np.arange(blocks * FAN + 1))

    def best(self, terms: list[int], k: int, least: int, tie: np.ndarray) -> list[tuple[int, int]]:
        """(score, document): the k best of the sum over terms, of at least `least` and above 0, ties by
        the lesser tie. Best first; a node is opened if its bound is not below the lowest score kept."""
        levels = [level[terms] for level in self.levels]
        heap = [(-int(levels[-1][:, 0].sum()), len(levels) - 1, 0)]
        kept: list[tuple[int, int, int]] = []  # (score, -tie, document), the worst first
        least = max(least, 1)
        asked = np.zeros(len(self.levels[0]), np.int64)
        asked[terms] = 1
        while heap and -heap[0][0] >= least:
            _, level, node = heapq.heappop(heap)
            if level:
                first = node * FAN
                bounds = levels[level - 1][:, first : first + FAN].sum(axis=0)
                for at in np.flatnonzero(bounds >= least):
                    heapq.heappush(heap, (-int(bounds[at]), level - 1, first + int(at)))
                continue
            start = self.start[node * FAN : node * FAN + FAN + 1]
            held = slice(start[0], start[-1])
            sums = np.append(0, np.cumsum(self.share[held] * asked[self.term[held]]))[start - start[0]]
            scores = sums[1:] - sums[:-1]
            for at in np.flatnonzero(scores >= least):
                d = node * FAN + int(at)
                row = (int(scores[at]), -int(tie[d]), d)
                if len(kept) < k:
                    heapq.heappush(kept, row)
                else:
                    heapq.heappushpop(kept, row)
                if len(kept) == k:
                    least = max(least, kept[0][0])
        return [(score, d) for score, _, d in kept]


def search(found: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", key: str = "item_id") -> DataFrame:
    """(key, rank, doc_id, score): for each query the k best documents of an index, scores above 0, highest
    first, ties by the lesser doc_id."""
    spark = found.sparkSession
    n, length = found.where("term IS NULL").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()
    out = spark.createDataFrame([], f"_q long, {key} long, doc_id long, score long")
    for number, items in enumerate(_query_sets(queries, text, key)):
        names = sorted({t for _, terms in items for t in terms})
        wanted = spark.createDataFrame(pa.table({"term": names}))
        counts = found.where("term IS NOT NULL").join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum(F.size("places")).alias("df"))
        weights = {t: weight(n, df) for t, df in counts.toLocalIterator()}
        parts = found.join(F.broadcast(wanted), "term", "left_semi").unionByName(found.where("term IS NULL"))
        asked = [(number * QUERIES + i, item, [t for t in terms if weights.get(t)]) for i, (item, terms) in enumerate(items)]
        shared = spark.sparkContext.broadcast((weights, asked, n, length))
        part = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
        first = stored(_best(parts.where(part), shared, {}, k, out), "searched", keep=True)
        place = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score")))
        bounds = first.select("_q", "score").withColumn("i", place).where(F.col("i") == k)
        least = spark.sparkContext.broadcast(dict(tuple(r) for r in bounds.select("_q", "score").toLocalIterator()))
        out = out.unionByName(first).unionByName(_best(parts.where(~part), shared, least, k, out))
    place = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select(key, "rank", "doc_id", "score")


def _best(parts: DataFrame, shared, least, k: int, like: DataFrame) -> DataFrame:
    """The best of each range for each query, of at least what `least` has for it."""
    columns = like.columns

    def run(group: pa.Table) -> pa.Table:
        weights, asked, n, length = shared.value
        bounds = least.value if least else {}
        names = group.column("term").to_pylist()
        head = names.index(None)
        ids = group.column("ids")[head].values
        size = group.column("counts")[head].values.to_numpy().astype(np.int64)
        # Ties go to the lesser id, those without last.
        order = ids.to_numpy(zero_copy_only=False) if not ids.null_count else np.array([np.inf if x is None else x for x in ids.to_pylist()], object)
        tie = np.empty(len(ids), np.int64)
        tie[np.argsort(order, kind="stable")] = np.arange(len(ids))
        m = FLAT + (SLOPE * size * n) // length
        number, lists = {}, []
        for row, term in enumerate(names):
            if w := weights.get(term):
                d = group.column("places")[row].values.to_numpy()
                tf = group.column("counts")[row].values.to_numpy().astype(np.int64)
                number[term] = len(lists)
                lists.append((d, w * ((SCALE * tf) // (UNIT * tf + GAIN * m[d]))))
        rows = []
        if lists:
            tree = MaxTree(len(ids), lists)
            for q, item, terms in asked:
                if own := [number[t] for t in terms if t in number]:
                    rows += [(q, item, ids[d].as_py(), score) for score, d in tree.best(own, k, bounds.get(q, 0), tie)]
        kinds = [pa.int64()] * 4
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=columns)

    return parts.groupBy("shard").applyInArrow(run, like.schema)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of docs (doc_id, text) for each of queries (item_id, text)."""
    return search(index(docs), queries, k)
