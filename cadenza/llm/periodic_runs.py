"""Periodic runs of words, by the runs theorem.

A run is a maximal stretch of words with a period at least twice in it. By the theorem of
Bannai et al. (2017) each run has an occurrence of its period's root that is the longest
Lyndon word starting at its place, in the order of words or in the opposite one. These
longest Lyndon words end before the next smaller value of the inverse suffix array, and
before the next greater one, so that there are two candidates for each place. A candidate [i, i + q) is
extended to the right by the longest common prefix of the suffixes at i and i + q, and to the
left by that of the reversed text; both are minima of the array of common prefixes
(LCP) between two places of the suffix array, answered by a sparse table.

Spark deals rows to tasks, and each row's runs are found in its task. Texts are
worked on in chunks of some 100,000 words that share one suffix array: symbols carry the
number of their text and each text ends with a mark that is its own least symbol, so no
suffix is compared over texts and a copy in another text costs nothing. The suffix array
is made by doubling: each round sorts only suffixes that are still tied, so its rounds are
the logarithm of the longest repeat inside a text. Memory is a few arrays of a chunk's
length, and the sparse table is one over blocks of 16 places; a longer text is a
chunk of its own.

Results for special inputs: null and empty texts and those of white space have no words and
no runs; a null key is carried; equal rows each get a row; columns other than key and text are
not read; very long texts are taken whole; an empty table gives no rows. Words differ by
their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_long, release

CHUNK_WORDS = 100_000
BLOCK = 16  # places of the LCP array that share an entry of the sparse table
LEAST, TIMES = 6, 4  # a run's least length, and least length over its period


class Suffixes:
    """Suffix array, its inverse and common prefixes of s, an array of symbols that is cut in
    texts by marks: each mark occurs once and is the least symbol of its text, which has
    symbols of its own."""

    def __init__(self, s: np.ndarray) -> None:
        n = len(s)
        self.s, order = s, np.argsort(s, kind="stable")
        new = np.ones(n, bool)
        new[1:] = s[order[1:]] != s[order[:-1]]
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(new, at, 0))
        rank = np.empty(n, np.int64)
        rank[order] = first  # the place of the first of those that are tied
        common = np.zeros(n, np.int64)  # with the suffix before: at least this, less than twice
        tied = self._tied(new, order)
        levels, h = [], 1
        while len(tied):
            if h > 1:
                levels.append((tied.astype(np.int32), rank[tied].astype(np.int32)))
            key = rank[tied] * n + rank[tied + h]
            o = np.argsort(key, kind="stable")
            tied, key = tied[o], key[o]
            old, k = key // n, np.arange(len(tied))
            group, part = np.ones(len(tied), bool), np.ones(len(tied), bool)
            group[1:], part[1:] = old[1:] != old[:-1], key[1:] != key[:-1]
            rank[tied] = old + np.maximum.accumulate(np.where(part, k, 0)) - np.maximum.accumulate(np.where(group, k, 0))
            split = part & ~group
            common[rank[tied[split]]] = h
            tied, h = self._tied(part, tied), 2 * h
        sa = np.empty(n, np.int64)
        sa[rank] = at
        self.rank, self.sa = rank, sa
        # The rest of each common prefix, by halves: two places are equal for 2^k symbols if
        # their ranks in that round were.
        seen = np.full(n, -1, np.int64)
        h = 1 << len(levels)
        for places, ranks in reversed(levels):
            which = np.flatnonzero(common > h)
            if len(which):
                seen[places] = ranks
                x, y = seen[sa[which] + common[which]], seen[sa[which - 1] + common[which]]
                common[which] += np.where((x == y) & (x >= 0), h, 0)
                seen[places] = -1
            h >>= 1
        which = np.flatnonzero(common > 1)
        common[which] += s[sa[which] + common[which]] == s[sa[which - 1] + common[which]]
        self.lcp = common
        self.table: list[np.ndarray] | None = None

    @staticmethod
    def _tied(new: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Those of order that are not alone in their group; new marks where groups start."""
        return order[~(new & np.append(new[1:], True))] if len(order) else order

    def _minima(self) -> None:
        """Least LCP to both ends of each block, and the sparse table over blocks."""
        full = np.append(self.lcp, np.full(-len(self.lcp) % BLOCK, np.iinfo(np.int64).max)).reshape(-1, BLOCK)
        self.prefix = np.minimum.accumulate(full, axis=1).reshape(-1)
        self.suffix = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.table = [full.min(axis=1)]
        while len(last := self.table[-1]) > (w := 1 << (len(self.table) - 1)):
            self.table.append(np.minimum(last[:-w], last[w:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes at different places a and b."""
        if self.table is None:
            self._minima()
        x, y = self.rank[a], self.rank[b]
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y)
        out = np.empty(len(lo), np.int64)
        first, last = lo // BLOCK, hi // BLOCK
        one = np.flatnonzero(first == last)
        best = np.full(len(one), np.iinfo(np.int64).max)
        for t in range(BLOCK):
            at = lo[one] + t
            best = np.where(at <= hi[one], np.minimum(best, self.lcp[np.minimum(at, hi[one])]), best)
        out[one] = best
        more = np.flatnonzero(first < last)
        best = np.minimum(self.suffix[lo[more]], self.prefix[hi[more]])
        first, width = first[more] + 1, last[more] - first[more] - 1
        level = np.frexp(width)[1] - 1
        for k in np.unique(level[width > 0]):
            w = np.flatnonzero((level == k) & (width > 0))
            row = self.table[k]
            best[w] = np.minimum(best[w], np.minimum(row[first[w]], row[first[w] + width[w] - (1 << k)]))
        out[more] = best
        return out


def _next(rank: list[int], smaller: bool) -> np.ndarray:
    """The next place with a smaller (or greater) value; the length if there is none."""
    n = len(rank)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        j, r = i + 1, rank[i]
        while j < n and (rank[j] > r) == smaller:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def find_runs(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each text, an array of numbers from 0 that stand for words: rows (start, length, period) of its runs with at
    least so many words and so many times their period (2 or more), by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1  # of each text: its mark
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    width = max((int(t.max()) for t in texts if len(t)), default=0) + 2
    marked = np.zeros(len(of), np.int64)
    inside = np.ones(len(of), bool)
    inside[ends] = False
    marked[inside] = np.concatenate([*texts, np.zeros(0, np.int64)]) + 1
    symbols = of * width + marked
    forward = Suffixes(symbols)
    rank = forward.rank.tolist()
    found = []
    places = np.arange(len(of))
    for smaller in (True, False):
        j = _next(rank, smaller)
        # Twice the root must follow it, as the first root in a run of `times` periods has; two
        # equal words and the text's end leave few.
        ok = inside & (j < ends[of])
        i = places[ok]
        j = j[ok]
        ok = (symbols[i] == symbols[j]) & (j + (times - 2) * (j - i) <= ends[of[i]])
        found.append(np.stack([i[ok], j[ok]]))
    i, j = np.concatenate(found, axis=1)
    q, right = j - i, forward.common(i, j)
    ok = right > (times - 2) * q  # a root starts within the first period of its run
    i, q, right = i[ok], q[ok], right[ok]
    if not len(i):
        return [np.zeros((0, 3), np.int64)] * len(texts)
    # Roots of one run share period and end; the first of them is kept.
    stop = i + q + right
    order = np.lexsort((i, q, stop))
    i, q, stop = i[order], q[order], stop[order]
    ok = np.ones(len(i), bool)
    ok[1:] = (stop[1:] != stop[:-1]) | (q[1:] != q[:-1])
    i, q, stop = i[ok], q[ok], stop[ok]
    # Only texts with candidates are read backwards.
    kept = np.unique(of[i])
    begin = ends[kept] - sizes[kept]
    back = np.concatenate([np.append(symbols[b:e][::-1], symbols[e]) for b, e in zip(begin, ends[kept], strict=True)])
    after = np.cumsum(sizes[kept] + 1) - 1  # marks of the reversed texts
    which = np.searchsorted(kept, of[i])
    mirrored = lambda x: after[which] - (x - begin[which])  # noqa: E731  the reversed text from the word before x
    left = Suffixes(back).common(mirrored(i), mirrored(i + q))
    start, text = i - left, of[i]
    size = stop - start
    ok = size >= np.maximum(least, times * q)
    rows = np.unique(np.stack([text, start - (ends[text] - sizes[text]), q, size], axis=1)[ok], axis=0)
    cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[a:b][:, [1, 3, 2]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run repeats: those outside of what follows a run's first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def _results(texts: list[bytes], least: int, times: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """For each text its number of words, its runs, and its words without repeats."""
    chunk: list[list[bytes]] = []

    def done() -> Iterator[tuple[int, np.ndarray, bytes]]:
        known: dict[bytes, int] = {}
        ids = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in chunk]
        for words, runs in zip(chunk, find_runs(ids, least, times), strict=True):
            kept = [words[k] for k in np.flatnonzero(kept_words(len(words), runs))] if len(runs) else words
            yield len(words), runs, b" ".join(kept)

    held = 0
    for t in texts:
        words = t.split()  # of bytes: at the six blanks of ASCII
        if chunk and held + len(words) > CHUNK_WORDS:
            yield from done()
            chunk, held = [], 0
        chunk.append(words)
        held += len(words) + 1
    if chunk:
        yield from done()


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, runs, collapsed) of each row: its number of words, its runs (start, length,
    period) of at least `least` words and `times` periods, by start, then period, and the words that are left if
    of each run only the first period stays, with one space between them."""
    if times < 2 or least < 2:
        raise ValueError("a run has at least two words and two periods")
    out = docs.sparkSession.createDataFrame([], f"{key} bigint, n_words bigint, runs {RUNS}, collapsed string").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column(1).cast(pa.large_string()))
            found = list(_results(bodies, least, times))
            lengths = np.array([len(r) for _, r, _ in found])
            flat = np.concatenate([r for _, r, _ in found])
            runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, c], pa.int64()) for c in range(3)], names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _, _ in found], pa.int64()), runs, pa.array([c for _, _, c in found], pa.binary()).cast(pa.string())], names=out.fieldNames())
        release()

    return as_long(docs, key, text).mapInArrow(run, out)


def with_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs (key, text) where each tenth text, by the crc32 of its key, repeats itself: from a word
    on, its words are those of a period that starts there."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = as_long(docs, key, text).withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_w"))
    chosen = chosen.withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n"))).withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get(F.col("_w"), place(i).cast("int"))), " ")
    return chosen.select(key, F.when(F.col("_n") > 0, repeated).otherwise(F.col(text)).alias(text))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """What periodic_runs found, in digests, with the run of the greatest length over period."""
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.reduce("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    sha: dict[str, Column] = {"runs_sha256": lines, "collapsed_sha256": F.col("collapsed")}
    b = F.col("_best")
    return found.withColumn("_best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"), b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"),
        F.floor(1000 * b["length"] / b["period"]).alias("exponent_milli"), *(F.sha2(c.cast("binary"), 256).alias(n) for n, c in sha.items())
    )
