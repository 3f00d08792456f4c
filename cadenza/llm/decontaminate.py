"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised (lower case, runs of other than letters and digits as one
space) and taken as UTF-8 bytes, of which one is an edit: another letter outside ASCII
costs as many as it has bytes. An item of m bytes may differ by a budget of
e = error_rate * m edits; cut into e + 1 pieces, one of them stands unchanged in any match. All pieces
of all items are searched at once; around each hit the whole item is verified by
Myers' bit-parallel edit distance against the text near the hit, so results are
exact for the budget. An item stands between word borders: it and the text are taken with a
space before and behind, so an item of less than 1 / error_rate bytes matches whole words only, and a border
that is missing costs a longer one an edit.

The benchmark is small beside the corpus and its size is checked: its pieces are
broadcast in sets of at most `items_per_scan` items and some SCAN_BYTES of text, one pass
over the texts for each set, so a larger benchmark takes more passes and not more memory.

Results for special inputs: null or empty texts and items match nothing; equal
items and rows each give their own rows; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.08
ITEMS_PER_SCAN = 20_000
SCAN_BYTES = 1 << 24
_TEXT_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def normalised(text: str | None) -> str:
    """One character for each UTF-8 byte, words joined by single spaces."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_TEXT_BYTES).split()).decode("latin-1")


def edit_distance(pattern_bits: dict[str, int], m: int, text: str) -> int:
    """The least edit distance of the pattern to any part of text (Myers, 1999)."""
    mask, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = mask, 0, m, m
    for c in text:
        eq = pattern_bits.get(c, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        more, less = down | (~(zero | up) & mask), up & zero
        if more & high:
            score += 1
        elif less & high:
            score -= 1
        more, less = (more << 1) & mask, (less << 1) & mask
        up, down = less | (~(zero | more) & mask), more & zero
        best = min(best, score)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        self.budget = [int(len(t) * error_rate) for _, t in items]
        self.items = items = [(i, f" {t} ") for i, t in items]
        self.bits = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(items):
            bits: dict[str, int] = {}
            for i, c in enumerate(t):
                bits[c] = bits.get(c, 0) | 1 << i
            self.bits.append(bits)
            parts = self.budget[k] + 1
            cuts = [len(t) * p // parts for p in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(t[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for p, at in pieces.items():
            self.automaton.add_word(p, (len(p), at))
        self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """(item's place, edit distance) of the items that text holds."""
        t = f" {normalised(text)} "
        starts: dict[int, list[int]] = {}
        for end, (n, at) in self.automaton.iter(t):
            for k, a in at:
                starts.setdefault(k, []).append(end + 1 - n - a)
        out = []
        for k, found in starts.items():
            m, e = len(self.items[k][1]), self.budget[k]
            best = e + 1
            found.sort()
            i = 0
            while i < len(found) and best:
                first = last = found[i]
                while i < len(found) and found[i] - last <= 2 * e:  # near starts share a window
                    last = found[i]
                    i += 1
                best = min(best, edit_distance(self.bits[k], m, t[max(0, first - e) : last + m + e]))
            if best <= e:
                out.append((k, best))
        return out


def _item_sets(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in sets that are fit to broadcast."""
    items: list[tuple[int, str]] = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).toLocalIterator():
        if text := normalised(row.text):
            items.append((row.item_id, text))
            held += len(text)
        if len(items) == size or held >= SCAN_BYTES:
            yield items
            items, held = [], 0
    if items:
        yield items


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, items_per_scan: int = ITEMS_PER_SCAN) -> DataFrame:
    """(item_id, doc_id, distance) of each row of docs that holds a benchmark item
    within its edit budget, and of that item."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = spark.createDataFrame([], "item_id long, doc_id long, distance long")
    for items in _item_sets(benchmark, items_per_scan):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate)
            for b in batches:
                rows = [(matcher.items[k][0], d.as_py(), e) for d, t in zip(*b.columns, strict=True) for k, e in matcher.matches(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["item_id", "doc_id", "distance"])

        found = found.unionByName(texts.mapInArrow(run, found.schema))
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, items_per_scan: int = ITEMS_PER_SCAN) -> DataFrame:
    """The rows of docs, as they are, that hold no benchmark item."""
    for items in _item_sets(benchmark, items_per_scan):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate)
            for b in batches:
                yield b.filter(pa.array([not matcher.matches(t.as_py()) for t in b.column("text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
