"""Near-duplicates by bottom-k sketches.

A document's set holds the 64-bit hashes of its five-word shingles. Documents with
equal sets form a class, so exact copies cost nothing further. Each class keeps the
k smallest hashes of its set, from the one hash function.

Inverted lists. Two sets with Jaccard similarity of 3/4 share most of what they
retain: all that small sets need (3/4 of the set, sketch and set being the same),
or else at least `least_overlap(k)` values but for one pair in some 10^8. With
retained values in one global order, rarest first, such a pair must share one of
each class's first k - least + 1 values; later, more frequent ones need no list. So
what a third of all documents have in common makes no candidates unless it is most
of those documents. Values that one class alone retains have no list at all.

Long lists. Classes that stand in a list of over LONG members by their sketches are
taken by themselves: there the same filter is applied to full sets, counted among
themselves, where a pair must share 3/4 of the larger set and so one of the rarest
quarter of either. Short lists of these make pairs. What still has long lists is
mostly versions of one text; they are compared with the list's most central member
(whose values are the most frequent), and those whose component is not the central
member's with all members, block against block inside tasks, which give out the
components of a block and no pairs. So no list is cut short.

Candidate pairs whose union sketch makes the threshold most unlikely go. The rest are
verified on full sets, first each class's most similar candidate, then those
candidates that still lie in different components.

Results for special inputs: null, empty and blank texts have an empty set and are
linked with nothing (component_id is their own doc_id); texts under five words are
one shingle; a null doc_id is never a component_id unless all of a component are
null, and kept is false for it; equal rows share a result; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, release, small_batches, stored, temporary_tables, tidy
from .components import components

K = 64
SHINGLE = 5
LONG = 64
BLOCK = 1000
BLOCK_VALUES = 1 << 20  # hashes that the sets of a block hold together
SLACK = 0.30  # of the estimate: over five standard deviations at k = 64
WORD_CACHE = 50_000
NOT_EMPTY = r"text rlike '[^\\x20\\x09-\\x0D]'"  # it has a word
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: dict, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for i in range(min(size, len(h))):
        out = (out * _ODD) ^ h[i : i + n]
        out ^= out >> np.uint64(29)
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique((out >> np.uint64(1)).view(np.int64))


def least_overlap(k: int) -> int:
    """What the sketches of two large sets share at least, six standard deviations
    below the mean for a set and its subset of similarity 3/4."""
    return int(0.75 * k - 6 * (0.1875 * k) ** 0.5)


def _key(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes()).digest()


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text_hash, n, key, sketch) of each row; key: of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            n, keys, low = [], [], []
            for t in b.column(1):  # one set at a time in memory
                s = shingle_set(t.as_py(), hashes)
                n.append(len(s))
                keys.append(_key(s) if len(s) else None)
                low.append(s[:k].copy())
            ends = np.cumsum([0, *map(len, low)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *low])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(ends, flat)],
                names=["doc_id", "text_hash", "n", "key", "sketch"],
            )
        hashes.clear()
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, key binary, sketch array<long>")


def _similar_size(a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= 75 * greatest({a}, {b})"


def lists(values: DataFrame, classes: DataFrame, kept: str, need: str) -> DataFrame:
    """The inverted lists (v, cid, n, central) of values (cid, v): for each class those
    that a similar class must share one of, where more classes than one hold them.
    kept: how many values the class has; need: how many a similar one has of them."""
    often = stored(values.groupBy("v").agg(F.count("*").alias("f")).where("f > 1"), "often")
    total = often.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    shared = join_counted(values, often, "v", "f", total, rare=True).groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("m"))
    found = shared.join(classes.select("cid", "n"), "cid").withColumn("kept", F.expr(kept)).withColumn("first", F.expr(f"cast(size(m) - ({need}) + 1 AS int)"))
    central = F.expr("aggregate(m, 0D, (x, y) -> x + ln(y.f)) / kept")
    found = found.withColumn("central", central).where("first > 0").select("cid", "n", "central", F.explode(F.slice("m", F.lit(1), F.col("first"))).alias("x"))
    return found.select(F.col("x.v").alias("v"), "cid", "n", "central")


def _sized(found: DataFrame) -> DataFrame:
    """Lists of two or more with their size and most central member."""
    at = F.struct("central", "cid")
    found = stored(found, "lists")
    sizes = stored(found.groupBy("v").agg(F.count("*").alias("f"), F.max_by("cid", at).alias("hub"), F.max_by("n", at).alias("hub_n")).where("f > 1"), "sizes")
    return stored(join_counted(found, sizes, "v", "f", sizes.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0], rare=True), "sized")


def _all_pairs(short: DataFrame) -> DataFrame:
    """Pairs (a, b) of the members of short lists that are of like size."""
    side = short.select("v", "cid", "n")
    return side.toDF("v", "a", "na").join(side.toDF("v", "b", "nb"), "v").where(f"a < b AND {_similar_size('na', 'nb')}").select("a", "b")


def _estimated(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """pairs (a, b) whose union sketch doesn't rule out the threshold, with est."""
    s = classes.select("cid", "sketch")
    both = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    est = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) / F.size(union)
    return both.select("a", "b", est.alias("est")).where(F.col("est") >= 0.75 - SLACK)


def _full_sets(cids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, hashes) of some classes, made anew from the texts of those alone."""
    wanted = stored(cids.join(classes.select("cid", "key", "text_hash", "copies"), "cid"), "wanted")
    total = wanted.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            cids, found = [], []
            for c, key, t in zip(*b.columns, strict=True):
                s = shingle_set(t.as_py(), hashes)
                if _key(s) == key.as_py():
                    cids.append(c.as_py())
                    found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(found, pa.binary())], names=["cid", "hashes"])
        hashes.clear()
        release()

    texts = join_counted(docs.select("text", F.xxhash64("text").alias("text_hash")), wanted, "text_hash", "copies", total, rare=True)
    # One of the copies of a text; another text of that hash is told apart by its set.
    once = texts.select("cid", "key", "text", F.md5("text").alias("md5")).dropDuplicates(["cid", "md5"]).drop("md5")
    return stored(once.mapInArrow(sets, "cid long, hashes binary"), "sets")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have a similarity of 3/4 or more."""
    full = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), classes, docs)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.int64) for z in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= 75 * (len(p) + len(q) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
        release()

    joined = pairs.select("a", "b").join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(check, "a long, b long")


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links that join all components which verified ones of the pairs (a, b, est) join."""
    ends = pairs.select("a", "b", "est", F.explode(F.array("a", "b")).alias("x"))
    best = stored(ends.groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("est", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "best")
    links = stored(_verified(best, classes, docs), "links")
    tidy(docs.sparkSession)
    comp = stored(components(links), "components")
    tidy(docs.sparkSession)
    more = stored(_verified(_across(pairs.join(best, ["a", "b"], "left_anti"), comp), classes, docs), "links")
    return _joined(comp, more)


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Links (a, b) that join the nodes of components and what further links join."""
    return comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(links)


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    p = pairs.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left")
    return p.where("coalesce(ca, a) <> coalesce(cb, b)").drop("ca", "cb")


def _values(sets: DataFrame) -> DataFrame:
    """(cid, v) of full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, h in zip(*b.columns, strict=True):
                v = np.frombuffer(h.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c.as_py()), pa.int64()), pa.array(v)], names=["cid", "v"])

    return sets.mapInArrow(run, "cid long, v long")


def _block_links(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets [left, right] have a similarity of 3/4 or more."""
    size, every = [np.array([len(x) for x in side]) for side in (left, right)], np.concatenate([*left, *right])
    values, at, n = np.unique(every, return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(left) + len(right)), np.concatenate(size))
    place = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[at]  # values of one set alone don't matter
    both = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int((n > 1).sum()), 4096):
        some = (place >= first) & (place < first + 4096)
        m = np.zeros((len(left) + len(right), 4096), np.float32)
        m[of[some], place[some] - first] = 1
        both += m[: len(left)] @ m[len(left) :].T
    return 100 * both >= 75 * (size[0][:, None] + size[1][None, :] - both)


def _across_blocks(members: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join what links between members (g, cid, outside) of a group
    join, at least one of the two outside."""
    m = stored(members.join(sets, "cid").withColumn("n", F.octet_length("hashes") / 8), "sets")
    parts = lambda rows, values: F.ceil(F.greatest(rows / block, values / BLOCK_VALUES)).cast("int")
    own = F.when(F.col("outside"), F.col("n"))
    parts = m.groupBy("g").agg(F.count("*").alias("f"), parts(F.count("*"), F.sum("n")).alias("q_of"), parts(F.count(own), F.sum(own)).alias("p_of")).where("p_of > 0")
    m = join_counted(m, parts, "g", "f", m.count())
    all_ = m.select("g", F.explode(F.sequence(F.lit(0), F.col("p_of") - 1)).alias("p"), F.pmod(F.xxhash64("cid"), F.col("q_of")).cast("int").alias("q"), F.lit(False).alias("left"), "cid", "hashes")
    out = m.where("outside").select("g", F.pmod(F.xxhash64("cid"), F.col("p_of")).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("q_of") - 1)).alias("q"), F.lit(True).alias("left"), "cid", "hashes")

    def compare(t: pa.Table) -> pa.Table:
        left, right = t.filter(t["left"]), t.filter(pa.compute.invert(t["left"]))
        a, b = left["cid"].to_numpy(), right["cid"].to_numpy()
        links = []
        if len(a) and len(b):
            near = _block_links(*([np.frombuffer(h, np.int64) for h in x["hashes"].to_pylist()] for x in (left, right)))
            x, y, high = a.copy(), b.copy(), np.iinfo(np.int64).max
            while True:  # the least cid that links reach within the block
                x2 = np.minimum(x, np.where(near, y[None, :], high).min(axis=1))
                y2 = np.minimum(y, np.where(near, x2[:, None], high).min(axis=0))
                if (x2 == x).all() and (y2 == y).all():
                    break
                x, y = x2, y2
            links = [(c, r) for c, r in zip([*a, *b], [*x, *y], strict=True) if c != r]
        return pa.table({"a": pa.array([int(r) for _, r in links], pa.int64()), "b": pa.array([int(c) for c, _ in links], pa.int64())})

    return all_.unionByName(out).groupBy("g", "p", "q").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = K, long: int = LONG) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the least
    doc_id reachable over links of similarity 3/4 or more) and kept."""
    with small_batches(docs.sparkSession), temporary_tables(docs.sparkSession):
        out = _labelled(docs, k, long).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _labelled(docs: DataFrame, k: int, long: int) -> DataFrame:
    """(doc_id, text_hash, n, comp, component_id) of each row; comp, the component, is
    null for an empty set."""
    rows = stored(sketches(docs, k), "sketches")
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first(F.struct("text_hash", "n", "sketch")).alias("x"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), "key", "least_id", "copies", "x.*"), "classes")
    need = f"CASE WHEN n <= {3 * k // 4} THEN (3 * n + 3) div 4 ELSE {least_overlap(k)} END"
    sized = _sized(lists(classes.select("cid", F.explode("sketch").alias("v")), classes, f"least(n, {k})", need))
    tidy(docs.sparkSession)
    pairs, many = _all_pairs(sized.where(f"f <= {long}")), sized.where(f"f > {long}").select("cid").distinct()
    hot = None
    if not many.isEmpty():
        sets = _full_sets(many, classes, docs)
        tidy(docs.sparkSession)
        again = _sized(lists(_values(sets), classes, "n", "(3 * n + 3) div 4"))
        hot = again.where(f"f > {long}")
        hubs = hot.where(f"cid <> hub AND {_similar_size('n', 'hub_n')}").select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b"))
        pairs = pairs.unionByName(_all_pairs(again.where(f"f <= {long}"))).unionByName(hubs)
    tidy(docs.sparkSession)
    links = _linked(stored(_estimated(pairs.distinct(), classes, k), "pairs"), classes, docs)
    comp = stored(components(links), "components")
    if hot is not None:
        met = hot.select("cid", "hub").join(comp.toDF("cid", "c"), "cid", "left").join(comp.toDF("hub", "g"), "hub", "left")
        met = met.select(F.coalesce("g", "hub").alias("g"), "cid", F.coalesce("c", "cid").alias("c")).distinct()
        members = stored(met.select("g", "cid", (F.col("c") != F.col("g")).alias("outside")), "members")
        if not members.where("outside").isEmpty():
            more = stored(_across_blocks(members, sets), "links")
            comp = stored(components(_joined(comp, more)), "components")
    tidy(docs.sparkSession)
    of_class = classes.select("cid", "key", "least_id", "copies").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = of_class.groupBy("comp").agg(F.min("least_id").alias("component_id"), F.count("*").alias("f"))
    labels = stored(join_counted(stored(of_class, "classes"), least, "comp", "f", classes.count()).select("key", "comp", "component_id", "copies"), "labels")
    linked = join_counted(rows.where("n > 0").drop("sketch"), labels, "key", "copies", rows.count()).select("doc_id", "text_hash", "n", "comp", "component_id")
    alone = rows.where("n = 0").select("doc_id", "text_hash", "n", F.lit(None).cast("bigint").alias("comp"), F.col("doc_id").alias("component_id"))
    out = stored(linked.unionByName(alone), "labelled", keep=True)
    tidy(docs.sparkSession)
    return out


def drop_near_duplicates(docs: DataFrame, k: int = K, long: int = LONG) -> DataFrame:
    """The rows of docs, as they are, but one for each group of near-duplicates: that
    with the least doc_id (one that is not null before any that is), of these that with
    the least hash of its text; of rows equal in both, any one. Rows with an empty set stay."""
    with small_batches(docs.sparkSession), temporary_tables(docs.sparkSession):
        rows = _labelled(docs.select("doc_id", "text"), k, long).where("comp IS NOT NULL")
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
        chosen = rows.groupBy("comp").agg(F.min(place).alias("p")).select("p.doc_id", "p.text_hash")
        rows = rows.withColumns({"own": F.lit(1), "kept": F.lit(0)}).unionByName(chosen.withColumns({"own": F.lit(0), "kept": F.lit(1)}), allowMissingColumns=True)
        wanted = stored(rows.groupBy("doc_id", "text_hash").agg(F.sum("own").alias("rows"), F.max("kept").alias("kept")).where("kept = 1"), "kept", keep=True)
    taken = set(docs.columns)
    name = lambda n: next(x for x in (n + "_" * i for i in range(len(taken) + 1)) if x not in taken)
    same = (F.col("`doc_id`").cast("long").eqNullSafe(F.col(name("kept_id")))) & (F.xxhash64("text") == F.col(name("kept_hash")))
    keys = lambda df: df.select(F.col("doc_id").alias(name("kept_id")), F.col("text_hash").alias(name("kept_hash")))
    full = docs.where(NOT_EMPTY)
    once = full.join(keys(wanted.where("rows = 1")), same, "left_semi")
    repeated = full.join(keys(wanted.where("rows > 1")), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated).unionByName(docs.where(f"NOT coalesce({NOT_EMPTY}, false)"))
