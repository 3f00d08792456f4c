"""Mixtures of sources against a loop, and special inputs."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadenza.llm.mixing import cycled, mixed, plan

DOCS = "doc_id long, text string, source string, target string, taken int, place int"


def frame(spark, rows):
    """Rows of doc_id, text and source with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, s, "x", 7, 3) for i, t, s in rows], DOCS)


def loop(rows, weights, share=1.0, epochs=3):
    """Targets by filling up in turns, then rows in order of their digests."""
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, full = {}, sum(size.values()) * share, set()
    while True:
        open_ = [s for s in order if s not in full]
        rest = left - sum(epochs * size[s] for s in full)
        target = {s: epochs * size[s] if s in full else rest * w[s] / sum(w[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] > epochs * size[s]}
        if not over:
            break
        full |= over
    out, seen, keyed = [], Counter(), {s: [] for s in order}
    for i, t, s in rows:
        n, m = len((t or "").encode().split()), hashlib.md5((t or "").encode()).hexdigest()
        name = "null" if s is None else "=" + s
        k = f"{name}|{'' if i is None else i}|{n}|{m}"
        keyed[s].append((hashlib.md5(f"42|{k}|{seen[k]}".encode()).hexdigest(), i, n))
        seen[k] += 1
    for s in order:
        budget, before = int(target[s] + 0.5), 0
        for _, i, n in sorted(keyed[s]):
            whole, rest = divmod(budget, max(1, size[s]))
            out.append((i, n, size[s], round(target[s], 6), whole * n + max(0, min(n, rest - before))))
            before += n
    return Counter(out)


def some_rows():
    random.seed(4)
    rows = [(i, " ".join(random.choice(["a", "bé", "c,d"]) for _ in range(random.randint(0, 30))), random.choice(["web"] * 6 + ["books", "é", "Z", "", None])) for i in range(300)]
    rows += [(500 + i, "tiny", f"s{i:02}") for i in range(9)]
    rows += [(None, "no key", "web"), (None, None, None), (7, None, "none at all"), (8, " \n\t", "blank"), (9, "x " * 40_000, "web"), *rows[:20], *[(1, "same row", "web")] * 50]
    return rows


def got(df):
    return Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


@pytest.mark.parametrize("share", [1.0, 0.1, 2.5])
def test_mixture_against_a_loop(spark, share):
    rows = some_rows()
    assert got(plan(frame(spark, rows), share=share)) == loop(rows, (1, 2, 3), share)


def test_mixture_does_not_depend_on_partitions_or_ranges(spark):
    rows = some_rows()
    a = got(plan(frame(spark, rows).repartition(7), weight=cycled(5, 1)))
    assert a == got(plan(frame(spark, rows[::-1]).coalesce(1), weight=cycled(5, 1), buckets=16)) == loop(rows, (5, 1))


def test_taken_words_meet_targets(spark):
    found = plan(frame(spark, some_rows())).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.first("source_size").alias("s"), F.max(F.expr("taken > 3 * size")).alias("over")).collect()
    assert all(abs(r.n - r.t) <= 0.5 and r.n <= 3 * r.s and not r.over for r in found)
    assert abs(sum(r.t for r in found) - sum(r.s for r in found)) < 1e-6


def test_sources_without_weight_give_nothing(spark):
    df = plan(frame(spark, some_rows()), weight=F.when(F.col("source") == "web", 1).when(F.col("source") == "Z", 0))
    assert {r.source for r in df.where("taken > 0").select("source").distinct().collect()} == {"web"}
    assert df.count() == len(some_rows())


def test_mixed_texts_have_the_words_taken(spark):
    rows = some_rows()
    docs = frame(spark, rows)
    want = {(r.doc_id, r.source, r.text_md5): r.n for r in plan(docs).groupBy("doc_id", "source", "text_md5").agg(F.sum("taken").alias("n")).where("n > 0").collect()}
    out, bodies = Counter(), {(i, s, hashlib.md5((t or "").encode()).hexdigest()): (t or "") for i, t, s in rows}
    for r in mixed(docs).collect():
        keys = [k for k, t in bodies.items() if k[:2] == (r.doc_id, r.source) and (r.text == t or t.split()[: len(r.text.split())] == r.text.split())]
        out[keys[0]] += len(r.text.split())
    assert sum(out.values()) == sum(want.values())
    assert {k: v for k, v in out.items() if k[0] not in {None, 1}} == {k: v for k, v in want.items() if k[0] not in {None, 1}}


def test_empty_tables_and_tables_without_words(spark):
    assert plan(frame(spark, [])).collect() == [] and mixed(frame(spark, [])).collect() == []
    r = plan(frame(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert {(x.doc_id, x.size, x.source_size, x.target, x.taken) for x in r} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
