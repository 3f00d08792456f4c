"""Ranked search against scoring of all documents, and special inputs."""

import math
import random
import re

import numpy as np
import pytest

from cadenza.llm import lexical_search as ls

DOCS = "doc_id long, text string, score string, rank int, shard int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def score_all(docs, items, k=10):
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, w) for i, w in docs if w]
    n, length = len(docs), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, q in {(i, tuple(sorted(set(terms(t))))) for i, t in items}:
        scored = []
        for i, w in docs:
            m = 10 + 90 * len(w) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in q if t in df)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 1) for i, t in rows], DOCS)


def asked(spark, rows):
    return spark.createDataFrame([(i, t, 5) for i, t in rows], "item_id long, text string, score int")


def some(seed, n):
    random.seed(seed)
    words = [f"w{i}" for i in range(40)] + ["Über", "x-1", "naïve", "A", "b_c"]
    pick = lambda m: " ".join(random.choice(words[: random.choice([3, 12, 45])]) for _ in range(m))
    docs = [(i, pick(random.randint(0, 25))) for i in range(n)]
    docs += [(None, "w1 w2"), (None, "w1 w2"), (5001, None), (5002, ""), (5003, " .,;"), *docs[:30], (5004, pick(30_000))]
    docs += [(6000 + i, "w0 w1 same") for i in range(40)]  # ties
    items = [(i, pick(random.randint(1, 12))) for i in range(25)] + [(100, None), (101, "?!"), (102, "absent"), (103, "same"), (103, "same"), (103, "W1"), (None, "w7 W7")]
    return docs, items


@pytest.mark.parametrize(("docs", "held"), [(4096, 1 << 21), (40, 1 << 21), (7, 50)])
def test_search_against_all_documents(spark, docs, held):
    rows, items = some(docs, 400)
    found = ls.index(frame(spark, rows).repartition(3), docs, held)
    got = sorted((tuple(r) for r in ls.search(found, asked(spark, items)).collect()), key=str)
    assert got == score_all(rows, items)


def test_sets_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ls, "QUERY_TERMS", 20)
    monkeypatch.setattr(ls, "FIRST", 2)
    rows, items = some(3, 200)
    got = sorted((tuple(r) for r in ls.search(ls.index(frame(spark, rows), 50), asked(spark, items), k=3).collect()), key=str)
    assert got == score_all(rows, items, 3)


def test_tree_opens_what_it_must_and_little_more():
    random.seed(2)
    n, lists = 5000, []
    for _ in range(6):
        d = np.array(sorted(random.sample(range(n), random.choice([5, 300, 5000]))))
        lists.append((d, np.array([random.choice([1, 2, 50]) for _ in d])))
    tree, tie = ls.MaxTree(n, lists), np.array(random.sample(range(n), n))
    total = np.zeros(n, int)
    for d, c in lists:
        total[d] += c
    for k in (1, 10, 100):
        want = sorted((-int(total[d]), int(tie[d])) for d in range(n) if total[d] > 0)[:k]
        assert sorted((-s, int(tie[d])) for s, d in tree.best(list(range(6)), k, 0, tie)) == want
    least = sorted(total.tolist())[-10]
    assert {s for s, _ in tree.best(list(range(6)), 10, least, tie)} == {x for x in sorted(total.tolist())[-10:]}
    assert tree.best(list(range(6)), 10, int(total.max()) + 1, tie) == []


def test_empty_tables(spark):
    none, one = frame(spark, []), frame(spark, [(1, "a b")])
    assert ls.ranked_search(none, asked(spark, [(1, "a")])).collect() == []
    assert ls.ranked_search(one, asked(spark, [])).collect() == []
    assert ls.ranked_search(frame(spark, [(1, None)]), asked(spark, [(1, "a")])).collect() == []
    assert [tuple(r)[:3] for r in ls.ranked_search(one, asked(spark, [(4, "A")])).collect()] == [(4, 1, 1)]
