"""Runs of words against all periods, and special inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import periodic_runs as pr

DOCS = "doc_id long, text string, runs int, start string"


def all_periods(w, least, times):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)  # the least period first
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in out.items())


def texts(seed, count):
    random.seed(seed)
    for _ in range(count):
        n, k = random.choice([0, 1, 2, 7, 40, 150]), random.choice([1, 2, 3, 60])
        t = [random.randrange(k) for _ in range(n)]
        if n and random.random() < 0.5:
            a = random.randrange(n)
            p = 1 + (n - a) // random.randint(2, 9)
            t = [t[i if i < a else a + (i - a) % p] for i in range(n)]
            if random.random() < 0.4:
                t[random.randrange(n)] = random.randrange(k)
        yield t


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (10, 3)])
def test_runs_against_all_periods(least, times):
    some = list(texts(least, 400))
    for i in range(0, len(some), 20):  # texts share a suffix array
        found = pr.find_runs([np.array(t, np.int64) for t in some[i : i + 20]], least, times)
        assert [[tuple(r) for r in f.tolist()] for f in found] == [[(a, n, q) for a, n, q in sorted(all_periods(t, least, times), key=lambda r: (r[0], r[2]))] for t in some[i : i + 20]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4))
def test_runs_of_any_texts(some):
    found = pr.find_runs([np.array(t, np.int64) for t in some], 2, 2)
    assert [sorted(map(tuple, f.tolist())) for f in found] == [all_periods(t, 2, 2) for t in some]


def test_suffixes_against_sorting():
    for t in texts(9, 60):
        s = pr.Suffixes(np.array([x + 1 for x in t] + [0]))
        tails = [(*[x + 1 for x in t[i:]], 0) for i in range(len(t) + 1)]
        assert s.sa.tolist() == sorted(range(len(tails)), key=tails.__getitem__)

        def common(a, b, tails=tails):
            n = 0
            while tails[a][n] == tails[b][n]:
                n += 1
            return n

        assert s.lcp[1:].tolist() == [common(a, b) for a, b in zip(s.sa[:-1], s.sa[1:], strict=True)]
        pairs = [(random.randrange(len(tails)), random.randrange(len(tails))) for _ in range(60)]
        pairs = np.array([p for p in pairs if p[0] != p[1]] or [(0, 0)])
        if len(t):
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            assert s.common(pairs[:, 0], pairs[:, 1]).tolist() == [common(a, b) for a, b in pairs]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)


def digests(i, w):
    h = 1 if i is None else zlib.crc32(str(i).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k if k < a else a + (k - a) % p] for k in range(n)]
    runs = sorted(all_periods(w, 6, 4), key=lambda r: (r[0], r[2]))
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(pr, "CHUNK_WORDS", 500)
    rows = [(i, " ".join("abcd é"[x % 6] * (1 + x // 6) if x % 6 != 4 else "e" for x in t)) for i, t in enumerate(texts(5, 250))]
    rows += [(None, "a b " * 9), (None, None), (1001, None), (1002, ""), (1003, " \n\t"), (1004, "a\x0bb\x0ca\x0db a b a b a b a b"), *rows[:9], (1005, "it is " * 30_000), (1006, " ".join(map(str, range(50_000))))]
    got = sorted(map(tuple, pr.digests(pr.periodic_runs(pr.with_repeats(frame(spark, rows)))).collect()), key=str)
    slow = lambda i, t: digests(i, [x.decode() for x in (t or "").encode().split()])
    short = [r for r in rows if r[0] not in {1005, 1006}]
    assert [r for r in got if r[0] not in {1005, 1006}] == sorted((slow(i, t) for i, t in short), key=str)
    long = {r[0]: r for r in got if r[0] in {1005, 1006}}
    assert long[1005][1:6] == (1, 0, 60_000, 2, 30_000_000) and (long[1006][1] in {0, 1})


def test_operator_returns_runs_and_texts(spark):
    r = {x.doc_id: x for x in pr.periodic_runs(frame(spark, [(1, "so  very very very very very very good"), (2, None)])).collect()}
    assert (r[1].n_words, [tuple(x) for x in r[1].runs], r[1].collapsed) == (8, [(1, 6, 1)], "so very good")
    assert (r[2].n_words, r[2].runs, r[2].collapsed) == (0, [], "")


def test_empty_table(spark):
    assert pr.digests(pr.periodic_runs(pr.with_repeats(frame(spark, [])))).collect() == []
