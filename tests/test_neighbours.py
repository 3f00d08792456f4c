"""The neighbour index against all pairs, and special inputs."""


import numpy as np
import pytest

from cadenza.operators import neighbours
from cadenza.operators.neighbours import NeighbourIndex, nearest
from cadenza.sources.scratch import new_folder

SONGS = "song_id long, vec array<float>"


def vectors(seed, n, size=6, groups=0):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, size))
    if groups:
        m = rng.standard_normal((groups, size))[rng.integers(0, groups, n)] * 3 + 0.3 * m
    m[:: max(1, n // 7)] = m[0]  # ties
    return [(int(i) * 3, m[i].astype(np.float32).tolist()) for i in rng.permutation(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SONGS)


def asked(df):
    return df.withColumnRenamed("song_id", "q")


def true(queries, items, k, keep_self=False, exclude=()):
    unit = lambda v: np.array(v, float) / (np.linalg.norm(np.array(v, float)) or 1.0)
    ids, m = np.array([i for i, _ in items]), np.array([unit(v) for _, v in items])
    out = {}
    for q, v in queries:
        sim = np.round(m @ unit(v), 6)
        best = sorted((-s, i) for s, i in zip(sim.tolist(), ids.tolist(), strict=True) if (keep_self or i != q) and (q, i) not in exclude)[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.q, r["rank"])):
        out.setdefault(r.q, []).append((r.song_id, r.sim))
        assert r["rank"] == len(out[r.q])
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [i for i, _ in a[q]] == [i for i, _ in b[q]] and np.allclose([s for _, s in a[q]], [s for _, s in b[q]], atol=2e-6)


@pytest.mark.parametrize(("groups", "spill", "leaders"), [(0, 1, None), (8, 2, None), (8, 1, 3), (5, 3, 40)])
def test_exact_against_all_pairs(spark, monkeypatch, groups, spill, leaders):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    rows = vectors(groups + spill, 160, groups=groups)
    df = frame(spark, rows)
    index = NeighbourIndex.build(df, new_folder(spark, "test"), leaders=leaders, spill=spill)
    same(listed(index.exact(asked(df), 5, keep_self=False)), true(rows, rows, 5))
    out = {(q, i) for q, _ in rows[:30] for i, _ in rows[10:60]}
    got = index.exact(asked(frame(spark, rows[:30])), 4, spark.createDataFrame(sorted(out), "q long, song_id long"))
    same(listed(got), true(rows[:30], rows, 4, True, out))


def test_rings_leave_out_most_of_grouped_vectors(spark, monkeypatch):
    rows = vectors(3, 600, size=8, groups=20)
    df = frame(spark, rows)
    index = NeighbourIndex.build(df, new_folder(spark, "test"), leaders=40, spill=1)
    met, products = [], neighbours._products
    monkeypatch.setattr(neighbours, "_products", lambda pairs, *a: (met.append(pairs.count()), products(pairs, *a))[1])
    same(listed(index.exact(asked(df), 3, keep_self=False)), true(rows, rows, 3))
    assert met[1] < 0.3 * 40 * index.cells().count()


def test_search_finds_what_its_cells_hold(spark):
    rows = vectors(5, 200, groups=10)
    df = frame(spark, rows)
    index = NeighbourIndex.build(df, new_folder(spark, "test"), leaders=12, spill=2)
    cells = {}
    for r in index.members().collect():
        cells.setdefault(r.song_id, set()).add(r.cell)
    assert cells.keys() == {i for i, _ in rows} and all(len(c) == 2 for c in cells.values())
    got = listed(index.search(asked(df), 5, 3, keep_self=False))
    all_ = true(rows, rows, len(rows))
    own = index._leaders.value
    for q, v in rows:
        v = np.array(v, float) / np.linalg.norm(v)
        probed = set(np.argsort(-np.round(own.m @ v, 6), kind="stable")[:3].tolist())
        want = [i for i, _ in all_[q] if cells[i] & probed][:5]
        assert [i for i, _ in got[q]] == want
    r = index.audit(asked(df), 5, (2, 12)).collect()
    assert r[0].recall <= r[1].recall == 1.0 and r[1].wanted == 1000


def test_index_grows_and_is_loaded_again(spark):
    rows = vectors(6, 120)
    folder = new_folder(spark, "test")
    index = NeighbourIndex.build(frame(spark, rows[:70]), folder, spill=1)
    index.add(frame(spark, rows[60:]))  # ten are there already
    index.add(frame(spark, rows[60:]))
    again = NeighbourIndex(spark, folder)
    assert again.members().count() == 120
    same(listed(again.exact(asked(frame(spark, rows)), 5)), true(rows, rows, 5, True))


def test_hot_cells_and_queries_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_PART", 20)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rows = [(i, [1.0, 0.001 * i]) for i in range(100)] + [(1000, [-1.0, 0.0])]
    index = NeighbourIndex.build(frame(spark, rows), new_folder(spark, "test"), leaders=2, spill=1)
    assert index.cells().groupBy("cell").count().agg({"count": "max"}).first()[0] > 1
    same(listed(index.exact(asked(frame(spark, rows)), 2, keep_self=False)), true(rows, rows, 2))


def test_special_inputs(spark):
    none = frame(spark, [])
    index = NeighbourIndex.build(none, new_folder(spark, "test"))
    assert index.search(asked(none), 3).collect() == index.exact(asked(frame(spark, [(1, [1.0])])), 3).collect() == []
    odd = frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [0.0, 2.0])])
    got = listed(nearest(odd, odd, 3, query="song_id"))
    assert got == {1: [(2, 0.0), (4, 0.0)], 2: [(1, 0.0), (4, 0.0)], 4: [(1, 0.0), (2, 0.0)]}
    with pytest.raises(Exception, match="a vector has not 2 parts"):
        nearest(frame(spark, [(9, [1.0])]), odd, 1, query="song_id").collect()
    assert nearest(none, odd, 3, query="song_id").collect() == []


def test_vectors_are_sent_to_groups_not_to_pairs(spark, monkeypatch):
    """Rings rule nothing out here, so all blocks meet; a batch is still sent 16 times at most."""
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    rows = vectors(8, 200, size=24)
    df = frame(spark, rows)
    index = NeighbourIndex.build(df, new_folder(spark, "test"), leaders=6, spill=1)
    assert index.cells().count() > 40
    sent, products = [], neighbours._products
    monkeypatch.setattr(neighbours, "_products", lambda pairs, *a: (sent.append((pairs.count(), pairs.select("qs").distinct().count())), products(pairs, *a))[1])
    same(listed(index.exact(asked(df), 3, keep_self=False)), true(rows, rows, 3))
    assert all(n <= 16 * batches for n, batches in sent) and len(sent) == 2


def test_many_queries_are_sent_to_few_groups_of_few_vectors(spark, monkeypatch):
    """Both sides were sent to 16 groups of the other, so many queries moved 16 times, however few vectors there were."""
    x, y = neighbours._dealt(2000, 900_000, 20, 10_000, 64, 12)
    assert y == 1 and x >= 48 and x * 10_000 + y * 900_000 < 2_000_000
    x, y = neighbours._dealt(200, 100_000, 200, 100_000, 64, 12)
    assert x * y >= 48 and x + y <= 16
    x, y = neighbours._dealt(4000, 2_000_000, 20_000, 10_000_000, 64, 12)
    assert 10_000_000 * 512 / y <= neighbours.GROUP_BYTES and 2_000_000 * 512 / x <= neighbours.GROUP_BYTES
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    few, many = vectors(9, 24, size=5), vectors(10, 400, size=5)
    index = NeighbourIndex.build(frame(spark, few), new_folder(spark, "test"), leaders=6, spill=1)
    sent, products = [], neighbours._products
    monkeypatch.setattr(neighbours, "_products", lambda pairs, *a: (sent.append((pairs.count(), pairs.select("qs").distinct().count())), products(pairs, *a))[1])
    same(listed(index.exact(asked(frame(spark, many)), 3)), true(many, few, 3, True))
    assert all(n <= 2 * batches for n, batches in sent) and len(sent) == 2
