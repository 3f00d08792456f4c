"""Every query against its SQL in DuckDB over the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from cadenza.plans.oracles import ORACLES
from cadenza.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def value(x):
    return round(x, 9) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = Counter(tuple(value(r[n]) for n in names) for r in df.collect())
    ran = duck.execute(ORACLES[name])
    found = [d[0] for d in ran.description]
    assert sorted(found) == names
    want = Counter(tuple(value(r[found.index(n)]) for n in names) for r in ran.fetchall())
    assert got == want


def test_greedy_choice_against_a_loop(spark):
    from cadenza.operators.channels import diverse
    from cadenza.plans.queries import prompt_pool
    from cadenza.sources.bindings import Tables

    pool = prompt_pool(Tables(spark, FOLDER)).cache()
    by = {}
    for r in pool.collect():
        by.setdefault(r.user_id, []).append(r)
    want = set()
    for user, rows in by.items():
        used, prompts, n = set(), set(), 0
        for r in sorted(rows, key=lambda r: (-r.score, r.song_id)):
            if n < 10 and not set(r.seeds) <= used and r.normal not in prompts:
                used |= set(r.seeds)
                prompts.add(r.normal)
                n += 1
                want.add((user, r.song_id, n))
    assert {(r.user_id, r.song_id, r["rank"]) for r in diverse(pool).collect()} == want


def test_click_rates_against_numpy(spark):
    import numpy as np

    from cadenza.operators.ranking import Din, click_rates

    rng = np.random.default_rng(1)
    vec = {i: rng.standard_normal(6) for i in range(8)}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in vec.items()], "song_id long, vec array<double>")
    hist = spark.createDataFrame([(1, 0, 1), (1, 3, 2), (1, 5, 3), (2, 99, 1)], "user_id long, song_id long, seq long")
    asked = spark.createDataFrame([(1, 2), (1, 7), (1, 50), (2, 2)], "user_id long, song_id long")
    model = Din(6)
    got = {(r.user_id, r.song_id): r.ctr for r in click_rates(asked, hist, vectors, model).collect()}
    h = np.stack([vec[0], vec[3], vec[5]])
    for song in (2, 7):
        assert got[1, song] == pytest.approx(model.rate(vec[song][None], h)[0], abs=1e-6)
    assert got[1, 50] == got[2, 2] == 0.5
