"""Registered queries against their SQL over the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from cadenza.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    ran = con.execute(ORACLE_SQL[name])
    found = [d[0] for d in ran.description]
    assert sorted(found) == names
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == Counter(tuple(r[found.index(n)] for n in names) for r in ran.fetchall())
