"""Every registered gazette query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from actaflow.plans.queries import ORACLE_SQL, QUERIES


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = db.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)
