"""Every query with an SQL equivalent gives its rows."""

import datetime
import decimal
import os

import duckdb
import pytest

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from corpusmill.queries import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_DIR}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR)
    names = sorted(frame.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in names)) for r in frame.collect())
    if name not in SQL:
        assert got
        return
    want = con.sql(SQL[name])
    at = sorted(range(len(want.columns)), key=lambda k: want.columns[k])
    assert names == sorted(want.columns)
    assert got == sorted(repr(tuple(plain(r[k]) for k in at)) for r in want.fetchall())
