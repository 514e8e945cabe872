"""Every query of the engine against its SQL."""

import os

import duckdb
import pytest

from ledgerloom.plans.oracle import SQL
from ledgerloom.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        db.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def same(spark, folder, query, sql):
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    want = database(folder).sql("select {} from ({})".format(", ".join(f'"{c}"' for c in columns), sql)).fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, small, name):
    same(spark, small, QUERIES[name], SQL[name])


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)
