"""Queries side by side with their DuckDB SQL."""

import os

import duckdb
import pytest

from threadloom.plans.queries import ORACLE, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr), [names[i] for i in order]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    mine = plain([tuple(r) for r in df.collect()], df.columns)
    assert name not in ORACLE or mine[0], "an empty result shows nothing"
    if name in ORACLE:
        cursor = db.execute(ORACLE[name])
        names = [x[0] for x in cursor.description]
        assert mine == plain(cursor.fetchall(), names)
