"""Queries of this subpackage side by side with their DuckDB SQL."""

import pytest

from tests.test_oracle import FOLDER, TABLES, db, plain  # noqa: F401
from threadloom.llm import oracles
from threadloom.llm import queries as Q


@pytest.mark.parametrize("name", list(oracles.oracle_sql()))
def test_query(spark, db, name):  # noqa: F811
    cursor = db.execute(oracles.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    df = Q.queries()[name](spark, FOLDER).select(*names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cursor.fetchall(), names)
