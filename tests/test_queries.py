"""Every query that has SQL gives the same rows as DuckDB does; the others run."""

from __future__ import annotations

import pytest

from heronlake.plans import registry
from tests.conftest import SF
from tests.oracle import connect, rows_of, rows_of_sql

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name not in SQL:
        rows = df.collect()
        assert rows and all(any(r[c] is not None for r in rows) for c in df.columns)
        return
    names, expected = rows_of_sql(con, SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
