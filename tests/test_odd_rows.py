"""Queries give their SQL's rows on tables with odd rows too."""

from __future__ import annotations

import shutil

import pytest

from heronlake.plans import registry
from tests.conftest import SF
from tests.oracle import TABLES, connect, rows_of, rows_of_sql

TEXTS = ["", " ", "  lead", "trail  ", "\ttab\t", "a\rb", "a\r\nb", "\rx", "x\n", "back\\slash", 'q"uote', '"', "a,b", "x\x0by alpha", " em", " nb ", None, "İstanbul", "null"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The smallest tables with more documents and conversations."""
    import duckdb

    base = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        shutil.copy(f"{SF}/{t}.parquet", base)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for i, x in enumerate(TEXTS):
        con.execute("INSERT INTO documents VALUES (?, ?, 'en', 'src0', ?)", [10**6 + i, x, None if x is None else len(x)])
        a, b, c = 10**6 + i, 2 * 10**6 + i, 3 * 10**6 + i
        con.execute("INSERT INTO conversations VALUES (?, 0, 'user', 'alpha beta alpha'), (?, 2, 'user', ?), (?, 0, 'user', ?), (?, 2, 'user', 'alpha gamma, and it?'), (?, 0, 'user', ?)", [a, a, x, b, x, b, c, x])
    for i, n in enumerate((-400, -1, 300, 301, 448, 449)):
        con.execute("INSERT INTO documents VALUES (?, 'n', 'fr', 'src1', ?)", [4 * 10**6 + i, n])
    for t in ("documents", "conversations"):
        con.execute(f"COPY {t} TO '{base}/{t}.parquet'")
    return str(base)


NAMES = ["agg_parent_group", "agg_leakage", "agg_fragmentation", "jn_span_overlap", "ret_chunk_to_passage", "fn_anchors", "qry_rewrite", "src_csv_wide"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    names, expected = rows_of_sql(connect(odd), registry.oracle_sql()[name])
    df = registry.queries()[name](spark, odd)
    assert sorted(df.columns) == names
    assert rows_of(df) == expected
