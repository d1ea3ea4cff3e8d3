"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from lectern.plans.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("LECTERN_TEST_DATA", "/root/testdata/sf0.001")
#: Tested elsewhere, against brute force.
WITHOUT = {"knn_approximate", "html_markdown", "pages_to_chunks", "corpus_request", "llm_keywords"}


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(DATA):
        pytest.skip(f"no tables in {DATA}")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def same_rows(rows):
    return sorted((tuple(round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r) for r in map(tuple, rows)), key=repr)


def test_all_have_sql_but_these():
    assert {*QUERIES} - {*ORACLE_SQL} == WITHOUT


@pytest.mark.parametrize("name", sorted({*QUERIES} - WITHOUT))
def test_query_equals_sql(spark, tables, name):
    got = QUERIES[name](spark, DATA)
    want = tables.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = same_rows(got.select(*columns).collect()), same_rows(want.fetchall())
    assert len(a) == len(b) and [x for x in zip(a, b) if x[0] != x[1]][:3] == []
