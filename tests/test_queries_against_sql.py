"""Queries of the core against the SQL they must agree with, on the smallest tables where these are at hand."""

import os

import pytest

from tarn import definition_queries, file_queries, header_queries, language_queries, lookup_queries, note_queries

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()
CASES = [(m, n) for m in (note_queries, language_queries, header_queries, definition_queries, lookup_queries, file_queries) for n in m.QUERIES]
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


@pytest.fixture(scope="module")
def connection():
    duckdb = pytest.importorskip("duckdb")
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return found


def plain(row):
    return tuple((x is None, str(round(x, 6) if isinstance(x, float) else x)) for x in row)


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query(spark, connection, module, name):
    found = module.QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    cursor = connection.execute(module.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(plain(row[names.index(c)] for c in columns) for row in cursor.fetchall())
    assert sorted(plain(row[c] for c in columns) for row in found.collect()) == want
