"""Every registered query of the library against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from loomstore import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    found = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert len(rows) == len(want) and all(same(x, y) for r, w in zip(rows, want) for x, y in zip(r, w))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
