"""Every catalogue query with a SQL twin against DuckDB on sf0.001, and the
catalogue contract (keys, SQL coverage)."""

import pytest

import __spark_entry__ as E
from clientele.plans import registry
from clientele.plans.compare import ROWS_ONLY, canon, duckdb_connection
from conftest import SF_SMALL

QUERIES = registry.queries()
SQL = registry.oracle_sql()


def test_every_key_has_sql_or_is_rows_only():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(QUERIES)


def test_the_entry_has_the_catalogue():
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())
    assert SQL.items() <= E.oracle_sql().items()


@pytest.fixture(scope="module")
def duck():
    return duckdb_connection(SF_SMALL)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_duckdb(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(SQL[key])
    dcols = [c[0] for c in res.description]
    drows = res.fetchall()
    sc, sr, sh = canon(df.columns, rows)
    dc, dr, dh = canon(dcols, drows)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sh == dh, [r for r in sr if r not in set(dr)][:3]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["rfm_class", "n_customers", "percent"]
    assert df.count() > 0
