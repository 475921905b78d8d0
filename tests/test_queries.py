"""Every registered query against its SQL on DuckDB; those without SQL must run and give a stable schema."""

import pytest

from tessera.catalog import ORACLE_SQL, QUERIES
from tests.oracle import connect, differ


#: Without rows on the smallest tables alone.
MAY_BE_EMPTY = {"n8_token_map"}
#: With a dozen S1 a country, every word stands in more than the query's share of them.
LARGER = {"m15_templated_streets": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, sf, name):
    assert differ(spark, con, QUERIES[name], ORACLE_SQL[name], sf) == ""
    if name not in MAY_BE_EMPTY:
        assert con.execute(f"SELECT count(*) FROM ({ORACLE_SQL[name]})").fetchone()[0] > 0


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_runs(spark, sf, name):
    sf = LARGER.get(name, sf)
    df = QUERIES[name](spark, sf)
    assert df.schema == QUERIES[name](spark, sf).schema
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["s1_id", "match_id"]
    assert entry.oracle_sql().keys() <= entry.queries().keys()
