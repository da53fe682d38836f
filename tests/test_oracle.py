import pytest

from strandmap import catalog
from tests import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    oracle.compare(spark, con, sf, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_no_query_reads_a_fixed_part_of_its_table():
    for name, sql in catalog.ORACLE_SQL.items():
        assert "event_id %" not in sql and "TABLESAMPLE" not in sql.upper(), name
