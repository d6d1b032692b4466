"""Every registered query of the core runs; those with SQL equal it."""

import pytest
from helpers import compare

from webloom.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    columns, sql_columns, rows, sql_rows = compare(spark, name, QUERIES[name], SQL[name], data)
    assert columns == sql_columns
    assert rows == sql_rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_entry_has_rows(spark, data):
    import __spark_entry__

    found = __spark_entry__.entry(spark).collect()
    assert found and found == sorted(found, key=lambda r: (-r["score"], r["url"], r["id"]))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
