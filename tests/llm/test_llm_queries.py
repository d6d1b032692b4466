"""Every query of the subpackage runs on whole small tables; SQL belongs to queries."""

import pytest

from webloom.llm import queries as Q


def test_names():
    assert set(Q.SQL) <= set(Q.QUERIES) and all(n[0] == "p" and n[1].isdigit() for n in Q.QUERIES)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, data, name):
    from helpers import compare

    columns, sql_columns, rows, sql_rows = compare(spark, name, Q.QUERIES[name], Q.SQL[name], data)
    assert columns == sql_columns and rows == sql_rows
