"""Registered training-data queries that SQL can express, against DuckDB on the smallest tables."""

import compare
import pytest

from veriframe.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, small, name):
    assert compare.difference(Q.QUERIES[name](spark, small), compare.connection(small), Q.ORACLE_SQL[name]) == ""


def test_registered():
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries()) and {"pipeline"} <= set(e.queries())
