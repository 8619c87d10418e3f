"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import compare
import duckdb
import pytest

from veriframe.plans import code_queries  # noqa: F401  registers its queries
from veriframe.plans import queries as Q
from veriframe.tables import THREAT_TYPES


@pytest.fixture(scope="module")
def con(small):
    return compare.connection(small)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, small, con, name):
    df = Q.QUERIES[name](spark, small)
    if name in Q.ORACLE_SQL:
        assert compare.difference(df, con, Q.ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0


def test_report_lines_keep_large_counts(spark, tmp_path):
    """120000 hits, 7 spurious rows of one user and 100001 missed ones of others."""
    user = "CASE WHEN i < 240000 THEN i // 2 WHEN i < 240007 THEN -1 ELSE i END"
    late = "i < 240000 AND i % 2 = 1 OR i BETWEEN 240000 AND 240006"
    duckdb.sql(f"COPY (SELECT i AS event_id, CASE WHEN {late} THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '2024-01-02' END AS ts, {user} AS user_id, 'click' AS event_type FROM range(340008) r(i)) TO '{tmp_path}/events.parquet'")
    want = {(t, *(n if t in ("L", "ALL") else (0, 0, 0))) for n in [(120000, 7, 100001)] for t in (*THREAT_TYPES, "ALL")}
    counts = Q.QUERIES["confusion_by_type"](spark, str(tmp_path)).select("category", "tp", "fp", "fn").collect()
    lines = [r["line"] for r in Q.QUERIES["report_lines"](spark, str(tmp_path)).collect()]
    assert set(map(tuple, counts)) == want
    assert sorted(lines) == sorted(f"{t:<10} {tp:>5} {fp:>5} {fn:>5}" for t, tp, fp, fn in want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(Q.QUERIES) <= set(e.queries())
