"""Verdicts of checks that may not have run, and rates over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def verdict(*checks: Column) -> Column:
    """N2, A-32: false if a check failed, null if none ran, else true. SQL's AND gives null for (true, null)."""
    failed, ran = checks[0].eqNullSafe(False), checks[0].isNotNull()
    for c in checks[1:]:
        failed, ran = failed | c.eqNullSafe(False), ran | c.isNotNull()
    return F.when(failed, F.lit(False)).when(~ran, F.lit(None).cast("boolean")).otherwise(F.lit(True))


def rate(check: Column) -> Column:
    """A-07, an aggregate: passes among the checks that ran; no row: 0, no check that ran: NaN."""
    n = F.count(check)
    return F.when(F.count(F.lit(1)) == 0, F.lit(0.0)).when(n == 0, F.lit(float("nan"))).otherwise(F.avg(check.cast("int")))


def share(check: Column) -> Column:
    """An aggregate: true ones among all rows, with at least one row assumed; null counts as not true."""
    return F.count_if(F.coalesce(check, F.lit(False))) / F.greatest(F.count(F.lit(1)), F.lit(1))


def ratio(a: Column, b: Column) -> Column:
    """A-04: a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = precision(tp, fp), recall(tp, fn)
    return ratio(2 * p * r, p + r)


def among(value: Column, values: list[str | None]) -> Column:
    """N3: membership where null may be a member."""
    out = F.lit(False)
    for v in values:
        out = out | value.eqNullSafe(F.lit(v))
    return out
