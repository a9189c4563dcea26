"""Finite-number predicates. Spark orders NaN above every number, so comparisons need these guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def finite(c: Column) -> Column:
    """True for an ordinary number; False for NULL, NaN and both infinities."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(_INF)), F.lit(False))


def finite_positive(c: Column) -> Column:
    return finite(c) & (c > 0)


def null_if_not_finite(c: Column) -> Column:
    return F.when(finite(c), c)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, NULL where the divisor is zero (in ANSI mode a plain division would fail the job)."""
    return F.when(bottom != 0, top / bottom)
