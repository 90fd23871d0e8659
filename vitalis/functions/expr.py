"""Null-safe scalar building blocks shared by all operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, fn) -> Column:
    """``fn(v)`` with ``value`` evaluated once and bound to ``v``.

    An expression used inside a higher-order-function lambda is evaluated
    again on every invocation (there is no common-subexpression elimination
    inside lambdas); binding it as a lambda variable of a one-element
    ``transform`` computes it once per row.
    """
    return F.element_at(F.transform(F.array(col(value)), fn), 1)


def clamp01(x) -> Column:
    """clamp to [0, 1], keeping NULL as NULL (``greatest`` alone would turn a
    NULL into 1.0)."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def nan_to_null(x) -> Column:
    """NaN and NULL both mean 'missing'."""
    x = col(x)
    return F.when(~F.isnan(x), x)


def finite_number(x) -> Column:
    """Lenient numeric parse: text or number -> DOUBLE, unparsable or
    non-finite -> NULL."""
    d = col(x).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def strip(x) -> Column:
    """Text without white space (``\\s``) at both ends."""
    return F.regexp_replace(col(x), r"^\s+|\s+$", "")


def exact_sum(x, scale: int = 9) -> Column:
    """Sum of doubles with a fixed number of decimals, exact and independent
    of summation order (the partial aggregates of a distributed sum arrive in
    any order). Values are taken to ``scale`` decimals, with 28 digits in all."""
    return F.sum(finite_number(x).try_cast(f"decimal(28,{scale})"))


def exact_mean(x, scale: int = 9) -> Column:
    """Mean as an exact decimal sum divided once, in double, by the count of
    non-null values. NULL when there are none."""
    s = exact_sum(x, scale)
    n = F.count(col(x))
    return F.when(n > 0, s.cast("double") / n)


def truthy(x) -> Column:
    """Python truthiness of a number: not NULL and not 0."""
    x = col(x)
    return x.isNotNull() & (x != 0)
