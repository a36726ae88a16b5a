"""Column helpers where NaN means "unknown". Spark orders NaN above every number, so each comparison is guarded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def num(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def known(x: Column) -> Column:
    """True unless null or NaN."""
    return x.isNotNull() & ~F.isnan(x)


def finite(x: Column) -> Column:
    return known(x) & (F.abs(x) != F.lit(float("inf")))


def ge(x: Column, y) -> Column:
    """``x >= y`` that is false where either is unknown."""
    y = num(y)
    return known(x) & known(y) & (x >= y)


def gt(x: Column, y) -> Column:
    y = num(y)
    return known(x) & known(y) & (x > y)


def sat01(x: Column) -> Column:
    """Clamp to [0, 1]; NaN stays NaN, null stays null, infinities become the ends."""
    return F.when(F.isnan(x), x).when(x < 0, F.lit(0.0)).when(x > 1, F.lit(1.0)).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return F.when(b != 0, a / b)


def shown(x: Column, digits: int = 9) -> Column:
    """Rounded for results; an unknown is null."""
    return F.when(known(x), F.round(x, digits) + 0.0)


# --- vectors as arrays ----------------------------------------------------------------------------------------------
def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))
