"""Arithmetic with the dialect's meaning, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer division towards zero; null where the divisor is zero."""
    q = F.nullif(b, F.lit(0))
    return F.try_divide(a - a % q, q).cast("bigint")


def real_div(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign; null where the divisor is zero."""
    return a % F.nullif(b, F.lit(0))


def shift_left(a: Column, n: Column) -> Column:
    """A negative count shifts the other way; 64 and more leave 0, or -1 for negative numbers shifted right."""
    a, n = a.cast("bigint"), n.cast("int")
    by = lambda f, k: F.call_function(f, a, k)
    right = F.when(n <= -64, F.when(a < 0, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")).otherwise(by("shiftright", -n))
    return F.when(n < 0, right).when(n >= 64, F.lit(0).cast("bigint")).otherwise(by("shiftleft", n))


def shift_right(a: Column, n: Column) -> Column:
    return shift_left(a, -n)


def to_integer(s: Column) -> Column:
    """CAST of text to INTEGER: through a real, cut; 0 where it is no number."""
    number = F.coalesce(s.try_cast("double"), F.lit(0.0))
    return F.when(s.isNotNull(), number.cast("bigint"))


def to_real(s: Column) -> Column:
    return F.when(s.isNotNull(), F.coalesce(s.try_cast("double"), F.lit(0.0)))


def truth(x: Column, kind: str) -> Column:
    """Truth of a value: null is false, numbers other than zero, texts other than '', '0', 'false'."""
    if kind == "boolean":
        return F.coalesce(x, F.lit(False))
    if kind == "string":
        return F.coalesce(~x.isin("", "0", "false"), F.lit(False))
    return F.coalesce(x != 0, F.lit(False))


def percent_diff(start: Column, final: Column) -> Column:
    start, final = start.cast("double"), final.cast("double")
    return F.when(start == 0, F.lit(float("inf"))).otherwise((final - start) / start * 100)


def greatest_null(*xs: Column) -> Column:
    """Scalar MAX: null if any argument is null."""
    missing = xs[0].isNull()
    for x in xs[1:]:
        missing = missing | x.isNull()
    return F.when(~missing, F.greatest(*xs))


def least_null(*xs: Column) -> Column:
    missing = xs[0].isNull()
    for x in xs[1:]:
        missing = missing | x.isNull()
    return F.when(~missing, F.least(*xs))


def real_text(x: Column) -> Column:
    """A real as text: 15 significant digits, whole values with .0."""
    return F.when(x == F.floor(x), F.concat(F.format_string("%.0f", x), F.lit(".0"))).otherwise(F.regexp_replace(F.format_string("%.15g", x), r"0+$", ""))
