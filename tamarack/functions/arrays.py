"""Array functions with the dialect's meaning, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def subscript(arr: Column, i: Column | int) -> Column:
    """arr[i] from 1; null outside."""
    i = i if isinstance(i, Column) else F.lit(i)
    return F.when(i >= 1, F.get(arr, i - 1))


def any_of(x: Column, op: str, arr: Column) -> Column:
    return F.exists(arr, lambda e: _COMPARE[op](x, e))


def all_of(x: Column, op: str, arr: Column) -> Column:
    return F.forall(arr, lambda e: _COMPARE[op](x, e))


def contains(a: Column, b: Column) -> Column:
    """a @> b: every element of b is in a; null matches null; multiplicity doesn't count."""
    return F.forall(b, lambda y: F.exists(a, lambda x: x.eqNullSafe(y)))


def length(arr: Column, dimension: int = 1) -> Column:
    """ARRAY_LENGTH: null for an empty array or another dimension."""
    return F.nullif(F.size(arr), F.lit(0)) if dimension == 1 else F.lit(None).cast("int")


def parse(text: Column, kind: str = "string") -> Column:
    """The array for a literal such as {a,NULL,"x y"}; null where it isn't one."""
    token = r'"((?:[^"\\]|\\.)*)"|([^,{}"]+)'
    inner = F.regexp_extract(F.trim(text), r"^\{([\s\S]*)\}$", 1)
    items = F.regexp_extract_all(inner, F.lit(token), F.lit(0))
    value = lambda e: F.when(e.startswith('"'), F.regexp_replace(F.substring(e, F.lit(2), F.length(e) - 2), r"\\(.)", "$1")).when(F.upper(F.trim(e)) == "NULL", F.lit(None)).otherwise(F.trim(e))
    return F.when(F.trim(text).rlike(r"^\{[\s\S]*\}$"), F.transform(items, value).cast(f"array<{kind}>"))


def to_text(arr: Column) -> Column:
    """The canonical text of an array; elements with special characters are quoted."""
    one = lambda e: F.when(e.isNull(), "NULL").when((e == "") | (F.upper(e) == "NULL") | e.rlike(r'[{},"\\\s]'), F.concat(F.lit('"'), F.regexp_replace(e, r'(["\\])', r"\\$1"), F.lit('"'))).otherwise(e)
    return F.concat(F.lit("{"), F.array_join(F.transform(arr.cast("array<string>"), one), ","), F.lit("}"))
