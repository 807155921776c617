"""Aggregates with the dialect's meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """TOTAL: a real sum, 0.0 where there is nothing to add."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def group_concat(x: Column, order: Column, separator: str = ",", distinct: bool = False) -> Column:
    """GROUP_CONCAT in the order of ``order``; nulls are left out, nothing gives null.

    Distinct values are joined in the order of their first appearance.
    """
    items = F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.cast("string").alias("x"))))), lambda s: s["x"])
    items = F.array_distinct(items) if distinct else items
    return F.when(F.count(x) > 0, F.array_join(items, separator))


def string_agg(x: Column, order: Column, separator: str = "", distinct: bool = False) -> Column:
    return group_concat(x, order, separator, distinct)


def json_group_array(x: Column, order: Column) -> Column:
    """JSON_GROUP_ARRAY, which keeps nulls, as JSON text."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("x")))), lambda s: F.coalesce(F.get(F.regexp_extract_all(F.to_json(F.struct(s["x"].alias("x"))), F.lit(r'^\{"x":(.*)\}$'), F.lit(1)), F.lit(0)), F.lit("null")))
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
