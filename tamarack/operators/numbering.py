"""Numbers in an order over a whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import width
from .recursive import written

#: monotonically_increasing_id holds the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def numbered(rows: DataFrame, name: str, *order: Column, parts: int = 0, start: int = 0) -> DataFrame:
    """row_number() OVER (ORDER BY ...) + ``start`` as a column.

    Rows are dealt into sorted ranges, which are written with each row's place, and places
    are shifted by the counts of the ranges before.  Only one count a range reaches the driver.
    Ranges are as many as the size of the sources asks for, and ``parts`` at least.
    """
    parts = max(1, parts, width(rows))
    ranged = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__i", F.monotonically_increasing_id()))
    part = F.shiftright("__i", _PLACE_BITS).cast("int")
    counts = {r["p"]: r["count"] for r in ranged.groupBy(part.alias("p")).count().collect()}
    shifts, shift = [], start + 1
    for p in range(max(counts, default=0) + 1):
        shifts.append(F.lit(shift).cast("bigint"))
        shift += counts.get(p, 0)
    place = F.col("__i").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return ranged.withColumn(name, place + F.get(F.array(*shifts), part)).drop("__i")


def first_numbered(rows: DataFrame, name: str, limit: int, *order: Column) -> DataFrame:
    """The rows whose row_number() OVER (ORDER BY ...) is at most ``limit``.

    The bound stands on the number itself, so Catalyst keeps each task's first rows and only
    those reach the window; ORDER BY number LIMIT would sort the whole table in one task.
    """
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order))).filter(F.col(name) <= limit)
