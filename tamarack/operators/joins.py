"""Joins beyond equality: as-of and range joins without a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the last right row of the same key at or before its time.

    Both sides are put in one sequence a key, and the last right row is carried on, so a
    row is shuffled once and never paired with others.
    """
    payload = F.struct(F.col(right_time).alias("__at"), *[F.col(v) for v in values])
    l_rows = left.select(*on, F.col(left_time).alias("__time"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("__r"))
    r_rows = right.select(*on, F.col(right_time).alias("__time"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("p")).schema["p"].dataType).alias("__l"), payload.alias("__r"))
    order = Window.partitionBy(*on).orderBy(F.col("__time"), F.col("__l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = l_rows.unionByName(r_rows).withColumn("__last", F.last("__r", ignorenulls=True).over(order))
    return both.filter(F.col("__l").isNotNull()).select("__l.*", F.col("__last.__at").alias(right_time) if right_time not in left.columns else F.col("__last.__at").alias("right_time"), *[F.col(f"__last.{v}").alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """points.point within [ranges.low, ranges.high], by bins of ``width``.

    A range is copied to each bin it meets and a point goes to one bin, so the join is by
    equality; a width near the usual range keeps copies few.
    """
    bin_of = lambda c: F.floor(c.cast("double") / F.lit(float(width))).cast("bigint")
    p = points.withColumn("__bin", bin_of(F.col(point)))
    r = ranges.withColumn("__bin", F.explode(F.sequence(bin_of(F.col(low)), bin_of(F.col(high)))))
    inside: Column = (p["__bin"] == r["__bin"]) & (p[point] >= r[low]) & (p[point] <= r[high])
    return p.join(r, inside, how).drop("__bin")


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """A join on all common columns; without any, every pair."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common, how) if common else left.crossJoin(right)
