"""Running sums over ordered rows without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(df: DataFrame, keys: list[str], bucket: str, order: list[str | Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all earlier rows of the same ``keys``.

    Rows are ordered by ``bucket`` first and ``order`` inside a bucket.  A key with a third
    of all rows is as many tasks as it has buckets: bucket totals are partial aggregates,
    only one row per bucket is summed in sequence, and each bucket runs on its own.  The
    join and the inner window share one exchange on (keys, bucket).
    """
    group = [*keys, bucket]
    totals = df.groupBy(*group).agg(F.sum(value).alias("_total"))
    across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(starts, group)
    return joined.withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_start")


def power_of_two(n: float) -> int:
    """The smallest power of two that is at least ``n`` (1 at least)."""
    out = 1
    while out < n:
        out *= 2
    return out
