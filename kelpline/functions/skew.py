"""Running aggregates over ordered groups that may hold a large share of all rows.

A plain window sorts and walks a whole group in one task.  Here the order axis is
cut into fixed ranges: each (group, range) is handled on its own, and only one
summary row per (group, range) is carried on to the ranges after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time range in seconds, about 24 days.
RANGE_SECONDS = 1 << 21


def time_range(seconds: Column, width: int = RANGE_SECONDS) -> Column:
    return F.floor(seconds / F.lit(width)).cast("long")


def running_sums(df: DataFrame, keys: list[str], part: str, order: list[Column], sums: list[str]) -> DataFrame:
    """*df* with each of *sums* replaced by its running total within *keys*, in the
    order (*part*, *order*), the row itself included.

    *part* must not be null and must not decrease along *order*.  Rows of one (keys, part) meet
    in one task, so the caller sees to it that they are bounded (rows folded to one per time of a
    time range are); across parts only their totals do.  Null keys form one group.
    """
    # Keys without nulls join as they are partitioned; null-safe ones would be shuffled again.
    types = dict(df.dtypes)
    solid = {f"{k}_solid": F.coalesce(k, F.lit("" if types[k] == "string" else 0).cast(types[k])) for k in keys}
    solid |= {f"{k}_null": F.col(k).isNull() for k in keys}
    groups = [*solid, part]
    rest = [c for c in df.columns if c not in (*keys, *sums, part)]
    rows = df.select(*[c.alias(n) for n, c in solid.items()], part, *rest, *sums).repartition(*groups)
    inside = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(*groups, *rest, *[F.sum(c).over(inside).alias(c) for c in sums])
    totals = rows.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy(*solid).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*groups, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_carried") for c in sums])
    totalled = {c: F.col(c) + F.col(f"{c}_carried") for c in sums}
    whole = {k: F.when(~F.col(f"{k}_null"), F.col(f"{k}_solid")) for k in keys}
    return local.join(carried, groups).select(*[(whole | totalled).get(c, F.col(c)).alias(c) for c in df.columns])
