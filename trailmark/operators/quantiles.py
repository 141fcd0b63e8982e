"""Exact percentiles of groups of any size: counts by value, a running sum in order of value, the values at two ranks.

An aggregate holds every distinct value of its group in memory; here a group is sorted, which may spill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, keys: Sequence[str], value: Column, out: dict[str, float], times: Column | None = None) -> DataFrame:
    """keys and for each name of `out` the percentile of that share, between the two nearest values; nulls are left out.

    times: how often a row counts. Keys are told apart as in a grouping; without values there is no row.
    """
    times = F.lit(1) if times is None else times
    keys = list(keys)
    counts = df.select(*keys, value.cast("double").alias("_v"), times.cast("long").alias("_c")).where("_v is not null and _c > 0")
    counts = counts.groupBy(*keys, "_v").agg(F.sum("_c").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    totals = counts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("_c").alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    ranked = counts.withColumn("_upto", upto)
    ranked = ranked.join(totals, same) if keys else ranked.crossJoin(totals)  # a single row

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col("_v")))

    columns = []
    for name, share in out.items():
        place = (F.col("_n") - 1) * F.lit(share)
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        columns.append((low * (1 - part) + high * part).alias(name))
    return ranked.groupBy(*keys).agg(*columns)
