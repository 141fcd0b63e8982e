"""Business time: open seconds between two instants, by zone, with holidays and changes of the clock.

A calendar has one row a zone and day: when it opens and closes, as instants, and how many open seconds all days before it
had. The open seconds up to an instant are one lookup, those of a span the difference of two, however long it is.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WEEKDAYS = (2, 3, 4, 5, 6)


def calendar(
    spark: SparkSession,
    zones: Sequence[str],
    first: datetime.date,
    last: datetime.date,
    holidays: Sequence[datetime.date] = (),
    opens: str = "09:00:00",
    closes: str = "17:00:00",
    weekdays: Sequence[int] = WEEKDAYS,
) -> DataFrame:
    """zone, day, opened_s, closed_s, before_s for each day from first to last. weekdays: 1 is Sunday."""
    days = spark.createDataFrame([(z, first, last) for z in zones], "zone string, first date, last date")
    days = days.select("zone", F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("day"))
    instant = lambda clock: F.to_utc_timestamp(F.concat_ws(" ", F.col("day").cast("string"), F.lit(clock)).cast("timestamp"), F.col("zone")).cast("long")
    off = F.col("day").isin(*holidays) if holidays else F.lit(False)
    works = F.dayofweek("day").isin(*weekdays) & ~off
    # a closed day opens and closes at once
    held = days.select("zone", "day", instant(opens).alias("opened_s"), F.when(works, instant(closes)).otherwise(instant(opens)).alias("closed_s"))
    before = Window.partitionBy("zone").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn("before_s", F.coalesce(F.sum(F.col("closed_s") - F.col("opened_s")).over(before), F.lit(0).cast("long")))


def with_open_seconds(df: DataFrame, days: DataFrame, start: str, end: str, out: str, zone: Column | None = None) -> DataFrame:
    """df with `out`, the open seconds from column start to column end; null outside the calendar or where one is null, 0
    where the end is before the start. zone: of a row; without it the calendar's only one.
    """
    zone = F.lit(days.first()["zone"]) if zone is None else zone
    held = df.withColumn("_zone", zone)
    for name, at in (("_from", start), ("_to", end)):
        local = F.to_date(F.from_utc_timestamp(F.col(at), F.col("_zone")))
        held = held.withColumn("_day", local).join(days.toDF("_zone", "_day", "_opened", "_closed", "_before"), ["_zone", "_day"], "left")
        into = F.greatest(F.least(F.col(at).cast("double"), F.col("_closed")) - F.col("_opened"), F.lit(0.0))
        held = held.withColumn(name, F.when(F.col(at).isNotNull(), F.col("_before") + into)).drop("_day", "_opened", "_closed", "_before")
    span = F.when(F.col("_from").isNotNull() & F.col("_to").isNotNull(), F.greatest(F.col("_to") - F.col("_from"), F.lit(0.0)))
    return held.withColumn(out, span).drop("_zone", "_from", "_to")
