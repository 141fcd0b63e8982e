"""Record transforms: small column functions that map one system's fields to another's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_str(c: Column) -> Column:
    return c.cast("string")


def to_lower(c: Column) -> Column:
    return F.lower(c.cast("string"))


def to_date(c: Column) -> Column:
    """Dates in several formats; zero dates are null."""
    text = F.when(~c.rlike(r"^0{4}-0{2}-0{2}|^0+$|^$"), c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss")])


def to_bool(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y", "t"))


def enum_map(c: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default)
    for name, value in mapping.items():
        out = F.when(F.lower(c) == name.lower(), value).otherwise(out)
    return out


def concat(*parts: Column, sep: str = " ") -> Column:
    """Parts that are not empty; null if none is."""
    return F.nullif(F.concat_ws(sep, *[F.nullif(p.cast("string"), F.lit("")) for p in parts]), F.lit(""))


def first_non_null(*parts: Column) -> Column:
    return F.coalesce(*[F.nullif(p.cast("string"), F.lit("")) for p in parts])


def split_take(c: Column, separator: str, at: int) -> Column:
    """One part of a split text, counted from 0 or, negative, from the end; null beyond."""
    parts = F.split(c, F.lit(r"\Q" + separator + r"\E"))
    return F.try_element_at(parts, F.lit(at + 1 if at >= 0 else at))


def business_seconds(start: Column, end: Column, opens: int = 9, closes: int = 17) -> Column:
    """Seconds between two instants that fall on weekdays between the opening hours, day by day."""
    days = F.sequence(F.to_date(start), F.to_date(end))

    def overlap(day: Column) -> Column:
        begin = F.greatest(start.cast("double"), day.cast("timestamp").cast("double") + opens * 3600)
        finish = F.least(end.cast("double"), day.cast("timestamp").cast("double") + closes * 3600)
        return F.when(F.dayofweek(day).between(2, 6), F.greatest(F.lit(0.0), finish - begin)).otherwise(0.0)

    return F.when(end >= start, F.aggregate(F.transform(days, overlap), F.lit(0.0), lambda acc, x: acc + x)).otherwise(0.0)
