"""Event times and the attributes derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col


def parse_event_time(c: Column | str) -> Column:
    """A timestamp from Unix seconds, YYYY-MM-DD or ISO 8601 text; null if it is none of them."""
    c = _col(c)
    number = F.when(c.rlike(r"^-?\d{1,12}(\.\d+)?$"), F.timestamp_seconds(c.try_cast("double")))
    return F.coalesce(number, c.try_cast("timestamp"))


def structured_attributes(c: Column | str) -> list[Column]:
    """day, month, year, quarter, day_of_week (Sunday 0) and is_weekend of a timestamp."""
    c = _col(c)
    day = F.dayofweek(c) - 1
    return [
        F.dayofmonth(c).alias("day"), F.month(c).alias("month"), F.year(c).alias("year"), F.quarter(c).alias("quarter"),
        day.alias("day_of_week"), day.isin(0, 6).alias("is_weekend"),
    ]
