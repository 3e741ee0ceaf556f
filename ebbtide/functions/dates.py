"""yyyymmdd integers to dates and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_day(yyyymmdd: Column) -> Column:
    """Date of a yyyymmdd integer; text that is no date becomes NULL."""
    return F.try_to_date(yyyymmdd.cast("string"), "yyyyMMdd")


def as_yyyymmdd(moment: Column) -> Column:
    """yyyymmdd integer of a date or timestamp."""
    return (F.year(moment) * 10000 + F.month(moment) * 100 + F.dayofmonth(moment)).cast("int")


def days_from(start: Column, end: Column) -> Column:
    """Calendar days from ``start`` to ``end`` as BIGINT."""
    return F.datediff(end, start).cast("bigint")


def days_before(snapshot: str, yyyymmdd: Column) -> Column:
    return days_from(as_day(yyyymmdd), F.lit(snapshot).cast("date"))
