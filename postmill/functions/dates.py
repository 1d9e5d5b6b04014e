"""Dates as text, local days, years of experience."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"


def local_time(ts: Column, zone: str = ZONE) -> Column:
    """Wall-clock time in a zone, of a time that is UTC (with or without zone)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return local_time(ts, zone).cast("date")


def clock(ts: Column, zone: str = ZONE) -> Column:
    return F.date_format(local_time(ts, zone), "HH:mm")


def published_date(text: Column) -> Column:
    """The ISO date after a publication label; '' if there is none or it isn't in the calendar."""
    pattern = r"(?i)(?:发布时间|发布日期|posted(?:\s+on)?)\s*[:：]?\s*(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?"
    part = lambda i: F.lpad(F.regexp_extract(text, pattern, i), 4 if i == 1 else 2, "0")
    return F.coalesce(F.when(text.rlike(pattern), F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd").cast("string")), F.lit(""))


def least_years(text: Column) -> Column:
    """The first number of years that a text names."""
    return F.nullif(F.regexp_extract(text, r"(?i)(\d+)\s*(?:[-–~至]\s*\d+)?\s*(?:年|years?)", 1), F.lit("")).cast("int")


def expired(valid_through: Column, now: Column) -> Column:
    """True or false if the date can be read (no zone: UTC), else null."""
    return F.try_to_timestamp(valid_through) < now
