"""Korean calendar days and other time rules. Times are UTC; every operator is given its as_of."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

KST_HOURS = 9


def lit_time(t: dt.datetime) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def kst(ts: Column) -> Column:
    return ts + F.expr(f"INTERVAL {KST_HOURS} HOURS")


def kst_date(ts: Column) -> Column:
    return F.to_date(kst(ts))


def kst_start_of_day(ts: Column) -> Column:
    """The UTC instant at which the Korean day of ts begins."""
    return kst_date(ts).cast("timestamp_ntz") - F.expr(f"INTERVAL {KST_HOURS} HOURS")


def kst_text(ts: Column) -> Column:
    return F.date_format(kst(ts), "yyyy-MM-dd HH:mm")


def month_window(month: str) -> tuple[dt.datetime, dt.datetime]:
    """[start, end) of a Korean month as UTC instants."""
    y, m = map(int, month.split("-"))
    end = (y + m // 12, m % 12 + 1)
    shift = dt.timedelta(hours=KST_HOURS)
    return dt.datetime(y, m, 1) - shift, dt.datetime(*end, 1) - shift


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later.cast("timestamp")) / 1e6 - F.unix_micros(earlier.cast("timestamp")) / 1e6


def relative_time(ts: Column, as_of: Column) -> Column:
    """방금 전 below a minute, then minutes, then hours below a day; 어제 and the time for the Korean
    day before; else the Korean date."""
    s = F.floor(seconds_between(as_of, ts))
    yesterday = F.datediff(kst_date(as_of), kst_date(ts)) == 1
    return (F.when(s < 60, "방금 전").when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("분 전")))
            .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("시간 전")))
            .when(yesterday, F.concat(F.lit("어제 "), F.date_format(kst(ts), "HH:mm"))).otherwise(F.date_format(kst(ts), "yyyy-MM-dd")))


def expires_at(posted: Column) -> Column:
    return posted + F.expr("INTERVAL 30 DAYS")


def body_expires_at(posted: Column) -> Column:
    return posted + F.expr("INTERVAL 7 DAYS")
