"""Hour-ending calendar and local-time columns.

A stamp closes its hour, so midnight belongs to the day before.  All times are TIMESTAMP_NTZ in
local clock time; none of the expressions depends on the session time zone.
"""

from __future__ import annotations

import datetime as dtm

from pyspark.sql import Column, functions as F

from airmon.dims import LOCAL_ZONE


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(d: dtm.date | str) -> dtm.date:
    return dtm.date.fromisoformat(d) if isinstance(d, str) else d


def ntz(t: dtm.datetime) -> Column:
    """A TIMESTAMP_NTZ literal; folded before pushdown."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def one_second_before(dt: Column | str) -> Column:
    return col(dt) - F.expr("INTERVAL 1 SECOND")


def hour_ending_date(dt: Column | str) -> Column:
    return one_second_before(dt).cast("date")


def hour_ending_hour(dt: Column | str) -> Column:
    return F.hour(one_second_before(dt))


def year_of(dt: Column | str) -> Column:
    return F.year(one_second_before(dt))


def season(dt: Column | str, first_month: int = 7, last_month: int = 9) -> Column:
    summer = F.month(one_second_before(dt)).between(first_month, last_month)
    return F.when(summer, "summer").when(~summer, "winter")


def truncate_to_hour(dt: Column | str) -> Column:
    # date_trunc would go through the session zone; this stays on the local clock
    return col(dt).cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(col(dt)))


def hour_code_to_datetime(date: Column | str, code: Column | str) -> Column:
    """100, 200, .. 2400; 2400 is the next midnight."""
    hours = (col(code) / 100).cast("int")
    return col(date).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours)


def excel_serial_date(serial: Column | str) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), col(serial).cast("int"))


def local_from_parts(date: Column | str, hhmm: Column | str) -> Column:
    text = F.concat_ws(" ", col(date).cast("string"), col(hhmm))
    both = col(date).isNotNull() & col(hhmm).isNotNull()
    return F.when(both, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz"))


def utc_to_local(utc: Column | str, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(utc))


def exists_in_zone(dt: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """False for clock times skipped in spring: they do not survive a trip through UTC."""
    there = F.convert_timezone(F.lit(zone), F.lit("UTC"), col(dt))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), there) == col(dt)


def in_period(dt: Column | str, start: dtm.date | str, end: dtm.date | str) -> Column:
    """Hour-ending date between two dates, as plain bounds on the column so that scans can use them."""
    second, day = dtm.timedelta(seconds=1), dtm.timedelta(days=1)
    lo = dtm.datetime.combine(as_date(start), dtm.time()) + second
    hi = dtm.datetime.combine(as_date(end), dtm.time()) + day + second
    return (col(dt) >= ntz(lo)) & (col(dt) < ntz(hi))


def in_hour_range(dt: Column | str, start: dtm.date | str, end: dtm.date | str) -> Column:
    """From 01:00 of the first day through midnight closing the last, both included."""
    lo = dtm.datetime.combine(as_date(start), dtm.time(1))
    hi = dtm.datetime.combine(as_date(end), dtm.time()) + dtm.timedelta(days=1)
    return col(dt).between(ntz(lo), ntz(hi))
