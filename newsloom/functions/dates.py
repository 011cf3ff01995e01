"""Date functions. Nothing reads the clock: today and now are arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(x: Column) -> Column:
    """YYYY-MM-DD, with any of . / - or nothing between, at the start; null where it's no date."""
    m = lambda g: F.regexp_extract(F.trim(x), r"^(\d{4})[-./]?\s*(\d{1,2})[-./]?\s*(\d{1,2})", g)
    return F.try_to_timestamp(F.concat_ws("-", m(1), F.lpad(m(2), 2, "0"), F.lpad(m(3), 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def parse_period(x: Column) -> Column:
    """struct<start, end> of the first two dates of a text; one date alone is both."""
    found = F.regexp_extract_all(x, F.lit(r"(\d{4}\s*[-./]\s*\d{1,2}\s*[-./]\s*\d{1,2})"), F.lit(1))
    dates = F.filter(F.transform(found, lambda d: parse_date(F.regexp_replace(d, r"\s", ""))), lambda d: d.isNotNull())
    return F.struct(F.get(dates, F.lit(0)).alias("start"), F.coalesce(F.get(dates, F.lit(1)), F.get(dates, F.lit(0))).alias("end"))


def d_day(end: Column, today) -> Column:
    return F.datediff(end, F.lit(today))


def status_of(end: Column, today) -> Column:
    return F.when(end < F.lit(today), "closed").otherwise("open")


def badge(end: Column, today) -> Column:
    d = d_day(end, today)
    return F.when(d.isNull(), "none").when(d < 0, "closed").when(d <= 3, "urgent").when(d <= 7, "soon").otherwise("open")


def in_night(hour: Column, start: int, end: int) -> Column:
    """Whether an hour is in the interval [start, end), which may wrap midnight."""
    return (hour >= start) | (hour < end) if start > end else (hour >= start) & (hour < end)


def age_label(seconds: Column, at: Column) -> Column:
    return F.when(seconds < 60, "now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h"))).otherwise(F.date_format(at, "yyyy-MM-dd"))


def local_time(utc: Column, tz: str) -> Column:
    """The local wall-clock time of a UTC time."""
    return F.from_utc_timestamp(utc, tz)


def local_hour(utc: Column, tz: str) -> Column:
    return F.hour(local_time(utc, tz))


def local_date(utc: Column, tz: str) -> Column:
    return F.to_date(local_time(utc, tz))


def parse_time(x: Column) -> Column:
    """A UTC timestamp without a zone, from an ISO text with T or a blank, with Z, an offset or neither (then it is UTC);
    null where it's none."""
    t = F.regexp_replace(F.trim(x), " ", "T")
    parts = lambda g: F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(?:T(\d{2}:\d{2})(:\d{2})?(?:\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$", g)
    wall = F.concat(parts(1), F.lit("T"), F.coalesce(F.nullif(parts(2), F.lit("")), F.lit("00:00")), F.coalesce(F.nullif(parts(3), F.lit("")), F.lit(":00")))
    zone = F.regexp_replace(parts(4), ":", "")
    minutes = (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    shift = F.when(zone.isin("", "Z"), 0).otherwise(minutes)
    return F.when(parts(1) != "", F.try_to_timestamp(wall, F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz") - F.make_dt_interval(mins=F.coalesce(shift, F.lit(0))))


def iso(utc: Column) -> Column:
    """A UTC time as text, to the second."""
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def month_of(text: Column, today) -> Column:
    """The first day of a month given as YYYY-MM; of today's month where the text is none."""
    fits = F.try_to_timestamp(F.concat(F.when(text.rlike(r"^\d{4}-\d{2}$"), text), F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(fits, F.trunc(F.lit(today), "month").cast("date"))


def month_shift(first: Column, months: int) -> Column:
    return F.add_months(F.trunc(first, "month"), months)
