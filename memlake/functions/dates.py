"""Dates and times in UTC; impossible ones are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def parse_date(text: Column | str) -> Column:
    """Epoch seconds of YYYY-MM-DD."""
    t = col(text)
    day = F.try_to_timestamp(F.concat(t, F.lit("T00:00:00Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_timestamp(day))


def fmt_date(epoch: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(col(epoch)), "yyyy-MM-dd")


def fmt_datetime(epoch: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(col(epoch)), "yyyy-MM-dd HH:mm:ss")


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01; the day may exceed its month and then counts on."""
    return F.date_diff(F.make_date(year, month, F.lit(1)), F.lit("1970-01-01").cast("date")) + day - 1


def civil_from_days(days: Column | str) -> Column:
    """struct year, month, day."""
    d = F.date_add(F.lit("1970-01-01").cast("date"), col(days).cast("int"))
    return F.struct(F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"))


RFC3339 = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})[.0-9]*(?:[Zz]|([+-])(\d+):(\d+)|([+-])(\d{2})(\d{2}))?$"


def rfc3339_epoch(text: Column | str) -> Column:
    """Epoch seconds; fractions are ignored, Z, +HH:MM and +HHMM understood, anything else null."""
    t = col(text)

    def part(n: int) -> Column:
        return F.nullif(F.regexp_extract(t, RFC3339, n), F.lit("")).try_cast("long")

    def sign(n: int) -> Column:
        return F.when(F.regexp_extract(t, RFC3339, n) == "-", -1).otherwise(1)

    ok = t.rlike(RFC3339) & part(2).between(1, 12)
    month = F.when(ok, part(2)).otherwise(1)
    year = F.when(ok, part(1)).otherwise(1970)
    days = days_from_civil(year.cast("int"), month.cast("int"), part(3))
    offset = F.coalesce(sign(7) * (part(8) * 60 + part(9)), sign(10) * (part(11) * 60 + part(12)), F.lit(0))
    return F.when(ok, days * 86400 + part(4) * 3600 + part(5) * 60 + part(6) - offset * 60)
