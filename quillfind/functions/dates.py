"""Dates as seconds since 1970: strict forms, UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _civil_days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a civil date; a day beyond the month's end rolls over into the next."""
    first = F.make_date(y, m, F.lit(1))
    return F.datediff(first, F.lit("1970-01-01").cast("date")).cast("long") + d - 1


def parse_ymd_epoch(c: Column) -> Column:
    """Y-M-D with month 1-12 and day 1-31; 31 February rolls over. Null for anything else."""
    form = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    part = lambda i: F.try_to_number(F.regexp_extract(c, form, i), F.lit("9999")).cast("int")
    y, m, d = (F.when(c.rlike(form), part(i)) for i in (1, 2, 3))
    fits = m.between(1, 12) & d.between(1, 31)
    return F.when(fits, _civil_days(F.when(fits, y), F.when(fits, m), F.when(fits, d)) * 86400)


def parse_rfc3339_epoch(c: Column) -> Column:
    """A time with an offset (Z or +hh:mm), its fraction dropped, or a bare date. Null without an offset."""
    whole = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"
    bare = F.regexp_replace(F.upper(F.regexp_replace(c, r"\.\d+", "")), "^(.{10}) ", "$1T")
    return F.when(c.rlike(whole), F.unix_seconds(F.try_to_timestamp(F.when(c.rlike(whole), bare)))).otherwise(parse_ymd_epoch(c))


def epoch_to_ymd(seconds: Column) -> Column:
    """The date in UTC."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")
