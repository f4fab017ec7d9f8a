"""Dates and stamps. The moment is always a parameter, so that a query gives the same rows whenever it runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where courts sit.
COURT_ZONE = "Asia/Kolkata"


def court_day(moment: Column, given: Column | None = None) -> Column:
    """The day asked for, or else the court's today at a moment in UTC."""
    today = F.date_format(F.from_utc_timestamp(moment, COURT_ZONE), "yyyy-MM-dd")
    return today if given is None else F.coalesce(F.nullif(given, F.lit("")), today)


def utc_stamp(moment: Column) -> Column:
    """A moment in UTC as ISO text with a Z."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def case_year(given: Column, moment: Column) -> Column:
    """The year of a case, or else the current one."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.year(moment).cast("string"))
