"""Time column expressions. The session time zone is UTC; `as_of` stands for the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(c: Column) -> Column:
    """Timestamp of an ISO-like string; null when missing or not a date."""
    return F.when(c.rlike(r"^\s*\d{4}"), F.try_to_timestamp(c))


def clock(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def iso_instant(c: Column, as_of: str) -> Column:
    """UTC instant with milliseconds; a missing or invalid value stands for the clock."""
    return F.date_format(F.coalesce(instant(c), clock(as_of)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def rfc_instant(c: Column, as_of: str) -> Column:
    """Feed date; a missing or invalid value stands for the clock."""
    return F.concat(
        F.date_format(F.coalesce(instant(c), clock(as_of)), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")
    )


def short_date(c: Column) -> Column:
    """`Aug 2, 2026`; empty when missing or invalid."""
    return F.coalesce(F.date_format(instant(c), "MMM d, yyyy"), F.lit(""))


def day_key(c: Column) -> Column:
    """Calendar day; `unknown` when missing or invalid."""
    return F.coalesce(F.date_format(instant(c), "yyyy-MM-dd"), F.lit("unknown"))


def last_modified(c: Column, as_of: str) -> Column:
    return F.date_format(F.coalesce(instant(c), clock(as_of)), "yyyy-MM-dd")


def day_label(key: Column, as_of: str) -> Column:
    """Heading of a date group."""
    today = F.date_format(clock(as_of), "yyyy-MM-dd")
    yesterday = F.date_format(clock(as_of) - F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd")
    return (
        F.when(key == "unknown", F.lit("Unknown date"))
        .when(key == today, F.lit("Today"))
        .when(key == yesterday, F.lit("Yesterday"))
        .otherwise(F.date_format(F.try_to_timestamp(key), "EEEE, MMMM d, yyyy"))
    )


def is_recent(c: Column, as_of: str, days: int = 2) -> Column:
    """Valid and not older than `days`; a time after the clock counts as recent."""
    return F.coalesce(
        instant(c) >= clock(as_of) - F.make_interval(days=F.lit(days)), F.lit(False)
    )


def in_fetch_window(c: Column, as_of: str, hours_from: int = 37, hours_to: int = 25) -> Column:
    """Inside the closed window that lies between `hours_from` and `hours_to` before the clock."""
    start = clock(as_of) - F.make_interval(hours=F.lit(hours_from))
    end = clock(as_of) - F.make_interval(hours=F.lit(hours_to))
    return F.coalesce(instant(c).between(start, end), F.lit(False))
