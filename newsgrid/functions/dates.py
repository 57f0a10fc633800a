"""Instant parsing and age arithmetic.  ``as_of`` is always an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from newsgrid.schemas import WINDOWS


def instant(as_of: str | datetime | Column) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def parse_instant(text: Column, as_of) -> Column:
    """ISO or feed-style time, else ``as_of``."""
    return F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(F.regexp_replace(text, r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(F.regexp_replace(text, r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z")),
        instant(as_of))


# How advisories word their dates.
_REISSUED = (r"(?:Reissued|Updated|Issued)(?:\s+with\s+[\w\s]+)?[:\s]+"
             r"([A-Z][a-z]+\s+\d{1,2},\s*\d{4})")
_LAST_UPDATED = r"Last updated[:\s]+(\d{1,2}\.\d{1,2}\.\d{4})"


def reissue_date(text: Column) -> Column:
    """``Reissued/Updated/Issued … Month d, yyyy``; null when absent or impossible."""
    found = F.regexp_replace(F.regexp_extract(text, _REISSUED, 1), r",\s*", ", ")
    return F.try_to_timestamp(F.regexp_replace(found, r"\s+", " "), F.lit("MMMM d, yyyy"))


def last_updated_date(text: Column) -> Column:
    """``Last updated: dd.MM.yyyy``."""
    return F.try_to_timestamp(F.regexp_extract(text, _LAST_UPDATED, 1), F.lit("d.M.yyyy"))


def window_start(as_of, window: str) -> Column:
    """Start of a named window; unknown names mean 24 hours."""
    seconds = WINDOWS.get(window, WINDOWS["24h"])
    return instant(as_of) - F.make_interval(secs=F.lit(seconds))


def in_window(ts: Column, as_of, window: str, inclusive: bool = False) -> Column:
    start = window_start(as_of, window)
    return ts >= start if inclusive else ts > start


def age_seconds(ts: Column, as_of) -> Column:
    """Whole seconds since ``ts``, never negative; a missing time is the epoch."""
    then = F.coalesce(F.unix_seconds(ts), F.lit(0))
    return F.greatest(F.lit(0), F.unix_seconds(instant(as_of)) - then)


def plus_hours(ts: Column, hours: int) -> Column:
    return ts + F.make_interval(hours=F.lit(hours))


def as_instant(c: Column, kind: str) -> Column:
    """Strings are parsed leniently, timestamps pass through."""
    return F.try_to_timestamp(c) if kind == "string" else c.cast("timestamp")


def local_date(ts: Column, zone: str = "UTC") -> Column:
    """Calendar date of an instant in a site's own time zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))
