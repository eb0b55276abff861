"""Dates: stored ISO strings, their timestamps, and capture dates guessed from paths. Session zone: UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def captured_ts(captured_at="captured_at", modified_ts="modified_ts") -> Column:
    """The stored instant, or the file's modification time where the string can not be read."""
    return F.coalesce(F.try_to_timestamp(_c(captured_at)), F.timestamp_seconds(_c(modified_ts)))


def iso(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def year_of(captured_at="captured_at") -> Column:
    return F.substring(_c(captured_at), 1, 4)


def exif_date(value) -> Column:
    return iso(F.try_to_timestamp(_c(value), F.lit("yyyy:MM:dd HH:mm:ss")))


def guessed_date(key, modified_ts) -> Column:
    """Of the path's numbers: the first from 1900 to 2100 is the year; of the others, the first up to 12 is
    the month and the first up to 31 that differs from it the day. No year or no such date: the file's time."""
    numbers = F.transform(F.regexp_extract_all(_c(key), F.lit(r"(\d+)"), 1), lambda s: s.try_cast("long"))
    first = lambda arr, cond: F.try_element_at(F.filter(arr, cond), F.lit(1))
    year = first(numbers, lambda n: n.between(1900, 2100))
    rest = F.filter(numbers, lambda n: n != year)
    month = F.coalesce(first(rest, lambda n: n.between(1, 12)), F.lit(1).cast("long"))
    day = F.coalesce(first(rest, lambda n: n.between(1, 31) & (n != month)), F.lit(1).cast("long"))
    ts = F.try_make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), F.lit(0), F.lit(0), F.lit(0.0))
    return iso(F.coalesce(ts, F.timestamp_seconds(_c(modified_ts))))


def label(ts, kind: str) -> Column:
    """Bucket keys and titles of dates."""
    return F.date_format(_c(ts), {"month": "yyyy-MM", "day": "yyyy-MM-dd", "month_title": "MMMM yyyy", "day_title": "MMMM dd, yyyy", "short": "MMM dd", "short_year": "MMM dd, yyyy"}[kind])


def eta_seconds(elapsed: float, done: int, total: int) -> float | None:
    """Linear estimate of the time left; None unless some but not all is done."""
    if not 0 < done < total or elapsed <= 0:
        return None
    return elapsed / done * (total - done)
