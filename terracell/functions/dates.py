"""Days: parsing, default windows, lag checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from terracell.functions.geo import _col
from terracell.schema import ERA5_LAG_DAYS

# How a day is written in file names, one pattern for each mode.
NAME_PATTERNS = {
    "first": r"([0-9]{8})",
    "last": r".*([0-9]{8}).*",
    "tail": r"(?:^|_)([0-9]{8})(?:\.[^._/]*)?$",
    "latam": r"_latam_([0-9]{8})\.tif",
}


def as_date(x) -> Column:
    """A DATE column from a column, a ``date`` or an ISO string."""
    if isinstance(x, Column):
        return x.cast("date")
    if isinstance(x, dt.date):
        return F.lit(x).cast("date")
    return F.lit(str(x)).cast("date")


def parse_day(text, fmt: str = "yyyy-MM-dd") -> Column:
    """Strict parse; a bad text is NULL, never an error."""
    return F.try_to_timestamp(_col(text), F.lit(fmt)).cast("date")


def date_from_name(path, mode: str = "first", prefix: str | None = None) -> Column:
    """Day written as yyyyMMdd in a file name; NULL if none or impossible.

    ``prefix`` looks for the eight digits right behind ``<prefix>_``.
    """
    pattern = rf"{prefix}_([0-9]{{8}})" if prefix else NAME_PATTERNS[mode]
    return parse_day(F.regexp_extract(_col(path), pattern, 1), "yyyyMMdd")


def decode_cf_time(offset, unit: str = "days", epoch: str = "1970-01-01") -> Column:
    """Numeric time axis (so many units since an epoch) to a timestamp."""
    seconds = {"days": 86400, "hours": 3600, "minutes": 60, "seconds": 1}[unit]
    start = F.lit(epoch).cast("timestamp_ntz")
    micros = F.round(_col(offset).cast("double") * F.lit(seconds * 1_000_000)).cast("long")
    return start + F.make_dt_interval(secs=(micros / F.lit(1_000_000)).cast("decimal(18,6)"))


def iso_time(text) -> Column:
    """A bare day gets its midnight; anything else stays."""
    text = _col(text)
    return F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(text)


def days_between(start, end) -> Column:
    """Array of days, both ends included; empty when start is after end."""
    start, end = as_date(start), as_date(end)
    empty = F.array().cast("array<date>")
    return F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day"))).otherwise(empty)


def date_parts(days) -> Column:
    """Distinct zero-padded years, months and days of an array of days."""
    days = _col(days)

    def part(fmt):
        return F.array_sort(F.array_distinct(F.transform(days, lambda d: F.date_format(d, fmt))))

    return F.struct(
        part("yyyy").alias("years"), part("MM").alias("months"), part("dd").alias("days")
    )


def flow_window(source, as_of) -> Column:
    """Default first and last day an ingest run looks at, by source."""
    source, as_of = _col(source), as_date(_col(as_of))
    month = F.trunc(as_of, "MM")
    previous_end = F.date_sub(month, 1)
    previous_start = F.add_months(month, -1)
    # Ten years back from the end of last month, one day later.
    ten_years = F.date_add(F.add_months(previous_end, -120), 1)
    start = F.when(source == "chirps", ten_years).otherwise(previous_start)
    end = (
        F.when(source == "merge", F.date_sub(as_of, 1))
        .when(source == "era5", F.date_sub(as_of, ERA5_LAG_DAYS))
        .otherwise(previous_end)
    )
    return F.struct(start.alias("start_date"), end.alias("end_date"))


def ingest_status(start, end, as_of, lag_days: int = ERA5_LAG_DAYS) -> Column:
    """``bad_range``, ``not_yet_published`` (newer than the lag allows) or ``ok``."""
    start, end, as_of = (as_date(_col(c)) for c in (start, end, as_of))
    return (
        F.when(start > end, "bad_range")
        .when(end > F.date_sub(as_of, lag_days), "not_yet_published")
        .otherwise("ok")
    )
