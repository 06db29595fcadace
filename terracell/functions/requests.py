"""Checks on requests and on single-pixel answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terracell.functions.dates import as_date, parse_day
from terracell.functions.geo import _col
from terracell.functions.values import round2


def request_status(
    columns,
    sources=None,
    as_of=None,
    lat: str = "lat",
    lon: str = "lon",
    days=("start_date", "end_date"),
    needs=(),
) -> Column:
    """First problem of a request row, or ``ok``.

    ``missing_location``, ``missing_`` and a name out of ``needs``, ``bad_date``,
    ``future_date`` (needs ``as_of``), ``bad_range``, ``unknown_source`` (needs ``sources``).
    """
    status = F.when(F.col(lat).isNull() | F.col(lon).isNull(), "missing_location")
    for c in needs:
        status = status.when(F.col(c).isNull(), f"missing_{c}")
    present = [c for c in days if c in columns]
    parsed = [parse_day(c) for c in present]
    for d in parsed:
        status = status.when(d.isNull(), "bad_date")
    if as_of is not None:
        for d in parsed:
            status = status.when(d > as_date(as_of), "future_date")
    if len(parsed) == 2:
        status = status.when(parsed[0] > parsed[1], "bad_range")
    if sources is not None:
        known = F.coalesce(F.col("source").isin(list(sources)), F.lit(False))
        status = status.when(~known, "unknown_source")
    return status.otherwise("ok")


def json_pixel_value(text) -> Column:
    """Value of the first feature in a pixel answer, two digits; NULL if there is none."""
    raw = F.get_json_object(_col(text), "$.features[0].properties.GRAY_INDEX")
    return round2(raw.try_cast("double"))
