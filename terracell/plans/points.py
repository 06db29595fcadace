"""Histories, exceedances and single values at points.

``requests`` is a table: one row or millions go the same way.  Equal questions are
answered once: the cube meets the distinct (cell, period, trigger) combinations, and
the answers then join the requests, so many copies of one request cost nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terracell.functions import geo, values
from terracell.functions.dates import parse_day
from terracell.functions.requests import request_status
from terracell.operators import aggregates, append, filters, lookup
from terracell.schema import (
    POINT_TOLERANCE_DEG,
    PRECIPITATION_SOURCES,
    STUDY_AREA,
    BBox,
    Grid,
)

_QUESTION = ["source", "row", "col", "start_date", "end_date"]


def site_series(
    cells: DataFrame,
    grid: Grid,
    lat: float,
    lon: float,
    start,
    end,
    source: str | None = None,
    tolerance: float = POINT_TOLERANCE_DEG,
) -> DataFrame:
    """One site's series by literal predicates, all of which reach the scan."""
    row, col = grid.nearest(lat, lon)
    near = abs(grid.lat0 + grid.dlat * row - lat) <= tolerance
    near = near and abs(grid.lon0 + grid.dlon * col - lon) <= tolerance
    hit = (F.col("row") == row) & (F.col("col") == col) & F.lit(near)
    if "tile_id" in cells.columns:
        hit = (F.col("tile_id") == grid.tile_of(row, col)) & hit
    if source is not None:
        hit = (F.col("source") == source) & hit
    return filters.time_range(cells, start, end).filter(hit)


def check_point_requests(
    requests: DataFrame,
    grid: Grid,
    sources=PRECIPITATION_SOURCES,
    as_of=None,
    tolerance: float = POINT_TOLERANCE_DEG,
    needs=(),
) -> DataFrame:
    """Requests with parsed days, nearest cell and ``status``; a good request out of
    tolerance is ``no_cell``.  Only good requests keep their cell."""
    checked = requests.withColumn(
        "status", request_status(requests.columns, sources, as_of, needs=needs)
    )
    checked = checked.withColumns(
        {"start_date": parse_day("start_date"), "end_date": parse_day("end_date")}
    )
    snapped = lookup.snap_sites(checked, grid, tolerance)
    off = (F.col("status") == "ok") & ~F.col("matched")
    snapped = snapped.withColumn("status", F.when(off, "no_cell").otherwise(F.col("status")))
    good = F.col("status") == "ok"
    return snapped.withColumns({c: F.when(good, F.col(c)) for c in ("row", "col")})


def _questions(checked: DataFrame, keys) -> DataFrame:
    return checked.filter("status = 'ok'").select(*keys).distinct()


def _series(cells: DataFrame, questions: DataFrame) -> DataFrame:
    """Cells of each question: an equi-join on source, cell and (where the archive is
    laid out by year) year, so the other partitions are skipped."""
    keys = ["source", "row", "col"]
    if "year" in cells.columns:
        questions, keys = lookup.by_year(questions), [*keys, "year"]
    joined = cells.join(questions, keys)
    return joined.filter(F.col("date").between(F.col("start_date"), F.col("end_date")))


def history_rows(cells: DataFrame, requests: DataFrame, grid: Grid, order=(), **check) -> DataFrame:
    """One row per request and day: ``date``, rounded ``value``.  Where a day comes
    twice the last by ``order`` counts."""
    checked = check_point_requests(requests, grid, **check)
    series = _series(cells, _questions(checked, _QUESTION))
    series = series.select(*_QUESTION, "date", *order, "value")
    days = append.last_per_day(series, [*_QUESTION, "date"], order)
    return checked.select("request_id", *_QUESTION).join(days, _QUESTION).select(
        "request_id", "date", values.round2("value").alias("value")
    )


def point_history(cells: DataFrame, requests: DataFrame, grid: Grid, order=(), **check) -> DataFrame:
    """Every request with ``status`` and ``history``, a map from day to value."""
    checked = check_point_requests(requests, grid, **check)
    series = _series(cells, _questions(checked, _QUESTION))
    series = series.select(*_QUESTION, "date", *order, "value")
    days = append.last_per_day(series, [*_QUESTION, "date"], order)
    answers = aggregates.history_map(days, _QUESTION)
    nothing = F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<double>")
    )
    return (
        checked.join(answers, _QUESTION, "left")
        .withColumn("history", F.coalesce("history", nothing))
        .drop("row", "col", "tile_id", "matched")
    )


def point_triggers(cells: DataFrame, requests: DataFrame, grid: Grid, **check) -> DataFrame:
    """Every request with ``status``, ``n_exceedances`` and the list of them."""
    checked = check_point_requests(requests, grid, needs=("trigger",), **check)
    keys = [*_QUESTION, "trigger"]
    questions = _questions(checked, keys)
    series = _series(filters.above_lowest(cells, questions), questions)
    over = series.filter(values.exceeds("value", F.col("trigger")))
    answers = aggregates.exceedance_list(over, keys)
    nothing = F.array().cast("array<struct<date:date,value:double>>")
    return (
        checked.join(answers, keys, "left")
        .withColumn("n_exceedances", F.coalesce("n_exceedances", F.lit(0)))
        .withColumn("exceedances", F.coalesce("exceedances", nothing))
        .drop("row", "col", "tile_id", "matched")
    )


def trigger_rows(triggers: DataFrame, *keep) -> DataFrame:
    """The lists of ``point_triggers`` as rows."""
    return triggers.select(*keep, F.inline("exceedances"))


def site_batch_triggers(
    cells: DataFrame, sites: DataFrame, grid: Grid, source, start, end, trigger, **check
) -> DataFrame:
    """One trigger request for every site of a list."""
    requests = lookup.batch_sites(
        sites, source=source, start_date=start, end_date=end, trigger=float(trigger)
    )
    return point_triggers(cells, requests.withColumnRenamed("site_id", "request_id"), grid, **check)


def pixel_value(
    cells: DataFrame,
    requests: DataFrame,
    grid: Grid,
    box: BBox = BBox(**STUDY_AREA),
    sources=PRECIPITATION_SOURCES,
    as_of=None,
) -> DataFrame:
    """Value under a pixel of a map view on exactly one day.

    The pixel is found as the picture would (truncated index); its middle picks the
    cell it lies in.  ``status`` is ``no_data`` where the day or the cell has nothing.
    """
    checked = requests.withColumn(
        "status", request_status(requests.columns, sources, as_of, days=("date",), needs=("width", "height"))
    ).withColumn("date", parse_day("date"))
    x, y = geo.lonlat_to_pixel("lat", "lon", "width", "height", box)
    px_lon = F.lit(box.west) + (F.col("x") + 0.5) / F.col("width") * F.lit(box.east - box.west)
    px_lat = F.lit(box.north) - (F.col("y") + 0.5) / F.col("height") * F.lit(
        box.north - box.south
    )
    placed = checked.withColumns({"x": x, "y": y}).withColumns(
        {"_site_lat": F.col("lat"), "_site_lon": F.col("lon"), "lat": px_lat, "lon": px_lon}
    )
    half = max(abs(grid.dlat), abs(grid.dlon)) / 2
    placed = (
        lookup.snap_sites(placed, grid, half)
        .drop("lat", "lon")
        .withColumnsRenamed({"_site_lat": "lat", "_site_lon": "lon"})
    )
    keys = ["source", "date", "row", "col"]
    good = (F.col("status") == "ok") & F.col("matched")
    on_day = placed.withColumns({c: F.when(good, F.col(c)) for c in ("row", "col")})
    # Two archives of one day would both answer: the larger value does.
    asked = on_day.filter(good).select(*keys).distinct()
    if "year" in cells.columns:  # skips the other years of the archive
        asked = asked.withColumn("year", F.year("date"))
    found = cells.join(asked, asked.columns, "left_semi")
    found = found.groupBy(*keys).agg(F.max("value").alias("value"))
    empty = (F.col("status") == "ok") & F.col("value").isNull()
    return (
        on_day.join(found, keys, "left")
        .withColumn("status", F.when(empty, "no_data").otherwise(F.col("status")))
        .withColumn("value", values.round2("value"))
        .drop("row", "col", "tile_id", "matched")
    )
