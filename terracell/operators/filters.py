"""Row filters.  All are plain predicates, so they reach the Parquet scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from terracell.functions import geo, values
from terracell.functions.dates import as_date
from terracell.operators.sides import per_day_side
from terracell.schema import BBox, Grid


def select_box(cells: DataFrame, box: BBox) -> DataFrame:
    """Cells with their centre inside, edges included."""
    return cells.filter(geo.in_box("lat", "lon", geo.box_literal(box)))


def clip_box(cells: DataFrame, box: BBox, grid: Grid) -> DataFrame:
    """Cells that touch the box: half a cell is added on each side."""
    h, w = abs(grid.dlat) / 2, abs(grid.dlon) / 2
    return select_box(cells, BBox(box.west - w, box.south - h, box.east + w, box.north + h))


def time_range(cells: DataFrame, start, end) -> DataFrame:
    """Days from start to end, both included.

    A date predicate alone prunes no partition of a table laid out by year, so the
    years are spelled out as well.
    """
    start, end = as_date(start), as_date(end)
    keep = F.col("date").between(start, end)
    if "year" in cells.columns:
        keep = F.col("year").between(F.year(start), F.year(end)) & keep
    return cells.filter(keep)


def dates_in(cells: DataFrame, days) -> DataFrame:
    """Days of an explicit list; ``None`` keeps all, an empty list keeps none."""
    if days is None:
        return cells
    days = [d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in days]
    keep = F.col("date").isin(days)
    if "year" in cells.columns:
        keep = F.col("year").isin(sorted({d.year for d in days})) & keep
    return cells.filter(keep)


def exceeds(cells: DataFrame, trigger, column: str = "value") -> DataFrame:
    return cells.filter(values.exceeds(column, trigger))


def above_lowest(cells: DataFrame, requests: DataFrame) -> DataFrame:
    """Cells above the lowest trigger anyone asks for.  The one number is found first,
    and most cells then leave in the scan stage, before any join."""
    lowest = requests.agg(F.min("trigger")).scalar()
    return cells.filter(values.exceeds("value", lowest))


def within_radius(cells: DataFrame, lat: float, lon: float, radius_km: float) -> DataFrame:
    return cells.filter(
        geo.within_radius("lat", "lon", F.lit(lat), F.lit(lon), F.lit(radius_km))
    )


def max_cloud(scenes: DataFrame, percent: float) -> DataFrame:
    return scenes.filter(F.col("cloud_cover") < F.lit(float(percent)))


def drop_missing(cells: DataFrame, column: str = "value") -> DataFrame:
    return cells.filter(F.col(column).isNotNull())


def drop_empty_days(cells: DataFrame) -> DataFrame:
    """Days on which every cell is missing go, the other days stay whole."""
    days = drop_missing(cells).select("source", "date").distinct()
    return cells.join(per_day_side(days), ["source", "date"], "left_semi")


def drop_empty_scenes(pixels: DataFrame, column: str = "value") -> DataFrame:
    """Scenes in which every pixel is missing go, the other scenes stay whole."""
    scenes = drop_missing(pixels, column).select("scene_id").distinct()
    return pixels.join(scenes, "scene_id", "left_semi")


def skip_existing(targets: DataFrame, inventory: DataFrame, keys=("source", "date")) -> DataFrame:
    """Targets that the inventory does not have yet."""
    keys = list(keys)
    return targets.join(inventory.select(*keys).distinct(), keys, "left_anti")
