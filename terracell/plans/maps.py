"""Coloured values of a map view."""

from __future__ import annotations

from pyspark.sql import DataFrame

from terracell.functions import palette
from terracell.operators import filters, mapview
from terracell.schema import STUDY_AREA, VIEW_HEIGHT, VIEW_WIDTH, BBox


def map_view(
    cells: DataFrame,
    day,
    box: BBox = BBox(**STUDY_AREA),
    width: int = VIEW_WIDTH,
    height: int = VIEW_HEIGHT,
    style: str = "precipitation",
) -> DataFrame:
    """Pixels of one day with value, colour and opacity."""
    window = mapview.map_window(filters.time_range(cells, day, day), box, width, height)
    return window.select("*", palette.color_ramp("value", style).alias("_c")).select(
        *window.columns, "_c.*"
    )
