"""Rain summed over the days of an event, in classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terracell.functions import geo, palette
from terracell.operators import aggregates, filters


def event_accumulation(
    cells: DataFrame, days, bounds=None, colors=None, source: str | None = None
) -> DataFrame:
    """Sum of each cell over a list of days (gaps allowed), its class and colour.

    ``source`` picks one; a cube of several must name it, or their values add up.
    """
    if source is not None:
        cells = cells.filter(F.col("source") == source)
    bounds = [0.0] + [float(b) for b in (bounds or palette.DEFAULT_BOUNDS.split(","))]
    colors = [palette.TRANSPARENT, *(colors or palette.DEFAULT_COLORS.split(","))]
    picked = filters.dates_in(cells, days).withColumn("lon", geo.normalize_lon("lon"))
    summed = aggregates.accumulate(picked)
    return summed.withColumn("class", palette.classify("total", bounds)).withColumn(
        "color", palette.class_color(F.col("class"), len(bounds), colors)
    )
