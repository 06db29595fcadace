"""Values behind the picture of a map view."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terracell.functions import geo
from terracell.operators.filters import select_box
from terracell.schema import BBox


def map_window(
    cells: DataFrame, box: BBox, width: int, height: int, keys=("source", "date")
) -> DataFrame:
    """Value of each pixel of a width x height view that holds a cell centre.

    Of several centres in a pixel the one nearest to its middle counts; ties go to
    the smaller row, then column.  The minimum is pre-aggregated in each task.
    """
    x, y = geo.lonlat_to_pixel("lat", "lon", F.lit(width), F.lit(height), box)
    px = (F.col("lon") - F.lit(box.west)) / F.lit(box.east - box.west) * F.lit(width)
    py = (F.lit(box.north) - F.col("lat")) / F.lit(box.north - box.south) * F.lit(height)
    seen = select_box(cells, box).withColumns(
        {
            "x": F.least(x, F.lit(width - 1)),
            "y": F.least(y, F.lit(height - 1)),
            "_px": px,
            "_py": py,
        }
    )
    gap = F.pow(F.col("_px") - F.col("x") - 0.5, 2) + F.pow(F.col("_py") - F.col("y") - 0.5, 2)
    nearest = F.min(F.struct(gap.alias("gap"), "row", "col", "value")).alias("_near")
    return seen.groupBy(*keys, "x", "y").agg(nearest).select(*keys, "x", "y", "_near.value")
