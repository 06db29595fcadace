"""Stored coarser copies of daily rasters, and the choice of one for a view.

Level k has means over blocks of 2^k x 2^k cells.  A day's copies are replaced as a
whole, like the day in the daily set, so a repeated run is harmless.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from terracell.functions import geo
from terracell.operators import filters, mapview, raster
from terracell.schema import BBox, Grid

_SCHEMA = "tile_id int, row int, col int, value float, level int, source string, date date"


def write_pyramid(cells: DataFrame, path: str, levels: int, grid: Grid) -> None:
    """Levels 1 to ``levels`` of whole days, a partition for each level, source and day."""
    coarse = raster.overviews(cells, levels)
    size = F.lit(grid.tile)
    tile = F.floor(F.col("row") / size) * F.lit(grid.tiles_per_row) + F.floor(F.col("col") / size)
    rows = coarse.withColumn("tile_id", tile.cast("int"))
    # A day of a source is at most a third of its raster; its coarser levels go along.
    (
        rows.repartition("source", "date", F.floor(F.col("tile_id") / 1024))
        .sortWithinPartitions("level", "source", "date", "tile_id", "row", "col")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("level", "source", "date")
        .parquet(path)
    )


def scan_level(spark: SparkSession, path: str, level: int, grid: Grid) -> DataFrame:
    """Cells of one level with the place of their middle; other levels are not opened."""
    rows = spark.read.schema(_SCHEMA).parquet(path).filter(F.col("level") == level)
    block = 1 << level

    def middle(c: str, n: int):  # blocks at the far edge are smaller
        first = F.col(c) * block
        return (first + F.least(first + (block - 1), F.lit(n - 1))) / 2

    return rows.withColumns(
        {"lat": geo.lat_of(middle("row", grid.n_rows), grid), "lon": geo.lon_of(middle("col", grid.n_cols), grid)}
    )


def pick_level(grid: Grid, box: BBox, width: int, height: int, levels: int) -> int:
    """The coarsest level whose blocks are no larger than a pixel; 0 is full resolution."""
    pixel = min((box.north - box.south) / height / abs(grid.dlat), (box.east - box.west) / width / abs(grid.dlon))
    return min(levels, max(0, math.floor(math.log2(pixel)))) if pixel >= 1 else 0


def view(
    cells: DataFrame, path: str, levels: int, grid: Grid, box: BBox, width: int, height: int, start, end
) -> DataFrame:
    """``mapview.map_window`` of some days, from the level that fits the view.

    ``cells`` is the full resolution, for views closer than the pyramid.
    """
    level = pick_level(grid, box, width, height, levels)
    source = cells if level == 0 else scan_level(cells.sparkSession, path, level, grid)
    return mapview.map_window(filters.time_range(source, start, end), box, width, height)
