"""Target grids and bilinear resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from terracell.functions.geo import _col
from terracell.functions.values import missing_if_nan
from terracell.schema import Grid

MOST_WAYS = 64  # times as many tasks, however fine the grid


def axis_size(low, high, resolution: float, max_pixels: int | None = None) -> Column:
    """Number of grid lines: whole steps in the range, at most ``max_pixels`` where asked."""
    steps = ((_col(high) - _col(low)) / F.lit(resolution)).cast("int")
    return steps if max_pixels is None else F.least(steps, F.lit(max_pixels))


def grid_axes(areas: DataFrame, resolution: float, max_pixels: int | None = None, box: str = "area") -> DataFrame:
    """Coordinates of both axes of each area's grid: ``axis``, ``idx``, ``coord``.

    Ends are included and steps are even; rows run from north to south.  An area
    thinner than one step has no lines.
    """

    def line(axis, first, last, low, high):
        n = axis_size(F.col(f"{box}.{low}"), F.col(f"{box}.{high}"), resolution, max_pixels)
        idx = F.when(n > 0, F.sequence(F.lit(0), n - 1))
        a, b = F.col(f"{box}.{first}"), F.col(f"{box}.{last}")
        coord = F.when(F.col("n") == 1, a).otherwise(
            a + (b - a) * F.col("idx") / (F.col("n") - 1)
        )
        return (
            areas.withColumns({"axis": F.lit(axis), "n": n, "idx": F.explode(idx)})
            .withColumn("coord", coord)
            .drop("n")
        )

    return line("lat", "north", "south", "south", "north").unionByName(
        line("lon", "west", "east", "west", "east")
    )


def bilinear_resample(
    pixels: DataFrame, grid: Grid, res_lat: float, res_lon: float, keys=("scene_id",)
) -> DataFrame:
    """Pixels at ``lat``, ``lon`` spaced ``res_lat``, ``res_lon`` to the cells of a grid.

    Turned round: each pixel is handed to the grid cells it has weight in, and a
    cell's value is the weighted mean of what it got.  That is one aggregation and no
    join, and missing neighbours are left out of both sums.

    Pixels are spelled out along rows, dealt by row over as many more tasks as they
    become cells, and only there spelled out along columns: a task holds the cells of
    its rows, and nothing is moved again.
    """
    keys = list(keys)

    def reach(coord, res, start, step, n):
        """Grid indices less than one pixel spacing away."""
        a = (F.col(coord) - F.lit(res) - F.lit(start)) / F.lit(step)
        b = (F.col(coord) + F.lit(res) - F.lit(start)) / F.lit(step)
        low = F.greatest(F.ceil(F.least(a, b)), F.lit(0))
        high = F.least(F.floor(F.greatest(a, b)), F.lit(n - 1))
        return F.explode(F.when(low <= high, F.sequence(low, high)))

    def weight(coord, idx, res, start, step):
        gap = F.abs(F.col(coord) - (F.lit(start) + F.lit(step) * F.col(idx)))
        return F.lit(1.0) - gap / F.lit(res)

    def ways(res, step):
        """Grid lines within reach of a pixel, at most."""
        return max(1, math.ceil(2 * res / abs(step)))

    g = grid
    tasks = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks *= min(MOST_WAYS, ways(res_lat, g.dlat) * ways(res_lon, g.dlon))
    along = (
        pixels.withColumn("value", missing_if_nan("value"))
        .filter(F.col("value").isNotNull())
        .withColumn("_i", reach("lat", float(res_lat), g.lat0, g.dlat, g.n_rows))
        .withColumn("_wi", weight("lat", "_i", float(res_lat), g.lat0, g.dlat))
        .filter(F.col("_wi") > 0)
        .select(*keys, "lon", "value", F.col("_i").cast("int").alias("_i"), "_wi")
    )
    near = (
        along.repartition(tasks, *keys, "_i")
        .withColumn("_j", reach("lon", float(res_lon), g.lon0, g.dlon, g.n_cols))
        .withColumn("_wj", weight("lon", "_j", float(res_lon), g.lon0, g.dlon))
        .filter(F.col("_wj") > 0)
        .withColumn("_w", F.col("_wi") * F.col("_wj"))
    )
    mean = F.sum(F.col("_w") * F.col("value").cast("double")) / F.sum("_w")
    return near.groupBy(
        *keys, F.col("_i").alias("row"), F.col("_j").cast("int").alias("col")
    ).agg(mean.cast("float").alias("value"))
