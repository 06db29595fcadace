"""Quality reports on rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terracell.operators import filters, raster


def raster_report(cells: DataFrame, bins: int = raster.HISTOGRAM_BINS) -> DataFrame:
    """Statistics of each raster with its histogram as an array of (bin, count)."""
    entry = F.struct("bin", "count")
    bars = raster.histogram(cells, bins).groupBy(*raster.RASTER).agg(
        F.array_sort(F.collect_list(entry)).alias("histogram")
    )
    return raster.raster_stats(cells).join(bars, list(raster.RASTER), "left")


def raster_compare(cells: DataFrame, first, second, source: str | None = None, keys=()) -> DataFrame:
    """Difference statistics of two days, cell by cell of the same source; over all
    sources together, or a row for each with ``keys=("source",)``."""
    if source is not None:
        cells = cells.filter(F.col("source") == source)
    day = lambda d: filters.time_range(cells, d, d)
    aligned = raster.raster_align(day(first), day(second), on=("source", "row", "col"))
    return raster.raster_diff_stats(aligned, keys=keys)
