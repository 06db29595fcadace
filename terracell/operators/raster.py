"""Statistics, comparison and coarser copies of daily rasters.

A raster is one source and day; ``keys`` says what makes a raster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terracell.operators.append import concat_time
from terracell.operators.sides import per_day_side

RASTER = ("source", "date")
# Histogram bins and the difference that counts.
HISTOGRAM_BINS = 50
DIFFERENCE_LIMIT = 0.001


def raster_stats(cells: DataFrame, keys=RASTER) -> DataFrame:
    """Minimum, maximum, mean, population deviation, missing count and shape."""
    v = F.col("value").cast("double")
    return cells.groupBy(*keys).agg(
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.count_if(v.isNull()).alias("n_missing"),
        (F.max("row") + 1).alias("n_rows"),
        (F.max("col") + 1).alias("n_cols"),
    )


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """1-based bin; the top value belongs to the last bin.  A raster with a single
    value gets the bins half a unit around it."""
    flat = low == high
    low = F.when(flat, low - 0.5).otherwise(low)
    high = F.when(flat, high + 0.5).otherwise(high)
    return F.least(F.width_bucket(v, low, high, F.lit(bins)), F.lit(bins))


def histogram(cells: DataFrame, bins: int = HISTOGRAM_BINS, keys=RASTER) -> DataFrame:
    """Counts in equal-width bins between each raster's minimum and maximum, without
    empty bins; missing values are not counted."""
    keys = list(keys)
    v = F.col("value").cast("double")
    data = cells.filter(v.isNotNull()).select(*keys, v.alias("v"))
    # Two reads of the values and no shuffle of them: both aggregations are nearly
    # complete before their shuffle.
    if keys:
        limits = data.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"))
        if set(keys) <= set(RASTER):
            limits = per_day_side(limits)
        data = data.join(limits, keys)
    else:
        low, high = data.agg(F.min("v")).scalar(), data.agg(F.max("v")).scalar()
        data = data.withColumns({"low": low, "high": high})
    binned = data.withColumn(
        "bin", _bin(F.col("v"), F.col("low"), F.col("high"), bins).cast("int")
    )
    return binned.groupBy(*keys, "low", "high", "bin").agg(F.count("*").alias("count"))


def raster_align(a: DataFrame, b: DataFrame, on=("row", "col")) -> DataFrame:
    """Two rasters side by side, cell by cell: ``a``, ``b``; both may be missing."""
    left = a.select(*on, F.col("value").alias("a"))
    right = b.select(*on, F.col("value").alias("b"))
    return left.join(right, list(on), "full_outer")


def raster_diff_stats(
    aligned: DataFrame, limit: float = DIFFERENCE_LIMIT, keys=()
) -> DataFrame:
    """Largest and mean absolute difference, cells beyond the limit and their share
    of **all** cells, missing ones included."""
    gap = F.abs(F.col("a") - F.col("b"))
    over = F.count_if(gap > F.lit(limit).cast("float"))
    return aligned.groupBy(*keys).agg(
        F.max(gap).cast("double").alias("max_abs"),
        F.avg(gap.cast("double")).alias("mean_abs"),
        over.alias("n_different"),
        (F.lit(100.0) * over / F.count("*")).alias("pct_different"),
    )


def validate_granules(cells: DataFrame, keys=RASTER) -> DataFrame:
    """``no_crs``, ``no_valid_value`` or ``ok`` for each raster; needs ``crs``."""
    valid = F.coalesce(F.bool_or(F.col("value") >= 0), F.lit(False))
    crs = F.bool_or(F.col("crs").isNotNull())
    status = F.when(~crs, "no_crs").when(~valid, "no_valid_value").otherwise("ok")
    return cells.groupBy(*keys).agg(status.alias("status"))


def valid_pct(pixels: DataFrame, column: str = "value", keys=("scene_id",)) -> DataFrame:
    share = F.lit(100.0) * F.count(column) / F.count("*")
    return pixels.groupBy(*keys).agg(share.alias("valid_pct"))


def overviews(cells: DataFrame, levels: int, keys=RASTER) -> DataFrame:
    """Means over blocks of 2, 4, 8 .. cells (level 1, 2, 3 ..), missing left out.

    Each level is built from the sums of the level before, a quarter of its rows; the
    shuffle of a level serves both its own result and the next level.
    """
    keys = list(keys)
    half = lambda c: F.shiftright(F.col(c), 1).alias(c)
    v = F.col("value").cast("double")
    sums = cells.select(*keys, "row", "col", v.alias("_sum"), v.isNotNull().cast("bigint").alias("_n"))
    mean = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).cast("float").alias("value")
    built = []
    for level in range(1, levels + 1):
        sums = sums.groupBy(*keys, half("row"), half("col")).agg(
            F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n")
        )
        built.append(sums.select(*keys, F.lit(level).alias("level"), "row", "col", mean))
    return concat_time(*built)
