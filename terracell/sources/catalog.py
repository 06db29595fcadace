"""What the archive holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terracell.operators.aggregates import time_extent

# Sources of each data type.
DATA_TYPES = {
    "precipitation": ("chirps", "merge"),
    "temperature": ("temp_max", "temp_min", "temp"),
}


def available_sources(cells: DataFrame, data_type: str | None = None) -> DataFrame:
    names = cells.select("source").distinct()
    return names.filter(F.col("source").isin(*DATA_TYPES[data_type])) if data_type else names


def with_loaded_flag(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds ``is_loaded``: whether the request's source has data."""
    have = available_sources(cells).withColumn("is_loaded", F.lit(True))
    flagged = requests.join(have, "source", "left")
    return flagged.withColumn("is_loaded", F.coalesce("is_loaded", F.lit(False)))


def dataset_info(cells: DataFrame) -> DataFrame:
    """Days, time range and axis sizes of each source, and its variables.

    Axes are made distinct first, so each count works on axis values, not on cells.
    """
    axes = (
        cells.select("source", F.explode(F.array(
            F.struct(F.lit("lat").alias("axis"), F.col("lat").alias("coord")),
            F.struct(F.lit("lon").alias("axis"), F.col("lon").alias("coord")),
        )).alias("a"))
        .select("source", "a.*")
        .distinct()
        .groupBy("source")
        .agg(
            F.count_if(F.col("axis") == "lat").alias("n_lat"),
            F.count_if(F.col("axis") == "lon").alias("n_lon"),
        )
    )
    fixed = {"source", "date", "year", "tile_id", "row", "col", "lat", "lon"}
    variables = sorted(c for c in cells.columns if c not in fixed)
    return (
        time_extent(cells)
        .join(axes, "source")
        .withColumn("variables", F.array(*[F.lit(v) for v in variables]))
    )
