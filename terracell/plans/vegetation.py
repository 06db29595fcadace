"""Vegetation index from scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terracell.functions import geo, values
from terracell.operators import append, calendar, conform, filters, resample, scenes
from terracell.schema import (
    MAX_CLOUD,
    NDVI_BATCH_DAYS,
    VEGETATION_SOURCES,
    BBox,
    Grid,
)
from terracell.plans.ingest import archive_days
from terracell.sources import archive as store


def scenes_of_batches(
    catalog: DataFrame,
    days: DataFrame,
    box: BBox,
    batch_days: int = NDVI_BATCH_DAYS,
    cloud_below: float | None = MAX_CLOUD,
    max_scenes: int | None = None,
) -> DataFrame:
    """Scenes for the batches of the wanted days: over the box, clear enough, and of
    each batch all, or the newest ``max_scenes`` where asked.  A catalog with a
    ``source`` serves only that source's days."""
    keys = ["source", "date"] if "source" in catalog.columns else ["date"]
    batches = calendar.with_batch(days, batch_days).select("date", "source", "batch_start").distinct()
    found = catalog.withColumn("date", F.col("ts").cast("date")).filter(scenes.overlaps(box))
    if cloud_below is not None:
        found = filters.max_cloud(found, cloud_below)
    found = found.join(batches, keys)
    if max_scenes is not None:
        found = scenes.top_scenes(found, max_scenes, ("source", "batch_start"))
    return found


def scene_ndvi(
    nir: DataFrame, red: DataFrame, grid: Grid, res_lat: float, res_lon: float
) -> DataFrame:
    """Both bands to the common grid, then the index; scenes without a value go."""
    both = scenes.band_join(
        resample.bilinear_resample(nir, grid, res_lat, res_lon),
        resample.bilinear_resample(red, grid, res_lat, res_lon),
    )
    index = both.withColumn("value", values.ndvi("nir", "red"))
    return filters.drop_empty_scenes(index).drop("nir", "red")


def scene_scaled(raw: DataFrame, grid: Grid, res_lat: float, res_lon: float) -> DataFrame:
    """A packed index to the common grid, scaled and masked."""
    regridded = resample.bilinear_resample(raw, grid, res_lat, res_lon)
    index = regridded.withColumn("value", values.scale_and_mask("value"))
    return filters.drop_empty_scenes(index)


def ingest_vegetation(
    pixels: DataFrame,
    picked: DataFrame,
    grid: Grid,
    box: BBox,
    daily_path: str,
    archive_path: str,
    work_path: str,
) -> None:
    """Index pixels of the picked scenes to the daily set and the archive.

    Where scenes of one day share a cell the latest scene counts.  The finished cells
    are written to ``work_path`` once; both targets are filled from there.
    """
    spark = pixels.sparkSession
    chosen = picked.filter(F.col("source").isin(*VEGETATION_SOURCES))
    chosen = chosen.select("scene_id", "ts", "source", F.col("ts").cast("date").alias("date"))
    placed = pixels.join(chosen, "scene_id").withColumns(
        {"lat": geo.lat_of("row", grid), "lon": geo.lon_of("col", grid)}
    )
    last = append.last_per_day(
        placed.select("source", "date", "row", "col", "ts", "scene_id", "lat", "lon", "value"),
        order=("ts", "scene_id"),
    )
    finished = conform.with_keys(last.drop("ts", "scene_id"), grid)
    finished.write.mode("overwrite").parquet(f"{work_path}/cells")
    cells = spark.read.parquet(f"{work_path}/cells")
    store.write_daily(filters.clip_box(cells, box, grid), daily_path)
    before = archive_days(spark, archive_path, cells)
    days = cells.select("date").distinct().count()
    store.write_archive(append.new_rows(before, cells), archive_path, days=days)
