"""Finding missing days and filling them.

Every job may be run again after a failure: daily rasters are replaced a day at a
time, and the archive takes only days it does not have.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from terracell.functions import names, values
from terracell.operators import append, calendar, conform, filters, lookup, raster
from terracell.operators.sides import per_day_side
from terracell.schema import (
    ARCHIVE_SCHEMA,
    CRS,
    DAILY_SCHEMA,
    ERA5_BATCH_DAYS,
    PRECIPITATION_NAMES,
    TEMPERATURE_NAMES,
    BBox,
    Grid,
)
from terracell.sources import archive as store
from terracell.sources import granules as index


def _or_empty(spark: SparkSession, read, schema) -> DataFrame:
    """A table, or no rows where it has not been written yet."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def daily_days(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The wanted days that have a daily raster.  Source and day are partition names:
    no column is read, and the folders of other days are not opened."""
    cells = _or_empty(spark, lambda: store.scan_daily(spark, path), DAILY_SCHEMA)
    return append.restrict_dates(cells.select("source", "date"), wanted).distinct()


def archive_or_empty(spark: SparkSession, path: str) -> DataFrame:
    return _or_empty(spark, lambda: store.scan_archive(spark, path), ARCHIVE_SCHEMA)


def archive_days(spark: SparkSession, path: str, years: DataFrame) -> DataFrame:
    """Days the archive has in some years (``source``, ``year``); others are not read."""
    years = years.select("source", "year").distinct()
    cells = archive_or_empty(spark, path).select("source", "year", "date")
    # A row per source and year: smaller still than one per day.
    kept = cells.join(per_day_side(years), ["source", "year"], "left_semi")
    return calendar.distinct_dates(kept)


def run_outcomes(wanted: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``skipped`` (was there), ``created`` or ``error`` for each wanted day."""
    keys = ["source", "date"]
    flag = lambda df, n: df.select(*keys).distinct().withColumn(n, F.lit(True))
    status = F.when(F.col("_b"), "skipped").when(F.col("_a"), "created").otherwise("error")
    return (
        wanted.join(flag(before, "_b"), keys, "left")
        .join(flag(after, "_a"), keys, "left")
        .select(*keys, status.alias("status"))
    )


def _freeze(days: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it back: it must keep the state from before a write to
    the table it was taken from, or is read more than once."""
    days.write.mode("overwrite").parquet(path)
    return days.sparkSession.read.parquet(path)


def _times(raw: DataFrame) -> tuple[str, ...]:
    """The column that orders several rasters of a day, where there is one."""
    return ("time",) if "time" in raw.columns else ()


def _one_per_day(cells: DataFrame, order) -> DataFrame:
    """One row for each source, day and cell: the last by time, else the largest value."""
    keys = [c for c in cells.columns if c != "value" and c not in order]
    return append.last_per_day(cells, keys, order).drop(*order)


def ingest_precipitation(
    raw: DataFrame,
    windows: DataFrame,
    grid: Grid,
    box: BBox,
    daily_path: str,
    work_path: str,
    index_path: str | None = None,
    aliases=PRECIPITATION_NAMES,
) -> DataFrame:
    """Missing days of raw precipitation rasters to the daily set.

    ``raw`` has ``source``, axis columns and the variable under one of the aliases;
    ``windows`` has ``source``, ``start_date``, ``end_date``.  Days without a valid
    value are not written.  Returns the outcome of every wanted day.
    """
    spark = raw.sparkSession
    wanted = calendar.day_spine(windows)
    before = _freeze(daily_days(spark, daily_path, wanted), f"{work_path}/before")
    todo = filters.skip_existing(wanted, before)
    shaped = conform.standardize_dims(raw)
    if "value" not in shaped.columns:
        shaped = conform.pick_value(shaped, aliases[0], aliases[1:], fuzzy=False)
    order = _times(shaped)
    cells = append.restrict_dates(conform.conform_cells(shaped, grid, keep=order), todo)
    cells = _one_per_day(filters.clip_box(cells, box, grid), order)
    valid = raster.validate_granules(cells.withColumn("crs", F.lit(CRS))).filter("status = 'ok'")
    store.write_daily(append.restrict_dates(cells, valid), daily_path)
    after = daily_days(spark, daily_path, wanted)
    if index_path:
        folder = F.regexp_extract("_metadata.file_path", "^(.*)/", 1).alias("location")
        located = store.scan_daily(spark, daily_path).select("source", "date", folder)
        if store.exists(spark, index_path):
            # Days of this run only: the folders of other days are not opened.
            located = append.restrict_dates(located, append.new_rows(before, after)).distinct()
            index.extend_mosaic_index(index.folder_index(located, box), index_path)
        else:
            index.write_mosaic_index(index.folder_index(located.distinct(), box), index_path)
    return run_outcomes(wanted, before, after)


def ingest_temperature(
    raw: DataFrame,
    windows: DataFrame,
    variable: str,
    grid: Grid,
    box: BBox,
    daily_path: str,
    archive_path: str,
    work_path: str,
    batch_days: int = ERA5_BATCH_DAYS,
) -> DataFrame:
    """Missing days of a reanalysis variable to the daily set and the archive.

    Temperatures arrive in Kelvin.  The daily set is clipped to cells that touch the
    box, the archive to cells whose centre is inside.  Returns each missing day with
    the batch it was fetched in and its outcome in both targets.
    """
    spark = raw.sparkSession
    wanted = _freeze(calendar.day_spine(windows), f"{work_path}/wanted")
    years = lookup.by_year(windows)
    daily_before = _freeze(daily_days(spark, daily_path, wanted), f"{work_path}/daily")
    archive_before = _freeze(archive_days(spark, archive_path, years), f"{work_path}/archive")
    missing = calendar.missing_dates(wanted, daily_before, archive_before)
    missing = _freeze(calendar.with_batch(missing, batch_days), f"{work_path}/missing")

    shaped = conform.standardize_dims(raw)
    column = names.resolve_variable(shaped.columns, variable, TEMPERATURE_NAMES)
    label = F.concat(F.lit(variable), F.lit(" "), F.lit(column))
    shaped = shaped.withColumn("value", values.kelvin_to_celsius(column, label))
    order = _times(shaped)
    cells = conform.conform_cells(shaped, grid, keep=order)

    # The raster is read and reduced once: both targets take their days from the result.
    new = append.restrict_dates(cells, missing)
    once = f"{work_path}/cells"
    new = _freeze(_one_per_day(filters.clip_box(new, box, grid), order), once)
    store.write_daily(append.restrict_dates(new, missing.filter("missing_granule")), daily_path)
    boxed = filters.select_box(append.restrict_dates(new, missing.filter("missing_archive")), box)
    # The calendar of the gaps is small: counting it sizes the files.
    gaps = missing.filter("missing_archive").select("date").distinct().count()
    store.write_archive(append.new_rows(archive_before, boxed), archive_path, days=gaps)
    store.remove(spark, once)

    keys = ["source", "date"]
    daily = run_outcomes(wanted, daily_before, daily_days(spark, daily_path, wanted))
    kept = archive_days(spark, archive_path, years)
    archived = run_outcomes(wanted, archive_before, kept)
    return (
        missing.select(*keys, "batch_start")
        .join(daily.withColumnRenamed("status", "daily_status"), keys)
        .join(archived.withColumnRenamed("status", "archive_status"), keys)
    )


def build_year_archive(
    raw: DataFrame, grid: Grid, box: BBox, path: str, rename=None, drop=("prmsl",)
) -> None:
    """Raw cells of any years to the archive: names unified, all-missing days dropped,
    cropped to the box.  A second run replaces the days it brings, and no others."""
    shaped = conform.rename_drop(conform.standardize_dims(raw), rename or {}, drop)
    if "value" not in shaped.columns:
        shaped = shaped.withColumnRenamed("precip", "value")
    order = _times(shaped)
    cells = filters.drop_empty_days(conform.conform_cells(shaped, grid, keep=order))
    boxed = _one_per_day(filters.select_box(cells, box), order)
    store.replace_days(boxed, path)
