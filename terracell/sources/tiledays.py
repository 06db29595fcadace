"""Smallest and largest value of each tile and day of an archive.

The table lies in ``_tiles`` beside the partitions of the archive, where a scan of the
archive does not see it, and has rows for each of its files.  Files it does not know yet
(a write that died before its summary, another writer) are summed up when it is read, and
rows of files that are gone are left out, so what it says is always true of the archive.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terracell.functions import values
from terracell.schema import ARCHIVE_SCHEMA

KEYS = ("source", "year", "tile_id", "date")
_SCHEMA = "file string, tile_id int, date date, low float, high float, n_values long, n_cells long, source string, year int"
_FILE = ["source", "year", "file"]


def summary_path(archive_path: str) -> str:
    return f"{archive_path.rstrip('/')}/_tiles"


def tile_days(cells: DataFrame, *more: str) -> DataFrame:
    """Extrema and counts of each tile and day.  Missing values count as cells only."""
    return cells.groupBy(*more, *KEYS).agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.count("value").alias("n_values"),
        F.count("*").alias("n_cells"),
    )


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, year, file, path) of the archive's files, from listing alone."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(F.col("source").cast("string"), F.col("year").cast("int"), name.alias("file"), "path")


def _held(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_SCHEMA).parquet(summary_path(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _of_files(spark: SparkSession, path: str, files: DataFrame) -> DataFrame | None:
    """The summary of some files; None without any.  Their names pass through the
    driver: they are what one write left, or all files when nothing is held."""
    names = [r.path for r in files.select("path").collect()]
    if not names:
        return None
    cells = spark.read.schema(ARCHIVE_SCHEMA).option("basePath", path).parquet(*names)
    return tile_days(cells.withColumn("file", F.col("_metadata.file_name")), "file")


def refresh_tile_days(spark: SparkSession, path: str) -> None:
    """Adds the files that the summary does not have.  It reads those files only, and
    running it again adds nothing."""
    held, files = _held(spark, path), archive_files(spark, path)
    fresh = files if held is None else files.join(held.select(*_FILE).distinct(), _FILE, "left_anti")
    rows = _of_files(spark, path, fresh)
    if rows is not None:
        (
            rows.repartition("source", "year")
            .sortWithinPartitions("source", "year", "tile_id", "date")
            .write.mode("append")
            .partitionBy("source", "year")
            .parquet(summary_path(path))
        )


def scan_tile_days(spark: SparkSession, path: str) -> DataFrame:
    """One row for each source, year, tile and day of the archive as it is now."""
    held, files = _held(spark, path), archive_files(spark, path)
    if held is None:
        return tile_days(spark.read.schema(ARCHIVE_SCHEMA).parquet(path))
    rows = held.join(files.select(*_FILE), _FILE, "left_semi").dropDuplicates([*_FILE, "tile_id", "date"])
    fresh = _of_files(spark, path, files.join(held.select(*_FILE).distinct(), _FILE, "left_anti"))
    if fresh is not None:
        rows = rows.unionByName(fresh)
    return rows.groupBy(*KEYS).agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("n_values").alias("n_values"),
        F.sum("n_cells").alias("n_cells"),
    )


def may_exceed(summary: DataFrame, trigger) -> DataFrame:
    """Tiles and days with a value above the trigger."""
    return summary.filter(values.exceeds("high", trigger))


def tile_spans(hot: DataFrame) -> Column:
    """A literal predicate that holds on all rows of the tiles and days of ``hot``.

    One range of tiles and days for each run of neighbouring tile numbers: files are
    sorted by tile and day, so row groups and pages outside are skipped.  The spans
    that are collected number at most the tiles of the grid.
    """
    spans = hot.groupBy("tile_id").agg(F.min("date").alias("first"), F.max("date").alias("last")).orderBy("tile_id")
    runs: list[list] = []
    for r in spans.collect():
        if runs and r.tile_id == runs[-1][1] + 1:
            runs[-1] = [runs[-1][0], r.tile_id, min(runs[-1][2], r.first), max(runs[-1][3], r.last)]
        else:
            runs.append([r.tile_id, r.tile_id, r.first, r.last])
    keep = F.lit(False)
    for low, high, first, last in runs:
        keep = keep | (F.col("tile_id").between(low, high) & F.col("date").between(first, last))
    return keep


def only_hot(cells: DataFrame, hot: DataFrame) -> DataFrame:
    """Cells on the tiles and days of ``hot``: literal spans for the scan, then the pairs."""
    return cells.filter(tile_spans(hot)).join(hot.select(*KEYS), list(KEYS), "left_semi")
