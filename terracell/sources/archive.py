"""The historical archive and the daily raster set, as Parquet.

Archive: ``source=/year=`` partitions, rows sorted by tile and day inside each file,
so a site is a contiguous run and row-group statistics skip the other tiles.
Daily set: ``source=/date=`` partitions, replaced a day at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from terracell.operators.sides import per_day_side
from terracell.schema import ARCHIVE_SCHEMA, DAILY_SCHEMA, TILE_SIZE
from terracell.sources.tiledays import refresh_tile_days

# A file holds neighbouring tiles of one partition, about so many rows of them, however
# many sources, years and tiles there are.
ROWS_PER_FILE = 6_000_000
DAYS_OF_YEAR = 366
# What requests with a source and a period are joined to cells on.
REQUEST_KEYS = ("source", "year", "tile_id")


def scan_archive(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """All files of the archive as one table, of one source or of all."""
    cells = spark.read.schema(ARCHIVE_SCHEMA).parquet(path)
    return cells.filter(F.col("source") == source) if source else cells


def scan_variable(spark: SparkSession, path: str, variable: str) -> DataFrame | None:
    """One variable of a table with a column per variable; None if it has no such."""
    table = spark.read.parquet(path)
    if variable not in table.columns:
        return None
    axes = [c for c in ("source", "date", "row", "col", "lat", "lon") if c in table.columns]
    return table.select(*axes, F.col(variable).alias("value"))


def _clustered(cells: DataFrame, days: int, *partition: str) -> DataFrame:
    """Rows of a partition spread over tasks by band of tiles, then sorted.

    Hashing on the band as well keeps a source or a day that holds much of the data
    from landing in one task; ``days`` is how many days of a partition are written,
    so that a band of few days is wide enough to fill a file.
    """
    tiles = max(1, ROWS_PER_FILE // (TILE_SIZE**2 * min(max(days, 1), DAYS_OF_YEAR)))
    # The writer keeps this order only if it begins with the partition columns as they
    # are written.  A source that is NULLable or a constant is rewritten by the
    # optimizer and the writer would sort anew; one that comes out of a generator is not.
    plain = F.explode(F.array(F.coalesce("source", F.lit("unknown"))))
    cells = cells.withColumn("source", plain)
    band = F.floor(F.col("tile_id") / F.lit(tiles))
    return cells.repartition(*[F.col(p) for p in partition], band).sortWithinPartitions(
        *partition, "tile_id", "date", "row", "col"
    )


def write_archive(
    cells: DataFrame, path: str, mode: str = "append", days: int = DAYS_OF_YEAR, summarise: bool = False
) -> None:
    """Adds rows to the archive, of ``days`` days a year at most.  Callers drop days
    that are there already (``operators.append.new_rows``); with mode ``overwrite`` the
    rows replace the years of the sources that they name, and leave the others
    (``replace_days`` replaces days).  ``summarise`` also brings the extrema of tiles
    and days up to date (``sources.tiledays``)."""
    rows = cells.select(*[F.col(f.name).cast(f.dataType) for f in ARCHIVE_SCHEMA])
    writer = _clustered(rows, days, "source", "year").write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("source", "year").parquet(path)
    if summarise:
        refresh_tile_days(cells.sparkSession, path)


def replace_days(cells: DataFrame, path: str, summarise: bool = False) -> None:
    """Days of the archive replaced, or added, as a whole; all other days stay.

    A year that keeps none of its days is simply written.  In other years the days that
    stay and the new ones are first written whole beside the archive, and only then take
    the place of the year, so a crash loses nothing: the copy is complete before the
    year is touched, and ``recover_days`` (also called first here) puts it in place.
    """
    spark = cells.sparkSession
    recover_days(spark, path)
    if not exists(spark, path):
        write_archive(cells, path, mode="overwrite", summarise=summarise)
        return
    new = _staging(path)
    typed = cells.select(*[F.col(f.name).cast(f.dataType) for f in ARCHIVE_SCHEMA])
    typed.write.partitionBy("source", "year").parquet(f"{new}/new")
    fresh = spark.read.schema(ARCHIVE_SCHEMA).parquet(f"{new}/new")
    days = fresh.select("source", "year", "date").distinct()  # the calendar bounds it
    years = days.select("source", "year").distinct()
    stay = scan_archive(spark, path).join(per_day_side(years), ["source", "year"], "left_semi")
    stay = stay.join(per_day_side(days), ["source", "year", "date"], "left_anti")
    mixed = stay.select("source", "year").distinct()
    if not mixed.isEmpty():
        kept = fresh.join(per_day_side(mixed), ["source", "year"], "left_semi")
        both = stay.select(*ARCHIVE_SCHEMA.names).unionByName(kept.select(*ARCHIVE_SCHEMA.names))
        both.write.partitionBy("source", "year").parquet(f"{new}/years")
    _put_in_place(spark, new, path)
    if summarise:
        refresh_tile_days(spark, path)


def _put_in_place(spark: SparkSession, folder: str, path: str) -> None:
    """Years that were copied whole, then the years that keep nothing; may be repeated."""
    fresh = spark.read.schema(ARCHIVE_SCHEMA).parquet(f"{folder}/new")
    if exists(spark, f"{folder}/years/_SUCCESS"):
        whole = spark.read.schema(ARCHIVE_SCHEMA).parquet(f"{folder}/years")
        write_archive(whole, path, mode="overwrite")
        done = per_day_side(whole.select("source", "year").distinct())
        fresh = fresh.join(done, ["source", "year"], "left_anti")
    write_archive(fresh, path, mode="overwrite")
    remove(spark, folder)


def recover_days(spark: SparkSession, path: str) -> None:
    """Finishes replacements that died after their years were copied whole; other copies
    are removed, as the archive is still as it was before them."""
    for folder in _listed(spark, path):
        if folder.rpartition("/")[2].startswith(_STAGING):
            if exists(spark, f"{folder}/years/_SUCCESS"):
                _put_in_place(spark, folder, path)
            else:
                remove(spark, folder)


_STAGING = "_replace-"


def _staging(path: str) -> str:
    return f"{path.rstrip('/')}/{_STAGING}{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _file_system(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, place = _file_system(spark, path)
    return [str(s.getPath().toString()) for s in fs.listStatus(place)] if fs.exists(place) else []


def write_archive_table(
    cells: DataFrame, table: str, buckets: int, mode: str = "overwrite", keys=("tile_id",), path: str | None = None
) -> None:
    """The archive as a catalog table bucketed by ``keys``: joins on them read it in place.

    With the keys ``REQUEST_KEYS`` a table of area or point requests is moved to the
    cells, which are neither shuffled nor, one file a bucket, sorted again.  A bucket
    holds tiles of all years and sources, so a source with much of the data is spread
    over all of them.  ``path`` places the files; the catalog's warehouse has them else.
    """
    keys = list(keys)
    rows = cells.select(*[F.col(f.name).cast(f.dataType) for f in ARCHIVE_SCHEMA])
    order = [*keys, *[c for c in ("tile_id", "date") if c not in keys]]
    writer = rows.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*order)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def write_daily(cells: DataFrame, path: str) -> None:
    """One partition per source and day.  Writing a day again replaces that day and
    leaves the others alone, so a repeated run is harmless."""
    rows = cells.select(*[F.col(f.name).cast(f.dataType) for f in DAILY_SCHEMA])
    (
        _clustered(rows, 1, "source", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source", "date")
        .parquet(path)
    )


def scan_daily(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DAILY_SCHEMA).parquet(path)
