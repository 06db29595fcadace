"""Raster files by name: inventory, index, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terracell.functions.dates import date_from_name
from terracell.functions.geo import box_literal
from terracell.operators.sides import per_day_side
from terracell.schema import BBox


def list_files(
    spark: SparkSession, path: str, glob: str = "*.tif", nested: bool = False
) -> DataFrame:
    """Path, size and time of the files; their content is not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    reader = reader.option("recursiveFileLookup", str(nested).lower())
    return reader.load(path).select("path", "length", "modificationTime")


def granule_inventory(
    files: DataFrame, source=None, mode: str = "tail", path: str = "path"
) -> DataFrame:
    """Files with the day their name states; names without a real day drop out.

    The source is the name up to the day unless it is given.
    """
    name = F.element_at(F.split(F.col(path), "/"), -1)
    found = files.withColumn("date", date_from_name(name, mode))
    prefix = F.regexp_extract(name, r"^(.*?)_[^_]*[0-9]{8}", 1)
    label = prefix if source is None else source if isinstance(source, Column) else F.lit(source)
    return found.withColumn("source", label).filter(F.col("date").isNotNull())


def mosaic_index(
    granules: DataFrame, box: BBox, mode: str = "first", path: str = "path"
) -> DataFrame:
    """Location, day and footprint of every granule; a name without a day keeps a
    NULL day."""
    return granules.select(
        *[c for c in ("source",) if c in granules.columns],
        F.col(path).alias("location"),
        date_from_name(path, mode).alias("ingestion"),
        box_literal(box).alias("footprint"),
    )


def folder_index(folders: DataFrame, box: BBox) -> DataFrame:
    """The same index for ``source``, ``date`` and ``location`` of a daily set's folders."""
    day = F.col("date").alias("ingestion")
    return folders.select("source", "location", day, box_literal(box).alias("footprint"))


def write_mosaic_index(index: DataFrame, path: str) -> None:
    """Drops and rebuilds the index."""
    index.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def extend_mosaic_index(index: DataFrame, path: str) -> None:
    """Adds the locations that the index does not have; running it again adds nothing."""
    held = index.sparkSession.read.schema(index.schema).parquet(path).select("location")
    index.join(held, "location", "left_anti").write.mode("append").parquet(path)


def availability(days: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """Whether each day can be had, and from where; local copies come first."""
    keys = ["source", "date"]
    on = lambda df, name: per_day_side(df.select(*keys).distinct().withColumn(name, F.lit(True)))
    place = F.when(F.col("_local"), "local").when(F.col("_remote"), "remote").otherwise("none")
    return (
        days.join(on(local, "_local"), keys, "left")
        .join(on(remote, "_remote"), keys, "left")
        .withColumn("place", place)
        .withColumn("available", F.coalesce("_local", "_remote", F.lit(False)))
        .drop("_local", "_remote")
    )
