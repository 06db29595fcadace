"""Structured Streaming jobs on files of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from terracell.operators import append, filters, lookup
from terracell.functions import values
from terracell.plans.ingest import archive_or_empty
from terracell.schema import CELL_SCHEMA, Grid
from terracell.sources.archive import write_archive


def cell_stream(
    spark: SparkSession, path: str, schema=CELL_SCHEMA, glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_append(
    cells: DataFrame, archive_path: str, checkpoint: str, order=()
) -> StreamingQuery:
    """Appends arriving cells to the archive, each day and cell once.

    ``cells`` has the archive columns (``operators.conform``).  A batch that is run
    again after a crash finds its cells in the archive and adds only the rest; a day
    that arrives in several batches is completed.
    """

    def add(batch: DataFrame, _batch_id: int) -> None:
        # Span, days and rows come from one read of the batch's files.
        batch = batch.persist()
        try:
            merge(batch)
        finally:
            batch.unpersist()

    def merge(batch: DataFrame) -> None:
        spark = batch.sparkSession
        # Two dates prune the archive's partitions and row groups; the days in between
        # that the batch does not have drop out in the scan stage.
        span = batch.agg(
            F.min("date").alias("first"),
            F.max("date").alias("last"),
            F.count_distinct("date").alias("days"),
        ).first()
        if span["first"] is None:
            return
        archive = archive_or_empty(spark, archive_path)
        existing = filters.time_range(archive, span["first"], span["last"])
        existing = append.restrict_dates(existing, batch.select("source", "date"))
        # A cell's place follows from its key, so it groups along with it.
        place = ("year", "tile_id", "lat", "lon")
        fresh = batch.select(*append.CELL, *place, *order, "value")
        fresh = append.last_per_day(fresh, (*append.CELL, *place), order)
        write_archive(
            append.new_rows(existing, fresh, append.CELL), archive_path, days=span["days"]
        )

    return (
        cells.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_exceedances(
    cells: DataFrame, sites: DataFrame, grid: Grid, out_path: str, checkpoint: str
) -> StreamingQuery:
    """Arriving cells above the ``trigger`` of a site on them, as Parquet rows."""
    hits = lookup.point_lookup(cells, sites, grid)
    over = hits.filter(values.exceeds("value", F.col("trigger")))
    return (
        over.select("site_id", "source", "date", "row", "col", "value", "trigger")
        .writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
