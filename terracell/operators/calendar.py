"""Which days are wanted, present and missing, and how to batch them.

Everything here has one row per source and day at most: the calendar bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from terracell.functions.dates import date_parts, days_between, parse_day


def distinct_dates(df: DataFrame, time: str = "date", keys=("source",)) -> DataFrame:
    """Distinct days of an archive or a batch, from a date or a timestamp column."""
    return df.select(*keys, F.col(time).cast("date").alias("date")).distinct()


def day_spine(windows: DataFrame) -> DataFrame:
    """Every day of each row's ``start_date``..``end_date``; none if inverted."""
    days = days_between(F.col("start_date"), F.col("end_date"))
    return windows.withColumn("date", F.explode(days)).drop("start_date", "end_date")


def missing_dates(wanted: DataFrame, granules: DataFrame, archive: DataFrame) -> DataFrame:
    """Wanted days that lack a granule, an archive entry or both, with a flag for each.

    All three have ``source`` and ``date``.
    """
    keys = ["source", "date"]
    have_granule = granules.select(*keys).distinct().withColumn("g", F.lit(True))
    have_archive = archive.select(*keys).distinct().withColumn("a", F.lit(True))
    return (
        wanted.select(*keys)
        .distinct()
        .join(have_granule, keys, "left")
        .join(have_archive, keys, "left")
        .filter(F.col("g").isNull() | F.col("a").isNull())
        .select(
            *keys,
            F.col("g").isNull().alias("missing_granule"),
            F.col("a").isNull().alias("missing_archive"),
        )
    )


def date_islands(days: DataFrame, keys=("source",)) -> DataFrame:
    """Contiguous runs of days for each key: ``start_date``, ``end_date``, ``n_days``."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy("date")
    run = F.date_sub("date", F.row_number().over(order))
    return (
        days.select(*keys, "date")
        .distinct()
        .withColumn("_run", run)
        .groupBy(*keys, "_run")
        .agg(
            F.min("date").alias("start_date"),
            F.max("date").alias("end_date"),
            F.count("*").alias("n_days"),
        )
        .drop("_run")
    )


def chunk_islands(islands: DataFrame, batch_days: int) -> DataFrame:
    """Splits each run into batches of ``batch_days``; the last may be shorter."""
    if batch_days < 1:
        raise ValueError("batch_days must be at least 1")
    step = F.make_interval(days=F.lit(batch_days))
    starts = F.explode(F.sequence(F.col("start_date"), F.col("end_date"), step))
    return (
        islands.drop("n_days")
        .withColumn("_start", starts)
        .withColumn("end_date", F.least(F.date_add("_start", batch_days - 1), "end_date"))
        .withColumn("start_date", F.col("_start"))
        .drop("_start")
        .withColumn("n_days", F.datediff("end_date", "start_date") + 1)
    )


def date_batches(days: DataFrame, batch_days: int, keys=("source",)) -> DataFrame:
    return chunk_islands(date_islands(days, keys), batch_days)


def with_batch(days: DataFrame, batch_days: int, keys=("source",)) -> DataFrame:
    """Days with the first day of the batch they belong to (``batch_start``)."""
    batches = date_batches(days, batch_days, keys).withColumnRenamed("start_date", "batch_start")
    spine = batches.withColumn("date", F.explode(days_between(F.col("batch_start"), F.col("end_date"))))
    return days.join(spine.select(*keys, "date", "batch_start"), [*keys, "date"])


def request_footprint(batches: DataFrame) -> DataFrame:
    """Days a server sees when a batch asks for lists of years, months and days.

    The lists are built and multiplied out inside each row; impossible days drop out.
    ``wanted`` is false for days fetched in excess.
    """
    parts = date_parts(days_between(F.col("start_date"), F.col("end_date")))
    spelled = batches.withColumn("_p", parts)
    for name in ("years", "months", "days"):
        spelled = spelled.withColumn(f"_{name}", F.explode(F.col(f"_p.{name}")))
    text = F.concat("_years", "_months", "_days")
    day = parse_day(text, "yyyyMMdd")
    return (
        spelled.withColumn("date", day)
        .filter(F.col("date").isNotNull())
        .withColumn("wanted", F.col("date").between(F.col("start_date"), F.col("end_date")))
        .drop("_p", "_years", "_months", "_days")
    )
