"""Answers built from cells: counts, lists, maps, sums, extents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terracell.functions import values


def exceedance_counts(series: DataFrame, keys=("site_id",), trigger="trigger") -> DataFrame:
    """``n_exceedances`` for each key, zero where no value is above the trigger."""
    over = values.exceeds("value", F.col(trigger) if isinstance(trigger, str) else trigger)
    return series.groupBy(*keys).agg(F.count_if(over).alias("n_exceedances"))


def exceedance_list(exceeding: DataFrame, keys=("site_id",)) -> DataFrame:
    """Days and rounded values of each site, in order of the days.

    A day counts once, with its largest value: copies of a cell are folded before
    the lists are built, so a list is no longer than the calendar.
    """
    days = exceeding.groupBy(*keys, "date").agg(F.max("value").alias("value"))
    entry = F.struct("date", values.round2("value").alias("value"))
    return days.groupBy(*keys).agg(
        F.count("*").alias("n_exceedances"),
        F.array_sort(F.collect_list(entry)).alias("exceedances"),
    )


POINT = ("date", "tile_id", "latitude", "longitude", "precipitation_mm")


def rounded_points(cells: DataFrame) -> DataFrame:
    """Cells with the rounded columns of an area answer beside their own."""
    return cells.withColumns(
        {
            "latitude": values.round5("lat"),
            "longitude": values.round5("lon"),
            "precipitation_mm": values.round2("value"),
        }
    )


def exceedance_points(exceeding: DataFrame, *keep) -> DataFrame:
    """Flat answer of an area request: one rounded row per day and cell."""
    return rounded_points(exceeding).select(*keep, *POINT)


def exceedances_by_date(points: DataFrame, keys=("request_id",)) -> DataFrame:
    """Points of each day as a list, one part for each tile.

    A day of a wide area has as many points as the area has cells.  The tile keeps
    every list at a tile's size (400 cells) however wide the area and however hot the
    day; a day's answer is its parts, and nothing is left out.  Copies of a cell are
    folded first, to the largest value.
    """
    place = [*keys, "date", "tile_id", "latitude", "longitude"]
    points = points.groupBy(*place).agg(F.max("precipitation_mm").alias("precipitation_mm"))
    entry = F.struct("latitude", "longitude", "precipitation_mm")
    return points.groupBy(*keys, "date", "tile_id").agg(
        F.array_sort(F.collect_list(entry)).alias("points")
    )


def exceedance_totals(points: DataFrame, keys=("request_id",)) -> DataFrame:
    """Points and days above the trigger.  Each 64 days of a key are counted and marked in
    one number first, then added up, so what is moved are two numbers for 64 days, and no
    key gathers all of its points in one task."""
    keys = list(keys)
    day = F.unix_date("date")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), day.bitwiseAND(63))
    marked = points.groupBy(*keys, F.shiftright(day, 6).alias("_days")).agg(
        F.count("*").alias("n"), F.bit_or(bit).alias("days")
    )
    n_days = F.coalesce(F.bit_count("days"), F.lit(1))  # no day at all counts as one
    return marked.groupBy(*keys).agg(
        F.sum("n").alias("total_exceedances"), F.sum(n_days).alias("total_trigger_dates")
    )


def place_totals(cells: DataFrame, keys=("tile_id", "row", "col", "lat", "lon")) -> DataFrame:
    """Cells, values and their sum at each place, so that a site meets places, not days."""
    return cells.groupBy(*keys).agg(
        F.count("*").alias("n_cells"),
        F.count("value").alias("n_values"),
        F.sum(F.col("value").cast("double")).alias("total"),
    )


def site_totals(places: DataFrame, keys=("site_id",)) -> DataFrame:
    """``place_totals`` of the places of each site, added up."""
    return places.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_cells", "n_values", "total")])


def accumulate(cells: DataFrame, keys=("lat", "lon")) -> DataFrame:
    """Sum over time for each cell; a cell with no value at all sums to 0."""
    total = F.coalesce(F.sum(F.col("value").cast("double")), F.lit(0.0))
    return cells.groupBy(*keys).agg(total.alias("total"))


def extent(cells: DataFrame, keys=()) -> DataFrame:
    return cells.groupBy(*keys).agg(
        F.min("lat").alias("lat_min"),
        F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"),
        F.max("lon").alias("lon_max"),
    )


def time_extent(cells: DataFrame, keys=("source",)) -> DataFrame:
    """First day, last day and number of days.  Days are made distinct first: one
    partial aggregation over the cells, then at most a calendar."""
    days = cells.select(*keys, "date").distinct()
    return days.groupBy(*keys).agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count("*").alias("n_days"),
    )


def history_map(series: DataFrame, keys=("site_id",)) -> DataFrame:
    """Day to rounded value for each site.  Expects one row per key and day (see
    ``append.last_per_day``), so a map is no longer than the calendar."""
    entry = F.struct(F.date_format("date", "yyyy-MM-dd"), values.round2("value"))
    return series.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("history")
    )


def files_per_dataset(granules: DataFrame) -> DataFrame:
    """Granules of each dataset; a dataset without any has no row."""
    return granules.groupBy("source").agg(F.count("*").alias("n_files"))


def run_summary(outcomes: DataFrame, keys=()) -> DataFrame:
    """Created, skipped and failed items from a ``status`` column."""
    return outcomes.groupBy(*keys).agg(
        F.count_if(F.col("status") == "created").alias("created"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def time_list(cells: DataFrame, keys=("source",)) -> DataFrame:
    """Ordered distinct days of each layer; at most a calendar."""
    days = cells.select(*keys, "date").distinct()
    return days.groupBy(*keys).agg(F.array_sort(F.collect_list("date")).alias("days"))
