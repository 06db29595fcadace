"""Any input to the canonical cell table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terracell.functions import geo, names, values
from terracell.functions.dates import as_date
from terracell.schema import CRS, Grid


def standardize_dims(df: DataFrame) -> DataFrame:
    """Axis columns in any accepted spelling to ``lat``, ``lon``, ``time``.

    Of several time columns the first accepted name wins.
    """
    renames = {}
    for c in df.columns:
        if c.lower() in names.LON_NAMES:
            renames[c] = "lon"
        elif c.lower() in names.LAT_NAMES:
            renames[c] = "lat"
    for c in names.TIME_NAMES:
        if c in df.columns:
            renames[c] = "time"
            break
    return df.withColumnsRenamed(renames)


def rename_drop(df: DataFrame, rename: dict[str, str], drop=(), keep=None) -> DataFrame:
    """Renames and drops the columns that are there; ``keep`` ends with a projection."""
    df = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
    df = df.drop(*drop)
    return df.select(*keep) if keep else df


def pick_value(df: DataFrame, variable: str, aliases=(), fuzzy: bool = True) -> DataFrame:
    """Names the column that holds ``variable`` ``value``."""
    return df.withColumnRenamed(
        names.resolve_variable(df.columns, variable, aliases, fuzzy), "value"
    )


def add_time(df: DataFrame, day) -> DataFrame:
    return df.withColumn("date", as_date(day))


def conform_cells(df: DataFrame, grid: Grid, source=None, keep=()) -> DataFrame:
    """``lat, lon, value`` and ``date`` or ``time`` to cells: 32-bit value without
    NaN, row and column on the grid, tile and year, and other columns to ``keep``.

    Latitude and longitude become those of the cell, so a cell has one place however
    its input was written.  Rows off the grid, or without a place, drop out.
    """
    if "date" not in df.columns:
        df = df.withColumn("date", F.col("time").cast("date"))
    if source is not None:
        df = df.withColumn("source", F.lit(source))
    df = df.withColumns(
        {
            "lon": geo.normalize_lon("lon"),
            "value": values.missing_if_nan(values.cast_value("value")),
        }
    )
    df = df.withColumns({"row": geo.row_of("lat", grid), "col": geo.col_of("lon", grid)})
    inside = F.col("row").between(0, grid.n_rows - 1) & F.col("col").between(0, grid.n_cols - 1)
    placed = df.filter(inside).withColumns(
        {"lat": geo.lat_of("row", grid), "lon": geo.lon_of("col", grid)}
    )
    return with_keys(placed, grid).select(
        "source", "year", "tile_id", "date", "row", "col", "lat", "lon", "value", *keep
    )


def with_keys(cells: DataFrame, grid: Grid) -> DataFrame:
    """Adds the partition column ``year`` and the clustering key ``tile_id``."""
    return cells.withColumns(
        {"year": F.year("date"), "tile_id": geo.tile_id("row", "col", grid)}
    )


def north_up(cells: DataFrame, grid: Grid) -> DataFrame:
    """Rows renumbered from the north edge."""
    if grid.dlat < 0:
        return cells
    return cells.withColumn("row", F.lit(grid.n_rows - 1) - F.col("row"))


def tag_attrs(df: DataFrame, column: str = "value", **attrs) -> DataFrame:
    """Units, long name, source, statistic and CRS as column metadata."""
    return df.withMetadata(column, {"crs": CRS, **attrs})
