"""Decoded raster tiles to cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terracell.functions import geo, values
from terracell.operators.conform import with_keys
from terracell.schema import TILE_SCHEMA, Grid


def tiles_to_cells(tiles: DataFrame, grid: Grid) -> DataFrame:
    """Tile rows (row-major ``values`` of a block) to canonical cells."""
    cells = tiles.select("*", F.posexplode("values").alias("_i", "_v")).withColumns(
        {
            "row": (F.col("first_row") + F.floor(F.col("_i") / F.col("width"))).cast("int"),
            "col": (F.col("first_col") + F.col("_i") % F.col("width")).cast("int"),
            "value": values.missing_if_nan(values.cast_value("_v")),
        }
    )
    cells = cells.withColumns({"lat": geo.lat_of("row", grid), "lon": geo.lon_of("col", grid)})
    return with_keys(cells, grid).select(
        "source", "year", "tile_id", "date", "row", "col", "lat", "lon", "value"
    )


def decode_tiles(files: DataFrame, decoder, schema=TILE_SCHEMA) -> DataFrame:
    """Raw raster files to tiles with a decoder of the user's: a function from an
    iterator of Arrow batches (``path``, ``content``) to batches of tiles.  Files are
    decoded where they are read; no codec is bundled."""
    return files.mapInArrow(decoder, schema)
