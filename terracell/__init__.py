"""Daily climate grids as Spark tables: ingest, query, compare and style raster cells."""

from terracell.schema import BBox, Grid

__all__ = ["BBox", "Grid"]
