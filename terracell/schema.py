"""Canonical tables, grids, boxes and fixed settings."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

# Study area, source crops, sphere, tolerances, grid sizes.
STUDY_AREA = {"west": -75.0, "south": -35.0, "east": -33.5, "north": 6.5}
CHIRPS_CROP = {"west": -75.0, "south": -35.0, "east": -34.0, "north": 5.0}
MERGE_CROP = {
    "west": -74.97500610351562,
    "south": -34.974998474121094,
    "east": -34.02500915527344,
    "north": 4.974998474121094,
}
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.32
POINT_TOLERANCE_DEG = 0.05
TILE_SIZE = 20
CRS = "EPSG:4326"
NO_VALUE = -9999.0
VIEW_WIDTH = 12001
VIEW_HEIGHT = 1560
SENTINEL2_RESOLUTION = 0.0001
MODIS_RESOLUTION = 0.0025
MAX_SCENES = 50
MAX_CLOUD = 15.0
ERA5_BATCH_DAYS = 31
NDVI_BATCH_DAYS = 16
ERA5_LAG_DAYS = 7

PRECIPITATION_SOURCES = ("chirps", "merge")
TEMPERATURE_SOURCES = ("temp_max", "temp_min", "temp")
VEGETATION_SOURCES = ("sentinel2", "modis")
PRECIPITATION_NAMES = ("prec", "rdp", "pr")
TEMPERATURE_NAMES = ("t2m", "2t", "temperature_2m")


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
}


def _struct(**fields) -> T.StructType:
    """Nullable fields by type name (a DDL text would need a running session)."""
    return T.StructType([T.StructField(n, _TYPES.get(t, t)) for n, t in fields.items()])


BOX_SCHEMA = _struct(west="double", south="double", east="double", north="double")
# One row per source, day and grid cell.  ``value`` is NULL where the raster has
# no data; NaN never enters a table (``operators.conform.conform_cells``).
_AXES = dict(row="int", col="int", lat="double", lon="double", value="float")
CELL_SCHEMA = _struct(source="string", date="date", **_AXES)
# The archive adds its partition column and the clustering key.
ARCHIVE_SCHEMA = _struct(source="string", year="int", tile_id="int", date="date", **_AXES)
DAILY_SCHEMA = _struct(tile_id="int", source="string", date="date", **_AXES)
TILE_SCHEMA = _struct(
    source="string",
    date="date",
    first_row="int",
    first_col="int",
    width="int",
    values=T.ArrayType(T.FloatType()),
)
SITE_SCHEMA = _struct(site_id="string", lat="double", lon="double")
SCENE_SCHEMA = _struct(
    scene_id="string", ts=T.TimestampNTZType(), cloud_cover="double", bounds=BOX_SCHEMA
)
STYLE_SCHEMA = _struct(
    style="string", quantity="double", color="string", label="string", opacity="double"
)
_REQUEST = dict(
    source="string", lat="double", lon="double", start_date="string", end_date="string"
)
HISTORY_REQUEST = _struct(**_REQUEST)
TRIGGER_REQUEST = _struct(**_REQUEST, trigger="double")
AREA_REQUEST = _struct(**_REQUEST, trigger="double", radius="double")
PIXEL_REQUEST = _struct(
    source="string", date="string", lat="double", lon="double", width="int", height="int"
)


@dataclass(frozen=True)
class BBox:
    """A lon/lat rectangle.  Other edge orders come in by name only."""

    west: float
    south: float
    east: float
    north: float

    @classmethod
    def from_swne(cls, box):
        south, west, north, east = box
        return cls(west, south, east, north)

    @classmethod
    def from_nwse(cls, box):
        north, west, south, east = box
        return cls(west, south, east, north)

    def __post_init__(self):
        if self.north <= self.south:
            raise ValueError(f"north {self.north} must be above south {self.south}")
        if self.west >= self.east:
            raise ValueError(f"west {self.west} must be left of east {self.east}")


@dataclass(frozen=True)
class Grid:
    """Regular grid: centre of cell (0, 0), signed steps, size, tile edge in cells."""

    lat0: float
    lon0: float
    dlat: float
    dlon: float
    n_rows: int
    n_cols: int
    tile: int = TILE_SIZE

    @property
    def tiles_per_row(self) -> int:
        return -(-self.n_cols // self.tile)

    @property
    def bounds(self) -> BBox:
        """Outer edges of the grid (half a cell beyond the outermost centres)."""
        lats = (self.lat0, self.lat0 + self.dlat * (self.n_rows - 1))
        lons = (self.lon0, self.lon0 + self.dlon * (self.n_cols - 1))
        h, w = abs(self.dlat) / 2, abs(self.dlon) / 2
        return BBox(min(lons) - w, min(lats) - h, max(lons) + w, max(lats) + h)

    def index_range(self, axis: str, low: float, high: float) -> tuple[int, int]:
        """Smallest index range whose cells can have a centre in [low, high]."""
        start, step, n = (
            (self.lat0, self.dlat, self.n_rows)
            if axis == "lat"
            else (self.lon0, self.dlon, self.n_cols)
        )
        a, b = sorted(((low - start) / step, (high - start) / step))
        return max(math.floor(a), 0), min(math.ceil(b), n - 1)

    def nearest(self, lat: float, lon: float) -> tuple[int, int]:
        """Cell nearest to a point; half-way points take the larger coordinate."""

        def one(x, start, step, n):
            pos = (x - start) / step
            i = math.floor(pos + 0.5) if step > 0 else math.ceil(pos - 0.5)
            return min(max(i, 0), n - 1)

        return (
            one(lat, self.lat0, self.dlat, self.n_rows),
            one(lon, self.lon0, self.dlon, self.n_cols),
        )

    def tile_of(self, row: int, col: int) -> int:
        return (row // self.tile) * self.tiles_per_row + col // self.tile

    def tiles_in(self, rows: tuple[int, int], cols: tuple[int, int]) -> list[int]:
        return [
            r * self.tiles_per_row + c
            for r in range(rows[0] // self.tile, rows[1] // self.tile + 1)
            for c in range(cols[0] // self.tile, cols[1] // self.tile + 1)
        ]
