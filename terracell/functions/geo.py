"""Coordinates, boxes, distances, pixels and tiles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terracell.schema import EARTH_RADIUS_KM, KM_PER_DEGREE, BBox, Grid

EDGES = ("west", "south", "east", "north")
# The edge orders in use, by name.
EDGE_ORDERS = {
    "wsen": ("west", "south", "east", "north"),
    "swne": ("south", "west", "north", "east"),
    "nwse": ("north", "west", "south", "east"),
}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def normalize_lon(lon) -> Column:
    """0..360 longitudes to -180..180 (180 becomes -180)."""
    return F.pmod(_col(lon) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    half = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(
        F.sin((lon2 - lon1) / 2), 2
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(half))


def radius_bbox(lat, lon, radius_km) -> Column:
    """The box of an area request: the same half-width in degrees on both axes."""
    lat, lon, half = _col(lat), _col(lon), _col(radius_km) / F.lit(KM_PER_DEGREE)
    return F.struct(
        (lon - half).alias("west"),
        (lat - half).alias("south"),
        (lon + half).alias("east"),
        (lat + half).alias("north"),
    )


def in_box(lat, lon, box: Column) -> Column:
    return _col(lat).between(box["south"], box["north"]) & _col(lon).between(
        box["west"], box["east"]
    )


def within_radius(lat, lon, centre_lat, centre_lon, radius_km) -> Column:
    """Inside the box **and** the circle, both inclusive; the box cuts the circle.

    The box comes first, so the trigonometry runs for its cells only.
    """
    box = radius_bbox(centre_lat, centre_lon, radius_km)
    near = haversine_km(centre_lat, centre_lon, lat, lon) <= _col(radius_km)
    return in_box(lat, lon, box) & near


def lonlat_to_pixel(lat, lon, width, height, box: BBox) -> tuple[Column, Column]:
    """Pixel x, y of a point in a north-up view; truncated toward zero."""
    x = (_col(lon) - F.lit(box.west)) / F.lit(box.east - box.west) * _col(width)
    y = (F.lit(box.north) - _col(lat)) / F.lit(box.north - box.south) * _col(height)
    return x.cast("int"), y.cast("int")


def bbox_reorder(edges, order: str) -> Column:
    """Four-number array in a named edge order to a box struct."""
    names = EDGE_ORDERS[order]
    edges = _col(edges)
    return F.struct(*[edges[names.index(e)].alias(e) for e in EDGES])


def bbox_status(box) -> Column:
    box = _col(box)
    missing = box["west"].isNull() | box["south"].isNull()
    missing = missing | box["east"].isNull() | box["north"].isNull()
    bad = missing | (box["north"] <= box["south"]) | (box["west"] >= box["east"])
    return F.when(bad, "bad_bbox").otherwise("ok")


def shared_box(a, b) -> Column:
    """Shared rectangle of two boxes that do share some area."""
    a, b = _col(a), _col(b)
    return F.struct(
        F.greatest(a["west"], b["west"]).alias("west"),
        F.greatest(a["south"], b["south"]).alias("south"),
        F.least(a["east"], b["east"]).alias("east"),
        F.least(a["north"], b["north"]).alias("north"),
    )


def rect_intersection(a, b) -> Column:
    """Shared rectangle of two boxes; NULL when they share no area."""
    box = shared_box(a, b)
    return F.when((box["west"] < box["east"]) & (box["south"] < box["north"]), box)


def box_literal(box: BBox) -> Column:
    return F.struct(*[F.lit(float(getattr(box, e))).alias(e) for e in EDGES])


def row_of(lat, grid: Grid) -> Column:
    """Index of the row whose centre is at ``lat``."""
    return F.round((_col(lat) - F.lit(grid.lat0)) / F.lit(grid.dlat)).cast("int")


def col_of(lon, grid: Grid) -> Column:
    return F.round((_col(lon) - F.lit(grid.lon0)) / F.lit(grid.dlon)).cast("int")


def lat_of(row, grid: Grid) -> Column:
    return F.lit(float(grid.lat0)) + F.lit(float(grid.dlat)) * _col(row)


def lon_of(col, grid: Grid) -> Column:
    return F.lit(float(grid.lon0)) + F.lit(float(grid.dlon)) * _col(col)


def nearest_row(lat, grid: Grid) -> Column:
    return _nearest(_col(lat), grid.lat0, grid.dlat, grid.n_rows)


def nearest_col(lon, grid: Grid) -> Column:
    return _nearest(_col(lon), grid.lon0, grid.dlon, grid.n_cols)


def _nearest(x: Column, start: float, step: float, n: int) -> Column:
    pos = (x - F.lit(float(start))) / F.lit(float(step))
    # Half-way points take the larger coordinate, whichever way the axis runs.
    idx = F.floor(pos + 0.5) if step > 0 else F.ceil(pos - 0.5)
    return F.least(F.greatest(idx, F.lit(0)), F.lit(n - 1)).cast("int")


def tile_id(row, col, grid: Grid) -> Column:
    size = F.lit(grid.tile)
    r = F.floor(_col(row) / size)
    c = F.floor(_col(col) / size)
    return (r * F.lit(grid.tiles_per_row) + c).cast("int")
