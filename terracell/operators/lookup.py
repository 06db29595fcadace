"""Sites against cells: nearest cell, radius, irregular axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terracell.functions import geo
from terracell.operators.sides import spelled_side
from terracell.schema import KM_PER_DEGREE, POINT_TOLERANCE_DEG, Grid

REQUEST_COLUMNS = ("start_date", "end_date", "trigger", "radius")


def batch_sites(sites: DataFrame, **request) -> DataFrame:
    """Every site with the fields of one request, as constant columns."""
    return sites.withColumns({k: F.lit(v) for k, v in request.items()})


def snap_sites(
    sites: DataFrame, grid: Grid, tolerance: float = POINT_TOLERANCE_DEG
) -> DataFrame:
    """Adds the nearest cell (``row``, ``col``, ``tile_id``) and ``matched``: whether
    it lies within the tolerance on both axes."""
    snapped = sites.withColumns(
        {"row": geo.nearest_row("lat", grid), "col": geo.nearest_col("lon", grid)}
    )
    off_lat = F.abs(F.col("lat") - geo.lat_of("row", grid))
    off_lon = F.abs(F.col("lon") - geo.lon_of("col", grid))
    tol = F.lit(float(tolerance))
    return snapped.withColumns(
        {
            "tile_id": geo.tile_id("row", "col", grid),
            "matched": F.coalesce((off_lat <= tol) & (off_lon <= tol), F.lit(False)),
        }
    )


def by_year(requests: DataFrame) -> DataFrame:
    """One row for each year a request touches, so that ``year`` can be a join key
    and dynamic pruning skips the other years of the archive."""
    first, last = F.year("start_date"), F.year("end_date")
    return requests.filter(F.col("start_date") <= F.col("end_date")).withColumn(
        "year", F.explode(F.sequence(first, last))
    )


def _with_period(requests: DataFrame, cells: DataFrame) -> tuple[DataFrame, list[str]]:
    """Expands a request period to years where the cells are laid out by year."""
    if "year" in cells.columns and "start_date" in requests.columns:
        return by_year(requests), ["year"]
    return requests, []


def _in_period(joined: DataFrame) -> DataFrame:
    if "start_date" in joined.columns:
        return joined.filter(F.col("date").between(F.col("start_date"), F.col("end_date")))
    return joined


def point_lookup(
    cells: DataFrame, sites: DataFrame, grid: Grid, tolerance: float = POINT_TOLERANCE_DEG
) -> DataFrame:
    """Time series of each site's nearest cell.

    An equi-join on the cell; sites out of tolerance have no series.  Sites may carry
    ``source`` and a period (``start_date``, ``end_date``), which then bind too.
    """
    found = snap_sites(sites, grid, tolerance).filter("matched").drop("matched")
    found = found.withColumnsRenamed({"lat": "site_lat", "lon": "site_lon"})
    found, extra = _with_period(found, cells)
    keys = ["row", "col", *extra]
    keys += ["source"] if "source" in sites.columns else []
    if "tile_id" in cells.columns:
        keys.append("tile_id")
    else:
        found = found.drop("tile_id")
    return _in_period(cells.join(found, keys))


def point_lookup_irregular(
    cells: DataFrame, sites: DataFrame, tolerance: float = POINT_TOLERANCE_DEG
) -> DataFrame:
    """As ``point_lookup`` where the axes have no fixed step.

    Each axis is matched on buckets as wide as the tolerance: a value within the
    tolerance is in the site's bucket or next to it, so this is an equi-join, too.
    """
    sites = sites.withColumnsRenamed({"lat": "site_lat", "lon": "site_lon"})
    ids = sites.columns
    for axis in ("lat", "lon"):
        sites = _nearest_on_axis(sites, cells, axis, float(tolerance), ids)
        ids = sites.columns
    return cells.join(sites, ["lat", "lon"])


def _nearest_on_axis(sites, cells, axis, tol, ids):
    width = F.lit(tol if tol > 0 else 1e-9)
    bucket = lambda c: F.floor(c / width).cast("long")
    values = cells.select(axis).distinct().withColumn("bucket", bucket(F.col(axis)))
    near = F.array(*[bucket(F.col(f"site_{axis}")) + F.lit(k) for k in (-1, 0, 1)])
    pairs = sites.withColumn("bucket", F.explode(near)).join(values, "bucket")
    gap = F.abs(F.col(f"site_{axis}") - F.col(axis))
    # Nearest first; of two equally near the larger coordinate.
    best = F.min_by(F.col(axis), F.struct(gap, -F.col(axis)))
    return pairs.filter(gap <= F.lit(tol)).groupBy(*ids).agg(best.alias(axis))


def _wholly_inside(grid: Grid) -> Column:
    """Whether all cells of tile (_tr, _tc) are within the site's radius.

    On a rectangle of less than a hemisphere the farthest point is a corner, so the four
    corner cells decide; a hair is left for rounding.
    """
    size = grid.tile
    rows = [F.col("_tr") * size, F.least(F.col("_tr") * size + (size - 1), F.lit(grid.n_rows - 1))]
    cols = [F.col("_tc") * size, F.least(F.col("_tc") * size + (size - 1), F.lit(grid.n_cols - 1))]
    radius = F.col("radius") * (1 - 1e-9)
    inside = F.lit(True)
    for r in rows:
        for c in cols:
            inside = inside & geo.within_radius(geo.lat_of(r, grid), geo.lon_of(c, grid), "lat", "lon", radius)
    return F.coalesce(inside, F.lit(False))


def covering_tiles(sites: DataFrame, grid: Grid) -> DataFrame:
    """One row per site and tile that its radius box touches; ``all_in`` says that every
    cell of the tile is within the radius."""
    half = F.col("radius") / F.lit(KM_PER_DEGREE)

    def tiles(centre: str, start: float, step: float, n: int) -> Column:
        edges = [(F.col(centre) + s * half - F.lit(start)) / F.lit(step) for s in (-1, 1)]
        low = F.greatest(F.floor(F.least(*edges)), F.lit(0))
        high = F.least(F.ceil(F.greatest(*edges)), F.lit(n - 1))
        size = F.lit(grid.tile)
        span = F.sequence(F.floor(low / size), F.floor(high / size))
        return F.explode(F.when(low <= high, span))

    rows = sites.withColumn("_tr", tiles("lat", grid.lat0, grid.dlat, grid.n_rows))
    both = rows.withColumn("_tc", tiles("lon", grid.lon0, grid.dlon, grid.n_cols))
    tile = F.col("_tr") * F.lit(grid.tiles_per_row) + F.col("_tc")
    return both.withColumns({"tile_id": tile.cast("int"), "all_in": _wholly_inside(grid)}).drop("_tr", "_tc")


def place_series(cells: DataFrame, daily=("date", "value")) -> DataFrame:
    """One row for each place, with its days as the list ``days``; no longer than the
    calendar, of a year where the cells are laid out by year."""
    daily = [c for c in daily if c in cells.columns]
    place = [c for c in cells.columns if c not in daily]
    return cells.groupBy(*place).agg(F.collect_list(F.struct(*daily)).alias("days"))


def radius_join(cells: DataFrame, sites: DataFrame, grid: Grid, daily=("date", "value")) -> DataFrame:
    """Cells within each site's ``radius`` (km), as box and circle.

    The site is spelled out as the tiles it may touch, which makes the range join an
    equi-join on ``tile_id``; box and circle are then tested inside the join, on the
    tiles at the edge only: a tile wholly within the radius needs no distance.

    Places are joined, not days: cells with a ``date`` are folded to a row for each place
    first, and only the days of places within the radius are spelled out again.  ``daily``
    names the columns that differ between the days of a place.
    """
    near = covering_tiles(sites, grid).withColumnsRenamed(
        {"lat": "site_lat", "lon": "site_lon"}
    )
    near, extra = _with_period(near, cells)
    near = spelled_side(near)
    keys = ["tile_id", *extra] + (["source"] if "source" in sites.columns else [])
    if "tile_id" not in cells.columns:
        cells = cells.withColumn("tile_id", geo.tile_id("row", "col", grid))
    dated = "date" in cells.columns
    places = place_series(cells, daily) if dated else cells
    inside = geo.within_radius("lat", "lon", "site_lat", "site_lon", "radius")
    found = places.join(near, keys).filter(F.col("all_in") | inside).drop("all_in")
    if not dated:
        return found
    rest = [c for c in found.columns if c not in (*cells.columns, "days")]
    spelled = found.select(*[c for c in found.columns if c != "days"], F.inline("days"))
    return _in_period(spelled.select(*cells.columns, *rest))
