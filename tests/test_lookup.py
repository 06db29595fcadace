"""Sites against cells, by brute force and at the borders."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terracell.functions import geo
from terracell.operators import conform, lookup
from terracell.plans import areas, points
from terracell.schema import Grid

UP = Grid(lat0=-10.0, lon0=-60.0, dlat=0.25, dlon=0.25, n_rows=41, n_cols=37, tile=5)
DOWN = Grid(lat0=0.0, lon0=-60.0, dlat=-0.25, dlon=0.25, n_rows=41, n_cols=37, tile=5)


def grid_cells(spark, grid, days=1):
    cells = (
        spark.range(days).select(F.date_add(F.lit("2020-12-31").cast("date"), F.col("id").cast("int")).alias("date"))
        .withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(grid.n_rows - 1))))
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(grid.n_cols - 1))))
        .withColumns({"source": F.lit("chirps"), "lat": geo.lat_of("row", grid), "lon": geo.lon_of("col", grid)})
        .withColumn("value", ((F.col("row") * 7 + F.col("col") * 3) % 100).cast("float"))
    )
    return conform.with_keys(cells, grid)


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def inside(lat, lon, site_lat, site_lon, r):
    half = r / 111.32
    return (
        site_lat - half <= lat <= site_lat + half
        and site_lon - half <= lon <= site_lon + half
        and km(site_lat, site_lon, lat, lon) <= r
    )


@pytest.mark.parametrize("grid", [UP, DOWN])
def test_radius_join_is_box_and_circle(spark, grid):
    rng = random.Random(1)
    sites = [(i, rng.uniform(-12, 2), rng.uniform(-62, -49), rng.choice([5.0, 40.0, 180.0, 2000.0])) for i in range(25)]
    cells = grid_cells(spark, grid)
    table = spark.createDataFrame(sites, "site_id int, lat double, lon double, radius double")
    got = {(r.site_id, r.row, r.col) for r in lookup.radius_join(cells, table, grid).collect()}
    want = set()
    for s, lat, lon, r in sites:
        for i in range(grid.n_rows):
            for j in range(grid.n_cols):
                if inside(grid.lat0 + grid.dlat * i, grid.lon0 + grid.dlon * j, lat, lon, r):
                    want.add((s, i, j))
    assert got == want and want


@pytest.mark.parametrize("grid", [UP, DOWN])
def test_literal_area_equals_the_join(spark, grid):
    cells = grid_cells(spark, grid, days=2)
    site = spark.createDataFrame([(1, -4.1, -55.03, 210.0)], "site_id int, lat double, lon double, radius double")
    a = areas.area_window(cells, grid, -4.1, -55.03, 210.0, "2020-12-31", "2021-01-01")
    b = lookup.radius_join(cells, site, grid)
    key = lambda df: sorted((r.date, r.row, r.col) for r in df.collect())
    assert key(a) == key(b) and a.count() > 100


def test_radius_is_inclusive(spark):
    cells = grid_cells(spark, UP)
    r = km(-5.0, -55.0, -5.0, -54.0)
    # One degree east on the parallel: inside the box, exactly on the circle.
    keep = geo.within_radius("lat", "lon", F.lit(-5.0), F.lit(-55.0), F.lit(r * (1 + 1e-12)))
    on_circle = cells.filter(keep).filter("lat = -5.0 AND lon = -54.0")
    half = r / 111.32
    assert on_circle.count() == (1 if half >= 1 else 0)


@pytest.mark.parametrize("grid", [UP, DOWN])
def test_nearest_cell_ties_and_borders(spark, grid):
    sites = {
        "tie": (-5.125, -55.125),  # half-way on both axes: the larger coordinate
        "edge": (0.2, -50.9),  # beyond the last centre, within tolerance
        "far": (3.0, -55.0),
        "null": (None, -55.0),
        "nan": (float("nan"), -55.0),
    }
    table = spark.createDataFrame([(k, *v) for k, v in sites.items()], "site_id string, lat double, lon double")
    got = {r.site_id: r for r in lookup.snap_sites(table, grid, 0.25).collect()}
    at = lambda r: (grid.lat0 + grid.dlat * r.row, grid.lon0 + grid.dlon * r.col)
    assert at(got["tie"]) == (-5.0, -55.0)
    assert at(got["edge"]) == (0.0, -51.0) and got["edge"].matched
    assert not got["far"].matched and not got["null"].matched and not got["nan"].matched
    assert grid.nearest(-5.125, -55.125) == (got["tie"].row, got["tie"].col)


def test_tolerance_is_inclusive(spark):
    table = spark.createDataFrame([(0, -5.0625, -55.0), (1, -5.07, -55.0)], "site_id int, lat double, lon double")
    got = {r.site_id: r.matched for r in lookup.snap_sites(table, UP, 0.0625).collect()}
    assert got == {0: True, 1: False}


def test_irregular_axis_equals_regular(spark):
    rng = random.Random(2)
    cells = grid_cells(spark, UP)
    sites = [(i, rng.uniform(-11, 1), rng.uniform(-61, -50)) for i in range(60)] + [(99, -5.125, -55.125)]
    table = spark.createDataFrame(sites, "site_id int, lat double, lon double")
    a = lookup.point_lookup_irregular(cells, table, 0.125)
    b = lookup.point_lookup(cells, table, UP, 0.125)
    key = lambda df: sorted((r.site_id, r.row, r.col) for r in df.collect())
    assert key(a) == key(b) and a.count() > 30


def requests(spark, *rows):
    return spark.createDataFrame(
        rows, "request_id int, source string, lat double, lon double, start_date string, end_date string, trigger double")


def test_requests_across_years_duplicates_and_failures(spark):
    cells = grid_cells(spark, UP, days=3)  # 2020-12-31 .. 2021-01-02
    good = ("chirps", -5.01, -55.02, "2020-12-31", "2021-01-01", 10.0)
    table = requests(
        spark, (1, *good), (2, *good),
        (3, "chirps", -5.01, -55.02, "2021-01-02", "2020-12-31", 10.0),
        (4, "chirps", 8.0, -55.02, "2020-12-31", "2021-01-01", 10.0),
        (5, "nowhere", -5.01, -55.02, "2020-12-31", "2021-01-01", 10.0),
        (6, "chirps", -5.01, -55.02, "31.12.2020", "2021-01-01", 10.0),
        (7, "chirps", None, -55.02, "2020-12-31", "2021-01-01", 10.0),
        (8, "chirps", -5.01, -55.02, "1999-01-01", "1999-02-01", 10.0),
    )
    got = {r.request_id: r for r in points.point_triggers(cells, table, UP).collect()}
    assert {k: r.status for k, r in got.items()} == {
        1: "ok", 2: "ok", 3: "bad_range", 4: "no_cell", 5: "unknown_source",
        6: "bad_date", 7: "missing_location", 8: "ok"}
    value = (20 * 7 + 20 * 3) % 100
    assert value == 0  # the cell under the site
    assert all(r.n_exceedances == 0 and r.exceedances == [] for r in got.values())
    low = table.withColumn("trigger", F.lit(-1.0))
    got = {r.request_id: r for r in points.point_triggers(cells, low, UP).collect()}
    assert [got[k].n_exceedances for k in range(1, 9)] == [2, 2, 0, 0, 0, 0, 0, 0]
    assert [e.date.isoformat() for e in got[1].exceedances] == ["2020-12-31", "2021-01-01"]
    history = {r.request_id: r.history for r in points.point_history(cells, table, UP).collect()}
    assert history[2] == {"2020-12-31": 0.0, "2021-01-01": 0.0} and history[4] == {}


def test_history_keeps_the_last_of_a_day(spark):
    cells = grid_cells(spark, UP)
    twice = cells.withColumn("loaded", F.lit(1)).unionByName(
        cells.withColumns({"loaded": F.lit(2), "value": F.lit(5.0).cast("float")}))
    table = requests(spark, (1, "chirps", -5.0, -55.0, "2020-01-01", "2021-01-01", 0.0))
    got = points.point_history(twice, table, UP, order=("loaded",)).first()
    assert got.history == {"2020-12-31": 5.0}


def test_single_site_out_of_tolerance_is_empty(spark):
    cells = grid_cells(spark, UP)
    ask = lambda lat: points.site_series(cells, UP, lat, -55.0, "2020-01-01", "2021-12-31").count()
    assert ask(-5.04) == 1 and ask(-5.1) == 0


def test_requests_without_trigger_or_radius(spark):
    asked = spark.createDataFrame(
        [(1, "chirps", 0.0, 0.0, 5.0, 10.0), (2, "chirps", 0.0, 0.0, None, 10.0), (3, "chirps", 0.0, 0.0, 5.0, None)],
        "request_id int, source string, lat double, lon double, trigger double, radius double",
    ).selectExpr("*", "'2020-01-01' AS start_date", "'2020-01-02' AS end_date")
    from terracell.plans.areas import check_area_requests

    checked = check_area_requests(asked).orderBy("request_id")
    assert [r.status for r in checked.collect()] == ["ok", "missing_trigger", "missing_radius"]


def test_sites_meet_places_not_days(spark):
    """Rows that reach the join don't grow with the days; places that miss values add up as their cells do."""
    from terracell.operators import aggregates

    cells = grid_cells(spark, UP, days=3).withColumn("value", F.when(F.col("row") % 5 != 1, F.col("value")))
    table = spark.createDataFrame([(i, -3.0 - i, -56.0, 190.0) for i in range(4)], "site_id int, lat double, lon double, radius double")
    plain = lookup.radius_join(cells, table, UP)
    want = plain.groupBy("site_id").agg(F.count("*"), F.count("value"), F.sum(F.col("value").cast("double"))).collect()
    places = aggregates.place_totals(cells.withColumn("tile_id", geo.tile_id("row", "col", UP)))
    got = aggregates.site_totals(lookup.radius_join(places, table, UP)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 4
    assert places.count() == UP.n_rows * UP.n_cols
    # The join itself lies below the days.
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join Inner")
    assert set(plain.columns) == {*cells.columns, "tile_id", "site_id", "site_lat", "site_lon", "radius"}
