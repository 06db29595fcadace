"""Tables beside the archive: extrema, running sums, pyramids, and replaced days."""

import datetime as dt
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from terracell.functions import geo
from terracell.operators import conform, raster
from terracell.plans import areas, ingest
from terracell.schema import BBox, Grid
from terracell.sources import archive as store, pyramid, running, tiledays

GRID = Grid(lat0=0.0, lon0=-60.0, dlat=-0.5, dlon=0.5, n_rows=60, n_cols=60, tile=20)
BOX = BBox(west=-60.0, south=-30.0, east=-30.0, north=0.0)


def cells_of(spark, rows):
    df = spark.createDataFrame(rows, "source string, date string, row int, col int, value float")
    df = df.withColumn("date", F.col("date").cast("date"))
    return conform.with_keys(df.withColumns({"lat": geo.lat_of("row", GRID), "lon": geo.lon_of("col", GRID)}), GRID)


def full_days(spark, first, n, value="CAST((row * 7 + col * 3 + id) % 40 AS FLOAT)"):
    cells = (
        spark.range(n)
        .withColumn("date", F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")))
        .withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(59))))
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(59))))
        .withColumns({"source": F.lit("chirps"), "value": F.expr(value)})
        .withColumns({"lat": geo.lat_of("row", GRID), "lon": geo.lon_of("col", GRID)})
    )
    return conform.with_keys(cells, GRID).drop("id")


def rows_scanned(df):
    """Rows that came out of the Parquet scans of the executed plan."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if kind == "FileSourceScanExec" and "value" in node.output().toString():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def small_pages(spark):
    return {"parquet.page.row.count.limit": "400", "parquet.block.size": str(64 * 1024), "parquet.block.row.count.limit": "2000"}


@pytest.fixture()
def paged(spark):
    """Files with many small pages, as a large archive has them."""
    conf = spark._jsc.hadoopConfiguration()
    for k, v in small_pages(spark).items():
        conf.set(k, v)
    yield
    for k in small_pages(spark):
        conf.unset(k)


# One day of heavy rain in the area, and rain on every day far from it.
HOT = (
    "CAST(IF(row BETWEEN 5 AND 8 AND col BETWEEN 45 AND 50 AND id = 3 OR row >= 40 AND col < 20, 90,"
    " (row + col + id) % 40) AS FLOAT)"
)
ASK = dict(lat=-4.0, lon=-36.0, radius_km=500.0, start="2020-01-01", end="2020-12-31", trigger=50.0)


def test_extrema_skip_tiles_and_days(spark, tmp_path, paged):
    path = str(tmp_path / "archive")
    store.write_archive(full_days(spark, "2020-01-01", 20, HOT), path, summarise=True)
    cells, summary = store.scan_archive(spark, path), tiledays.scan_tile_days(spark, path)
    plain = areas.area_exceedances(cells, GRID, source="chirps", **ASK)
    pruned = areas.area_exceedances(cells, GRID, source="chirps", tile_days=summary, **ASK)
    assert sorted(plain.collect()) == sorted(pruned.collect()) and plain.count() == 24
    assert rows_scanned(pruned) <= rows_scanned(plain)  # pages know their largest value, too

    requests = spark.createDataFrame(
        [(1, "chirps", -4.0, -36.0, "2020-01-01", "2020-12-31", 50.0, 500.0), (2, "chirps", -4.0, -36.0, "2020-01-06", "2020-12-31", 50.0, 500.0),
         (3, "chirps", -4.0, -36.0, "2020-02-01", "2020-01-01", 50.0, 500.0), (4, "chirps", -4.0, -58.0, "2020-01-01", "2020-12-31", 50.0, 100.0)],
        "request_id int, source string, lat double, lon double, start_date string, end_date string, trigger double, radius double",
    )
    plain = areas.area_triggers(cells, requests, GRID)
    pruned = areas.area_triggers(cells, requests, GRID, tile_days=summary)
    assert sorted(plain.collect()) == sorted(pruned.collect()) and plain.count() == 24
    assert rows_scanned(pruned) < rows_scanned(plain) / 5


def test_extrema_stay_true(spark, tmp_path):
    """Files the summary was not told of are summed up, rows of files that went are left out."""
    path = str(tmp_path / "archive")
    told = lambda: {(r.tile_id, r.date): (r.low, r.high, r.n_cells) for r in tiledays.scan_tile_days(spark, path).collect()}
    plain = lambda: {(r.tile_id, r.date): (r.low, r.high, r.n_cells) for r in tiledays.tile_days(store.scan_archive(spark, path)).collect()}
    store.write_archive(full_days(spark, "2020-12-30", 2), path)
    assert told() == plain()
    tiledays.refresh_tile_days(spark, path)
    assert told() == plain()
    store.write_archive(full_days(spark, "2021-01-01", 2, HOT), path)
    assert told() == plain()
    tiledays.refresh_tile_days(spark, path)
    before = spark.read.parquet(tiledays.summary_path(path)).count()
    tiledays.refresh_tile_days(spark, path)
    assert spark.read.parquet(tiledays.summary_path(path)).count() == before
    store.replace_days(full_days(spark, "2020-12-31", 1, "CAST(7 AS FLOAT)"), path)
    assert told() == plain() and told()[(0, dt.date(2020, 12, 31))] == (7.0, 7.0, 400)
    assert store.scan_archive(spark, path).count() == 4 * 3600


def test_replaced_days_leave_the_others(spark, tmp_path):
    path = str(tmp_path / "archive")
    raw = lambda *days: cells_of(spark, [("chirps", d, 3, 4, float(i)) for i, d in enumerate(days, 1)]).select(
        "source", "date", "lat", "lon", F.col("value").alias("precip")
    )
    ingest.build_year_archive(raw("2020-01-01", "2020-02-01", "2021-05-05"), GRID, BOX, path)
    ingest.build_year_archive(raw("2020-03-01", "2020-02-01"), GRID, BOX, path)
    found = {(str(r.date), r.value) for r in store.scan_archive(spark, path).collect()}
    assert found == {("2020-01-01", 1.0), ("2020-02-01", 2.0), ("2020-03-01", 1.0), ("2021-05-05", 3.0)}
    assert not [f for f in os.listdir(path) if f.startswith("_replace")]


@pytest.mark.parametrize("whole", [True, False])
def test_a_crash_while_replacing_loses_nothing(spark, tmp_path, monkeypatch, whole):
    """The year is gone when the job dies after its copy was whole; the next job brings it back."""
    path = str(tmp_path / "archive")
    store.write_archive(full_days(spark, "2020-01-01", 3), path)

    def die(session, folder, to):
        if whole:
            shutil.rmtree(f"{to}/source=chirps/year=2020")
        else:
            shutil.rmtree(f"{folder}/years")
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_put_in_place", die)
        with pytest.raises(RuntimeError):
            store.replace_days(full_days(spark, "2020-01-03", 2, "CAST(7 AS FLOAT)"), path)
    store.recover_days(spark, path)
    days = {str(r.date): (r.n, r.v) for r in store.scan_archive(spark, path).groupBy("date").agg(F.count("*").alias("n"), F.max("value").alias("v")).collect()}
    assert {d: n for d, (n, _) in days.items()} == {f"2020-01-0{k}": 3600 for k in range(1, 5 if whole else 4)}
    assert (days["2020-01-03"][1] == 7.0) == whole
    store.replace_days(full_days(spark, "2020-01-03", 2, "CAST(7 AS FLOAT)"), path)
    assert store.scan_archive(spark, path).filter("value = 7 AND date = '2020-01-04'").count() == 3600


def test_running_sums_match_the_days(spark, tmp_path):
    """Sparse cells, missing values, gaps, events over the ends of the data, late and old appends."""
    draw = random.Random(3)
    days = [str(dt.date(2020, 11, 20) + dt.timedelta(k)) for k in range(120)]
    rows = {
        (s, d, r, c): draw.choice([None, float(draw.randint(0, 9))])
        for s in ("chirps", "merge")
        for d in days
        for r, c in [(draw.randint(0, 2), draw.randint(0, 2)) for _ in range(2)]
        if draw.random() < 0.5
    }
    rows[("temp", "2021-01-15", 1, 1)] = 4.0
    table = lambda keep: cells_of(spark, [(*k, v) for k, v in rows.items() if keep(k)])
    path, sums = str(tmp_path / "archive"), str(tmp_path / "sums")
    events = [(i, s, sorted({draw.choice(days) for _ in range(draw.randint(1, 90))})) for i, s in enumerate(["chirps", "merge", "temp", "nowhere"] * 5)]
    events.append((90, "chirps", [str(dt.date(2020, 1, 1) + dt.timedelta(k)) for k in range(800)]))
    asked = spark.createDataFrame(events, "event_id int, source string, days array<string>")
    asked = asked.withColumn("days", F.col("days").cast("array<date>"))
    # The first write lacks December of one source, which comes late.
    parts = [lambda k: k[1] < "2021-02-01" and not (k[0] == "merge" and "2020-12" in k[1]), lambda k: k[1] >= "2021-02-01", lambda k: k[0] == "merge" and "2020-12" in k[1]]
    done = []
    for keep in parts:
        new = table(keep)
        store.write_archive(new, path)
        done.append(keep)
        archive = store.scan_archive(spark, path)
        running.write_carries(archive, sums, new.select("source", "date"))
        got = running.event_sums(archive, running.scan_carries(spark, sums), running.event_intervals(asked))
        want = {}
        for i, s, wanted in events:
            for (source, d, r, c), v in rows.items():
                if source == s and d in wanted and any(k((source, d, r, c)) for k in done):
                    want[(i, s, r, c)] = want.get((i, s, r, c), 0.0) + (v or 0.0)
        assert {(r.event_id, r.source, r.row, r.col): r.total for r in got.collect()} == want


def test_events_do_not_multiply_days(spark, tmp_path):
    """An event joins each cell of its source once, however many days its months have."""
    path, sums = str(tmp_path / "archive"), str(tmp_path / "sums")
    rows = [("chirps", str(dt.date(2020, 1, 1) + dt.timedelta(d)), r, r, 1.0) for d in range(90) for r in range(40)]
    store.write_archive(cells_of(spark, rows), path)
    archive = store.scan_archive(spark, path)
    running.write_carries(archive, sums)
    asked = spark.range(200).selectExpr(
        "id AS event_id", "'chirps' AS source", "date_add(DATE'2020-01-20', CAST(id % 9 AS INT)) AS start_date", "DATE'2020-03-25' AS end_date"
    )
    found = running.event_sums(archive, running.scan_carries(spark, sums), asked)
    assert {(r.event_id, r.row): r.total for r in found.collect()} == {(e, r): 66.0 - e % 9 for e in range(200) for r in range(40)}
    most, todo = 0, [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            todo.append(node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan())
            continue
        if "Join" in kind:
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert most == 200 * 40


def test_level_of_a_view(spark, tmp_path, plan_of):
    box = BBox(west=-60.25, south=-29.75, east=-30.25, north=0.25)
    assert pyramid.pick_level(GRID, box, 60, 60, 4) == 0
    assert pyramid.pick_level(GRID, box, 31, 31, 4) == 0
    assert pyramid.pick_level(GRID, box, 30, 30, 4) == 1
    assert pyramid.pick_level(GRID, box, 7, 30, 4) == 1
    assert pyramid.pick_level(GRID, box, 7, 7, 4) == 3
    assert pyramid.pick_level(GRID, box, 1, 1, 4) == 4
    path = str(tmp_path / "pyramid")
    cells = full_days(spark, "2020-01-01", 2)
    pyramid.write_pyramid(cells, path, 4, GRID)
    pyramid.write_pyramid(cells, path, 4, GRID)  # a repeated run replaces
    seen = pyramid.view(cells, path, 4, GRID, box, 7, 7, "2020-01-02", "2020-01-02")
    assert "level#" in plan_of(seen) and "= 3)" in plan_of(seen)
    means = {(r.row, r.col): r.value for r in raster.overviews(cells.filter("date = '2020-01-02'"), 3).filter("level = 3").collect()}
    assert rows_scanned(seen) == len(means) == 64  # of one level and day
    assert len(seen.collect()) == 49 and {r.value for r in seen.collect()} <= set(means.values())
    close = pyramid.view(cells, path, 4, GRID, BBox(west=-50.0, south=-10.0, east=-45.0, north=-5.0), 10, 10, "2020-01-02", "2020-01-02")
    assert close.count() == 100


def test_tiles_wholly_inside_need_no_distance(spark):
    from terracell.operators import lookup

    cells = full_days(spark, "2020-01-01", 1)
    sites = spark.createDataFrame(
        [(1, -15.0, -45.0, 1400.0), (2, -2.0, -58.0, 300.0), (3, -15.0, -45.0, 1200.0), (4, -14.75, -45.25, 20.0)],
        "site_id int, lat double, lon double, radius double",
    )
    tiles = {(r.site_id, r.tile_id): r.all_in for r in lookup.covering_tiles(sites, GRID).collect()}
    assert tiles[(1, 4)] and not tiles[(1, 0)] and sum(v for (s, _), v in tiles.items() if s in (2, 4)) == 0
    inside = geo.within_radius("lat", "lon", "slat", "slon", "radius")
    plain = cells.crossJoin(sites.select("site_id", F.col("lat").alias("slat"), F.col("lon").alias("slon"), "radius")).filter(inside)
    found = lookup.radius_join(cells, sites, GRID)
    rows = lambda df: sorted(tuple(r) for r in df.select("site_id", "row", "col").collect())
    assert rows(found) == rows(plain)
    held = {(r.site_id, r.tile_id): r.n for r in plain.groupBy("site_id", "tile_id").agg(F.count("*").alias("n")).collect()}
    assert all(held[k] == 400 for k, whole in tiles.items() if whole)
    # At the edge of a circle the corners decide, whatever the radius.
    many = spark.range(60).select(
        F.col("id").alias("site_id"), (-1.0 - F.col("id") * 7 % 28).cast("double").alias("lat"),
        (-59.0 + F.col("id") * 11 % 28).cast("double").alias("lon"), (200.0 + F.col("id") * 37).cast("double").alias("radius"),
    )
    wrong = lookup.covering_tiles(many, GRID).filter("all_in").withColumnsRenamed({"lat": "slat", "lon": "slon"})
    assert wrong.count() > 50
    assert wrong.join(cells, "tile_id").filter(~inside).count() == 0


def test_a_second_ingest_reads_and_indexes_its_day_only(spark, tmp_path):
    raw = full_days(spark, "2020-01-01", 3).select("source", F.col("date").alias("time"), "lat", "lon", F.col("value").alias("rdp"))
    window = lambda a, b: spark.createDataFrame([("chirps", a, b)], "source string, start_date string, end_date string").select(
        "source", F.col("start_date").cast("date").alias("start_date"), F.col("end_date").cast("date").alias("end_date"))
    path, work, index = (str(tmp_path / x) for x in ("daily", "work", "index"))
    run = lambda a, b: ingest.ingest_precipitation(raw, window(a, b), GRID, BOX, path, work, index)
    run("2020-01-01", "2020-01-02")
    first = {r.location for r in spark.read.parquet(index).collect()}
    files = set(os.listdir(index))
    run("2020-01-01", "2020-01-03")
    after = spark.read.parquet(index).collect()
    assert len(first) == 2 and len(after) == 3 and first < {r.location for r in after}
    assert files - {"_SUCCESS"} <= set(os.listdir(index))  # what was there is not written again
    run("2020-01-01", "2020-01-03")
    assert spark.read.parquet(index).count() == 3


def test_scenes_of_a_collection(spark):
    from terracell.operators import scenes

    rows = [(k, f"2024-01-0{k}", 5.0, (-50.0, -10.0, -49.0, -9.0), c) for k, c in enumerate(["s2", "s1", "modis", None], 1)]
    df = spark.createDataFrame(rows, "scene_id int, ts string, cloud_cover double, bounds struct<west:double,south:double,east:double,north:double>, collection string")
    ask = lambda c: sorted(r.scene_id for r in scenes.scene_search(df, BOX, "2024-01-01", "2024-01-31", 15.0, c).collect())
    assert ask(None) == [1, 2, 3, 4] and ask("s2") == [1] and ask(("s2", "modis")) == [1, 3] and ask(()) == []
