"""Tables written by jobs: layout, repetition, restarts."""

import datetime as dt
import glob
import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from terracell.operators import conform, lookup
from terracell.functions import geo
from terracell.plans import ingest
from terracell.schema import ARCHIVE_SCHEMA, BBox, Grid
from terracell.session import shared_dir
from terracell.sources import archive as store
from terracell.sources import catalog
from terracell.streaming import cell_stream, stream_append, stream_exceedances

GRID = Grid(lat0=0.0, lon0=-60.0, dlat=-0.5, dlon=0.5, n_rows=50, n_cols=50)
BOX = BBox(west=-60.0, south=-20.0, east=-40.0, north=0.0)


def days_of_cells(spark, first, n, value=1.0, source="chirps"):
    cells = (
        spark.range(n).select(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("date"))
        .withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(49))))
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(49))))
        .withColumns({"source": F.lit(source), "lat": geo.lat_of("row", GRID), "lon": geo.lon_of("col", GRID),
                      "value": F.lit(value).cast("float")})
    )
    return conform.with_keys(cells, GRID)


@pytest.mark.parametrize("constant", [True, False])
def test_archive_layout(spark, tmp_path, constant):
    path = str(tmp_path / "archive")
    cells = days_of_cells(spark, "2020-12-30", 4)
    if not constant:
        cells = cells.withColumn("source", F.when(F.col("row") >= 0, F.concat(F.lit("chirp"), F.substring("source", 6, 1))))
    store.write_archive(cells, path)
    assert sorted(os.listdir(path + "/source=chirps"))[-2:] == ["year=2020", "year=2021"]
    back = store.scan_archive(spark, path, "chirps")
    assert back.count() == 10000 and set(back.schema) == set(ARCHIVE_SCHEMA)
    one = glob.glob(path + "/source=chirps/year=2021/*.parquet")[0]
    import pyarrow.parquet as pq

    t = pq.read_table(one, columns=["tile_id", "date"]).to_pandas()
    keys = list(zip(t.tile_id, t.date))
    assert keys == sorted(keys)


def test_bucketed_table_joins_in_place(spark, plan_of):
    store.write_archive_table(days_of_cells(spark, "2020-12-30", 2), "cells_by_tile", 4)
    sites = spark.createDataFrame([(i, -3.0 - i, -55.0, 150.0) for i in range(5)], "site_id int, lat double, lon double, radius double")
    near = lookup.radius_join(spark.table("cells_by_tile"), sites, GRID)
    direct = lookup.radius_join(days_of_cells(spark, "2020-12-30", 2), sites, GRID)
    assert near.count() == direct.count() > 0


def test_daily_rewrite_replaces_one_day(spark, tmp_path):
    path = str(tmp_path / "daily")
    store.write_daily(days_of_cells(spark, "2021-01-01", 3), path)
    store.write_daily(days_of_cells(spark, "2021-01-02", 1, 9.0), path)
    got = store.scan_daily(spark, path).groupBy("date").agg(F.count("*").alias("n"), F.max("value").alias("v")).collect()
    assert {r.date.day: (r.n, r.v) for r in got} == {1: (2500, 1.0), 2: (2500, 9.0), 3: (2500, 1.0)}


def windows(spark, first, last, source="chirps"):
    return spark.createDataFrame([(source, dt.date.fromisoformat(first), dt.date.fromisoformat(last))],
                                 "source string, start_date date, end_date date")


def test_ingest_precipitation_twice(spark, tmp_path):
    raw = days_of_cells(spark, "2021-01-01", 4).select(
        "source", F.col("date").alias("time"), F.col("lat").alias("latitude"),
        F.pmod("lon", F.lit(360.0)).alias("longitude"),
        # The second day has no valid value, as NaN and as a negative number.
        F.when(F.day("date") == 2, F.when(F.col("row") == 0, -1.0).otherwise(float("nan"))).otherwise(2.0).alias("pr"))
    run = lambda k: ingest.ingest_precipitation(
        raw, windows(spark, "2021-01-01", "2021-01-05"), GRID, BOX,
        str(tmp_path / "daily"), str(tmp_path / f"work{k}"), str(tmp_path / "index"))
    status = lambda df: [r.status for r in df.orderBy("date").collect()]
    assert status(run(1)) == ["created", "error", "created", "created", "error"]
    assert status(run(2)) == ["skipped", "error", "skipped", "skipped", "error"]
    cells = store.scan_daily(spark, str(tmp_path / "daily"))
    assert cells.agg(F.min("lon")).first()[0] == -60.0
    # Cells that touch the box: half a degree cells, centres from -20 to 0 and -60 to -40.
    assert cells.filter("date = '2021-01-01'").count() == 41 * 41
    index = spark.read.parquet(str(tmp_path / "index"))
    found = {r.ingestion.day: urlparse(r.location).path for r in index.collect()}
    assert {d: os.path.basename(p) for d, p in found.items()} == {d: f"date=2021-01-0{d}" for d in (1, 3, 4)}
    assert all(os.path.isdir(p) for p in found.values())


def test_ingest_temperature_fills_each_target(spark, tmp_path):
    daily, kept = str(tmp_path / "daily"), str(tmp_path / "archive")
    store.write_daily(days_of_cells(spark, "2021-03-01", 1, 5.0, "temp_max"), daily)
    raw = days_of_cells(spark, "2021-03-01", 3, 300.0, "temp_max").select(
        "source", F.col("date").cast("timestamp_ntz").alias("valid_time"), "lat", "lon", F.col("value").alias("t2m"))
    run = lambda k: ingest.ingest_temperature(
        raw, windows(spark, "2021-03-01", "2021-03-04", "temp_max"), "2m_temperature", GRID, BOX,
        daily, kept, str(tmp_path / f"work{k}"), batch_days=2)
    got = {r.date.day: (r.batch_start.day, r.daily_status, r.archive_status) for r in run(1).collect()}
    assert got == {1: (1, "skipped", "created"), 2: (1, "created", "created"),
                   3: (3, "created", "created"), 4: (3, "error", "error")}
    got = {r.date.day: (r.daily_status, r.archive_status) for r in run(2).collect()}
    assert got == {4: ("error", "error")}
    cells = store.scan_archive(spark, kept)
    assert cells.count() == 3 * 41 * 41
    assert abs(cells.first().value - 26.85) < 1e-4


def test_ingest_temperature_reads_the_raster_once(spark, tmp_path):
    """Both targets come from one pass over the raw rows, and nothing of it is left in the work folder."""
    seen = spark.sparkContext.accumulator(0)
    raw = days_of_cells(spark, "2021-03-01", 3, 300.0, "temp_max").select(
        "source", F.col("date").cast("timestamp_ntz").alias("valid_time"), "lat", "lon", F.col("value").alias("t2m"))

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    daily, kept, work = (str(tmp_path / n) for n in ("daily", "archive", "work"))
    ingest.ingest_temperature(
        raw.mapInArrow(counted, raw.schema), windows(spark, "2021-03-01", "2021-03-03", "temp_max"), "2m_temperature",
        GRID, BOX, daily, kept, work)
    assert seen.value == 3 * 2500
    assert store.scan_archive(spark, kept).count() == 3 * 41 * 41 and "cells" not in os.listdir(work)


def test_stream_completes_days_and_survives_a_lost_checkpoint(spark, tmp_path):
    inbox, path = str(tmp_path / "in"), str(tmp_path / "archive")
    full = days_of_cells(spark, "2021-05-01", 2)
    full.filter("row < 25").coalesce(1).write.parquet(inbox)
    run = lambda check: stream_append(
        cell_stream(spark, inbox, full.schema, files_per_batch=1), path, str(tmp_path / check)).awaitTermination()
    run("c1")
    # The rest of both days, and some cells again.
    full.filter("row >= 20").coalesce(2).write.mode("append").parquet(inbox)
    run("c1")
    run("c2")
    cells = store.scan_archive(spark, path)
    assert cells.count() == 5000 and cells.distinct().count() == 5000


def test_stream_exceedances(spark, tmp_path):
    inbox, hits = str(tmp_path / "in"), str(tmp_path / "hits")
    cells = days_of_cells(spark, "2021-05-01", 2, 30.0)
    cells.write.parquet(inbox)
    sites = spark.createDataFrame([("a", -3.0, -55.0, 20.0), ("b", -3.0, -55.0, 30.0)],
                                  "site_id string, lat double, lon double, trigger double")
    run = lambda: stream_exceedances(cell_stream(spark, inbox, cells.schema), sites, GRID, hits, str(tmp_path / "c")).awaitTermination()
    run()
    run()
    assert [(r.site_id, r.date.day) for r in spark.read.parquet(hits).orderBy("date").collect()] == [("a", 1), ("a", 2)]


def test_catalog(spark):
    cells = days_of_cells(spark, "2021-05-01", 2)
    info = catalog.dataset_info(cells).first()
    assert (info.n_days, info.n_lat, info.n_lon, info.variables) == (2, 50, 50, ["value"])
    asked = spark.createDataFrame([("chirps",), ("merge",)], "source string")
    flags = {r.source: r.is_loaded for r in catalog.with_loaded_flag(asked, cells).collect()}
    assert flags == {"chirps": True, "merge": False}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_one_row_for_each_day_and_cell(spark, tmp_path):
    """Two times of a day, two spellings of a longitude, and a row off the grid."""
    raw = spark.createDataFrame(
        [("chirps", "2020-05-01 00:00:00", -1.0, -59.5, 1.0), ("chirps", "2020-05-01 12:00:00", -1.0, 300.5, 2.0),
         ("chirps", "2020-05-01 12:00:00", -1.0, -75.5, 9.0), ("merge", "2020-05-01 00:00:00", -1.0, -59.5, 5.0)],
        "source string, time string, lat double, lon double, value double",
    ).withColumn("time", F.col("time").cast("timestamp_ntz"))
    expected = [("chirps", 2, 1, -1.0, -59.5, 2.0), ("merge", 2, 1, -1.0, -59.5, 5.0)]
    seen = lambda df: sorted(tuple(r) for r in df.select("source", "row", "col", "lat", "lon", "value").collect())
    years = str(tmp_path / "years")
    for _ in range(2):
        ingest.build_year_archive(raw, GRID, BOX, years)
    assert seen(store.scan_archive(spark, years)) == expected

    day = F.lit("2020-05-01").cast("date")
    windows = raw.select("source").distinct().withColumns({"start_date": day, "end_date": day})
    daily = str(tmp_path / "daily")
    for k in range(2):
        ingest.ingest_precipitation(raw, windows, GRID, BOX, daily, str(tmp_path / f"work{k}"))
        assert seen(store.scan_daily(spark, daily)) == expected

    kelvin = raw.withColumnRenamed("value", "t2m").withColumn("t2m", F.col("t2m") + 273.15)
    daily, kept = str(tmp_path / "t-daily"), str(tmp_path / "t-kept")
    for k in range(2):
        ingest.ingest_temperature(kelvin, windows, "2m_temperature", GRID, BOX, daily, kept, str(tmp_path / f"t{k}"))
        for table in (store.scan_daily(spark, daily), store.scan_archive(spark, kept)):
            assert [r[:5] for r in seen(table)] == [r[:5] for r in expected]
