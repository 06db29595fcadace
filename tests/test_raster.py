"""Raster statistics, comparison, resampling, scenes and tiles on small frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.functions import geo
from terracell.operators import aggregates, append, conform, filters, mapview, raster, resample, scenes, styling
from terracell.schema import BBox, Grid
from terracell.sources import archive as store
from terracell.sources import granules, tiles

CELLS = "source string, date string, row int, col int, value float"


def cells(spark, rows):
    return spark.createDataFrame(rows, CELLS).withColumn("date", F.col("date").cast("date"))


def random_raster(spark, n=300, seed=0):
    rng = random.Random(seed)
    rows = [("a", "2020-01-01", i // 20, i % 20, rng.choice([None, float(np.float32(rng.gauss(20, 9)))])) for i in range(n)]
    return rows, cells(spark, rows)


def test_stats_and_histogram_match_numpy(spark):
    rows, df = random_raster(spark)
    v = np.array([r[4] for r in rows if r[4] is not None], dtype=np.float64)
    s = raster.raster_stats(df).first()
    assert (s["min"], s["max"]) == (v.min(), v.max())
    assert np.isclose(s["mean"], v.mean()) and np.isclose(s["std"], v.std())
    assert s.n_missing == len(rows) - len(v) and (s.n_rows, s.n_cols) == (15, 20)
    counts, _ = np.histogram(v, 50)
    got = {r.bin: r["count"] for r in raster.histogram(df).collect()}
    assert got == {i + 1: c for i, c in enumerate(counts) if c}
    assert sum(got.values()) == len(v)
    whole = {r.bin: r["count"] for r in raster.histogram(df, keys=()).collect()}
    assert whole == got


def test_histogram_of_a_single_value(spark):
    df = cells(spark, [("a", "2020-01-01", 0, i, 7.0) for i in range(4)])
    got = [(r.bin, r["count"]) for r in raster.histogram(df).collect()]
    counts, _ = np.histogram([7.0] * 4, 50)
    assert got == [(int(np.argmax(counts)) + 1, 4)]


def test_difference_counts_all_cells(spark):
    a = cells(spark, [("a", "2020-01-01", 0, i, v) for i, v in enumerate([1.0, 2.0, None, 4.0])])
    b = cells(spark, [("a", "2020-01-02", 0, i, v) for i, v in enumerate([1.0, 2.5, 3.0])])
    got = raster.raster_diff_stats(raster.raster_align(a, b)).first()
    assert (got.max_abs, got.mean_abs, got.n_different, got.pct_different) == (0.5, 0.25, 1, 25.0)


def test_validation(spark):
    df = cells(spark, [("a", "2020-01-01", 0, 0, None), ("a", "2020-01-02", 0, 0, -1.0),
                       ("a", "2020-01-03", 0, 0, 0.0), ("b", "2020-01-03", 0, 0, 5.0)])
    df = df.withColumn("crs", F.when(F.col("source") == "a", "EPSG:4326"))
    got = {(r.source, r.date.day): r.status for r in raster.validate_granules(df).collect()}
    assert got == {("a", 1): "no_valid_value", ("a", 2): "no_valid_value", ("a", 3): "ok", ("b", 3): "no_crs"}


def test_all_missing_day_and_scene_go(spark):
    df = cells(spark, [("a", "2020-01-01", 0, 0, None), ("a", "2020-01-02", 0, 0, None), ("a", "2020-01-02", 0, 1, 1.0)])
    assert filters.drop_empty_days(df).count() == 2
    px = df.withColumnRenamed("source", "x").withColumn("scene_id", F.day("date"))
    assert {r.scene_id for r in filters.drop_empty_scenes(px).collect()} == {2}
    pct = {r.scene_id: r.valid_pct for r in raster.valid_pct(px).collect()}
    assert pct == {1: 0.0, 2: 50.0}


def test_overviews_are_means_of_what_is_there(spark):
    df = cells(spark, [("a", "2020-01-01", r, c, None if (r, c) == (0, 0) else float(r * 4 + c)) for r in range(4) for c in range(4)])
    got = {(r.level, r.row, r.col): r.value for r in raster.overviews(df, 2).collect()}
    assert got[(1, 0, 0)] == np.float32((1 + 4 + 5) / 3) and got[(1, 1, 1)] == 12.5
    assert got[(2, 0, 0)] == 8.0


def test_bilinear_matches_the_formula(spark):
    rng = np.random.default_rng(0)
    src = rng.integers(0, 100, (6, 7)).astype(float)
    pixels = [("s", float(10 - i), float(20 + j), float(src[i, j])) for i in range(6) for j in range(7) if (i, j) != (2, 3)]
    df = spark.createDataFrame(pixels, "scene_id string, lat double, lon double, value double")
    grid = Grid(lat0=10.0, lon0=20.0, dlat=-0.4, dlon=0.3, n_rows=13, n_cols=21)
    got = {(r.row, r.col): r.value for r in resample.bilinear_resample(df, grid, 1.0, 1.0).collect()}
    for i in range(13):
        for j in range(21):
            y, x = 0.4 * i, 0.3 * j
            num = den = 0.0
            for a in range(6):
                for b in range(7):
                    w = max(0, 1 - abs(y - a)) * max(0, 1 - abs(x - b))
                    if w > 1e-9 and (a, b) != (2, 3):
                        num, den = num + w * src[a, b], den + w
            if den > 1e-9:
                assert np.isclose(got[(i, j)], num / den, rtol=1e-5)


def test_resampled_cells_are_not_moved(spark, plan_of):
    """Pixels are shuffled along rows only, over more tasks than there are partitions, and their cells never."""
    df = spark.range(10).selectExpr("id % 2 AS scene_id", "10D - id AS lat", "20D AS lon", "CAST(id AS FLOAT) AS value")
    grid = Grid(lat0=10.0, lon0=20.0, dlat=-0.5, dlon=0.5, n_rows=20, n_cols=20)
    plan = plan_of(resample.bilinear_resample(df, grid, 1.0, 1.0))
    tasks = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert plan.count("Exchange") == 1 and f", {tasks}), REPARTITION_BY_NUM" in plan


def test_grid_axes(spark):
    area = "named_struct('west', 0D, 'south', 0D, 'east', 1D, 'north', 0.55D)"
    df = spark.sql(f"SELECT 1 AS id, {area} AS area")
    got = resample.grid_axes(df, 0.1, 100).collect()
    lat = sorted((r.idx, r.coord) for r in got if r.axis == "lat")
    assert np.allclose([c for _, c in lat], np.linspace(0.55, 0, 5))
    lon = sorted((r.idx, r.coord) for r in got if r.axis == "lon")
    assert np.allclose([c for _, c in lon], np.linspace(0, 1, 10))
    assert resample.grid_axes(df, 0.1, 3).count() == 6
    assert resample.grid_axes(df, 2.0, 3).count() == 0


def test_overlap_pairs_once_each_and_touching_is_not_overlap(spark):
    rng = random.Random(3)
    box = lambda: (lambda w, s: (w, s, w + rng.uniform(0.1, 4), s + rng.uniform(0.1, 4)))(rng.uniform(-5, 5), rng.uniform(-5, 5))
    A, B = [box() for _ in range(40)] + [(0, 0, 1, 1)], [box() for _ in range(30)] + [(1, 0, 2, 1)]
    shape = "struct<west:double,south:double,east:double,north:double>"
    a = spark.createDataFrame([(i, tuple(map(float, x))) for i, x in enumerate(A)], f"scene_id int, bounds {shape}")
    b = spark.createDataFrame([(i, tuple(map(float, x))) for i, x in enumerate(B)], f"area_id int, area {shape}")
    got = [(r.scene_id, r.area_id) for r in scenes.scene_overlap(a, b).collect()]
    want = [(i, j) for i, x in enumerate(A) for j, y in enumerate(B)
            if x[0] < y[2] and x[2] > y[0] and x[1] < y[3] and x[3] > y[1]]
    assert sorted(got) == sorted(want) and (40, 30) not in got


@pytest.mark.parametrize("n_scenes, n_areas", [(600, 20), (20, 600)])
def test_overlap_pairs_of_a_hot_square_are_spread_over_tasks(spark, monkeypatch, n_scenes, n_areas):
    """All boxes in a few squares, and all rows in one file: no task holds most of the pairs."""
    monkeypatch.setattr(scenes, "MOST_PAIRS", 1000, raising=False)
    rng = random.Random(4)
    shape = "struct<west:double,south:double,east:double,north:double>"

    def table(n, key, box):
        rows = [(i, (w, s, w + 1.0, s + 1.0)) for i, w, s in ((i, rng.uniform(-9.4, -9), rng.uniform(4, 4.4)) for i in range(n))]
        rows.append((n, (-9.0, 4.0, float("nan"), 5.0)))  # NaN is east of all
        return spark.createDataFrame(rows + rows[:2], f"{key} int, {box} {shape}").coalesce(1)

    a, b = table(n_scenes, "scene_id", "bounds"), table(n_areas, "area_id", "area")
    task = F.spark_partition_id().alias("task")
    got = scenes.scene_overlap(a, b).groupBy(task).agg(F.count("*").alias("n"), F.min("scene_id"), F.max("area_id")).collect()
    total = (n_scenes + 3) * (n_areas + 3)
    assert sum(r.n for r in got) == total and len(got) > 3 and max(r.n for r in got) < total / 2


def test_overlap_pairs_meet_in_one_square(spark):
    """Boxes over many squares; before, a pair was compared in each square that both touch."""
    box = "struct(cast(id % 7 - 3.5 as double) as west, id % 5 - 2.25D as south, id % 7 + 0.5D as east, id % 5 + 1.75D as north)"
    a = scenes._squares(spark.range(40).selectExpr("id as scene_id", f"{box} as bounds"), "bounds", 1.0, True)
    b = scenes._squares(spark.range(30).selectExpr("id as area_id", f"{box} as area"), "area", 1.0, False)
    met = a.join(b, ["_x", "_y"]).select("scene_id", "area_id")
    assert met.count() == met.distinct().count() >= 900


def test_map_window_ties_go_to_the_smaller_row(spark):
    grid = Grid(lat0=0.5, lon0=0.5, dlat=1.0, dlon=1.0, n_rows=2, n_cols=2)
    df = cells(spark, [("a", "2020-01-01", r, c, float(r * 2 + c)) for r in range(2) for c in range(2)])
    df = df.withColumns({"lat": geo.lat_of("row", grid), "lon": geo.lon_of("col", grid)})
    got = mapview.map_window(df, BBox(0, 0, 2, 2), 1, 1).collect()
    assert [(r.x, r.y, r.value) for r in got] == [(0, 0, 0.0)]
    assert mapview.map_window(df, BBox(0, 0, 2, 2), 2, 2).count() == 4


def test_style_join_under_and_missing(spark):
    df = spark.createDataFrame([("temperature", v) for v in (-11.0, -10.0, 59.9, 60.0, 99.0, None)], "style string, value double")
    got = {r.value: r.label for r in styling.style_join(df, styling.style_table(spark)).collect()}
    assert got == {-11.0: None, -10.0: "-10°C", 59.9: "55°C", 60.0: "60°C", 99.0: "60°C", None: None}


def test_tiles_with_nan(spark):
    grid = Grid(lat0=1.0, lon0=0.0, dlat=-1.0, dlon=1.0, n_rows=2, n_cols=2)
    df = spark.sql("SELECT 'a' AS source, DATE '2020-01-01' AS date, 0 AS first_row, 0 AS first_col, 2 AS width,"
                   " array(1f, float('nan'), 3f, null) AS values")
    got = {(r.row, r.col): (r.lat, r.lon, r.value) for r in tiles.tiles_to_cells(df, grid).collect()}
    assert got == {(0, 0): (1.0, 0.0, 1.0), (0, 1): (1.0, 1.0, None), (1, 0): (0.0, 0.0, 3.0), (1, 1): (0.0, 1.0, None)}


def test_decoder_hook(spark, tmp_path):
    import struct

    (tmp_path / "rain_20200101.bin").write_bytes(struct.pack("<4f", 1, 2, 3, 4))
    (tmp_path / "rain_notaday.bin").write_bytes(b"")
    files = granules.list_files(spark, str(tmp_path), "*.bin")
    found = granules.granule_inventory(files).collect()
    assert [(r.source, r.date.isoformat(), r.length) for r in found] == [("rain", "2020-01-01", 16)]

    def decode(batches):
        import datetime as dt
        import numpy as np
        import pyarrow as pa
        from terracell.schema import TILE_SCHEMA
        from pyspark.sql.pandas.types import to_arrow_schema

        for b in batches:
            rows = [
                dict(source="rain", date=dt.date(2020, 1, 1), first_row=0, first_col=0, width=2,
                     values=np.frombuffer(c, "<f4").tolist())
                for c in b.column("content").to_pylist() if c
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(TILE_SCHEMA))

    raw = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    grid = Grid(lat0=1.0, lon0=0.0, dlat=-1.0, dlon=1.0, n_rows=2, n_cols=2)
    got = tiles.tiles_to_cells(tiles.decode_tiles(raw, decode), grid)
    assert sorted(r.value for r in got.collect()) == [1.0, 2.0, 3.0, 4.0]


def test_last_per_day_with_many_copies(spark):
    many = spark.range(5000).select(
        F.lit("a").alias("source"), F.lit("2020-01-01").cast("date").alias("date"),
        F.lit(0).alias("row"), F.lit(0).alias("col"), (F.col("id") % 4999).alias("ts"),
        F.col("id").cast("float").alias("value"))
    got = append.last_per_day(many, order=("ts",)).collect()
    assert [(r.ts, r.value) for r in got] == [(4998, 4998.0)]


def test_accumulation_of_nothing_is_zero(spark):
    df = cells(spark, [("a", "2020-01-01", 0, 0, None), ("a", "2020-01-02", 0, 0, None),
                       ("a", "2020-01-01", 0, 1, 1.5), ("a", "2020-01-02", 0, 1, None)])
    got = {r.col: r.total for r in aggregates.accumulate(df, ("row", "col")).collect()}
    assert got == {0: 0.0, 1: 1.5}


def test_small_conform_steps(spark):
    df = spark.sql("SELECT 1D AS LAT, 359.5D AS lon, 2f AS rdp, 3f AS prmsl")
    df = conform.rename_drop(conform.standardize_dims(df), {"rdp": "precip"}, drop=("prmsl",), keep=("lat", "lon", "precip"))
    df = conform.add_time(df, "2020-02-29").withColumnRenamed("precip", "value")
    grid = Grid(lat0=0.0, lon0=-1.0, dlat=0.5, dlon=0.5, n_rows=5, n_cols=5)
    done = conform.tag_attrs(conform.conform_cells(df, grid, source="merge"), units="mm")
    r = done.first()
    assert (r.source, r.year, r.row, r.col, r.lon, r.value) == ("merge", 2020, 2, 1, -0.5, 2.0)
    assert done.schema["value"].metadata == {"crs": "EPSG:4326", "units": "mm"}
    assert conform.north_up(done, grid).first().row == 2
    with pytest.raises(ValueError):
        conform.pick_value(done, "wind", fuzzy=False)


def test_lists_fold_copies_and_split_by_tile(spark):
    copies = spark.range(3000).select(
        F.lit(1).alias("request_id"), F.lit("2020-01-01").cast("date").alias("date"), (F.col("id") % 2).alias("tile_id"),
        (F.col("id") % 2).cast("double").alias("latitude"), F.lit(0.0).alias("longitude"), F.lit(9.0).alias("precipitation_mm"))
    got = aggregates.exceedances_by_date(copies).collect()
    assert sorted((r.tile_id, len(r.points)) for r in got) == [(0, 1), (1, 1)]
    series = copies.withColumnRenamed("precipitation_mm", "value")
    one = aggregates.exceedance_list(series, ("request_id",)).first()
    assert one.n_exceedances == 1 and len(one.exceedances) == 1


def test_scan_variable(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT 'era5' AS source, DATE '2020-01-01' AS date, 1D AS lat, 2D AS lon, 3f AS temp_max").write.parquet(path)
    assert store.scan_variable(spark, path, "temp_max").first().value == 3.0
    assert store.scan_variable(spark, path, "temp") is None
