"""Ingest and streaming jobs: they write tables, and the result is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness.tables import (
    GRID,
    SQL_BANDS,
    TILE,
    cube,
    out,
    query,
    raw_cells,
    read,
    sites,
    source_of_flag,
    sql_cube,
    sql_raw,
    bands,
    SQL_GRANULES,
    SQL_SITES,
    SQL_SPINE,
    windows,
)
from terracell.functions import geo, values
from terracell.operators import append, calendar, conform, filters
from terracell.plans import ingest, vegetation
from terracell.schema import ERA5_LAG_DAYS, STUDY_AREA, BBox
from terracell.session import shared_dir
from terracell.sources import archive as store
from terracell.streaming import cell_stream, overdue_days, stream_append, stream_exceedances, track_gaps

BOX = BBox(west=-70.1, south=-30.3, east=-40.2, north=2.9)
_IN = "lat BETWEEN {s} AND {n} AND lon BETWEEN {w} AND {e}"
_CENTRE = _IN.format(s="-30.3", n="2.9", w="-70.1", e="-40.2")
_TOUCH = _IN.format(
    s="CAST(-30.3 AS DOUBLE) - 0.25", n="CAST(2.9 AS DOUBLE) + 0.25",
    w="CAST(-70.1 AS DOUBLE) - 0.25", e="CAST(-40.2 AS DOUBLE) + 0.25",
)


@query(
    "year_archive_counts",
    f"""SELECT source, CAST(year(d) AS BIGINT) AS year, count(*) AS n_cells, count(v) AS n_values,
        sum(CAST(v AS DOUBLE)) AS total FROM ({sql_cube(by_source=True, missing=True)}) k
        WHERE {_CENTRE} AND EXISTS (SELECT 1 FROM ({sql_cube(by_source=True, missing=True)}) x
          WHERE x.source = k.source AND x.d = k.d AND x.v IS NOT NULL)
        GROUP BY source, year(d)""",
)
def year_archive_counts(spark, sf_dir):
    path = shared_dir(spark, "years")
    raw = cube(spark, sf_dir, by_source=True, missing=True).select(
        "source", "date", "lat", F.col("lon").alias("longitude"), F.col("value").alias("rdp")
    )
    for _ in range(2):  # the second run replaces what the first wrote
        ingest.build_year_archive(raw, GRID, BOX, path, rename={"rdp": "precip"})
    return out(
        store.scan_archive(spark, path).groupBy("source", "year").agg(
            F.count("*").alias("n_cells"),
            F.count("value").alias("n_values"),
            F.sum(F.col("value").cast("double")).alias("total"),
        )
    )


@query(
    "write_daily",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, count(*) AS n_cells,
        sum(CAST(CASE WHEN month(d) = 3 THEN v + 1000 ELSE v END AS DOUBLE)) AS total
        FROM ({sql_cube(by_source=True)}) GROUP BY source, d""",
)
def write_daily(spark, sf_dir):
    """All days written, then some of them again: those are replaced, the rest stays."""
    path = shared_dir(spark, "daily")
    cells = cube(spark, sf_dir, by_source=True)
    store.write_daily(cells, path)
    again = cells.filter(F.month("date") == 3)
    store.write_daily(again.withColumn("value", F.col("value") + 1000), path)
    return out(
        store.scan_daily(spark, path).groupBy("source", "date").agg(
            F.count("*").alias("n_cells"), F.sum(F.col("value").cast("double")).alias("total")
        )
    )


_WANTED = f"""SELECT source, CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d
    FROM (SELECT DISTINCT source FROM ({sql_raw()}))"""


def _all_years(spark, sf_dir):
    day = lambda t: F.lit(t).cast("date")
    return raw_cells(spark, sf_dir).select("source").distinct().withColumns(
        {"start_date": day("1995-01-01"), "end_date": day("2001-12-31")}
    )


@query(
    "ingest_precipitation",
    f"""WITH k AS ({sql_cube(by_source=True, missing=True)}),
        before AS (SELECT DISTINCT source, d FROM k WHERE month(d) = 2 AND {_TOUCH}),
        made AS (SELECT source, d, count(*) AS n, sum(CAST(v AS DOUBLE)) AS t FROM k WHERE {_TOUCH}
                 GROUP BY source, d HAVING count(v) > 0)
        SELECT w.source, CAST(w.d AS VARCHAR) AS date,
          CASE WHEN b.d IS NOT NULL THEN 'skipped' WHEN m.d IS NOT NULL THEN 'created' ELSE 'error' END AS status
        FROM ({_WANTED}) w LEFT JOIN before b ON b.source = w.source AND b.d = w.d
        LEFT JOIN made m ON m.source = w.source AND m.d = w.d""",
)
def ingest_precipitation(spark, sf_dir):
    path, work = shared_dir(spark, "precipitation"), shared_dir(spark, "work")
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    february = cells.filter(F.month("date") == 2)
    store.write_daily(filters.clip_box(february, BOX, GRID), path)
    raw = cells.select(
        "source", F.col("date").alias("time"), F.col("lat").alias("latitude"),
        F.pmod("lon", F.lit(360.0)).alias("longitude"),
        F.coalesce(F.col("value"), F.lit(float("nan"))).alias("rdp"),
    )
    outcomes = ingest.ingest_precipitation(
        raw, _all_years(spark, sf_dir), GRID, BOX, path, work, f"{work}/index"
    )
    return out(outcomes)


@query(
    "ingest_temperature",
    f"""SELECT k.source, CAST(d AS VARCHAR) AS date, count(*) AS n_cells, min(CAST(v AS DOUBLE)) AS low,
        max(CAST(v AS DOUBLE)) AS high FROM (
          SELECT source, d, lat, lon, CAST(v + CAST(273.15 AS FLOAT) AS FLOAT) - CAST(273.15 AS FLOAT) AS v
          FROM ({sql_cube(by_source=True)})) k
        WHERE {_CENTRE} GROUP BY k.source, d""",
)
def ingest_temperature(spark, sf_dir):
    """Run twice: the second run finds nothing missing that can be filled."""
    daily, kept = shared_dir(spark, "t-daily"), shared_dir(spark, "t-archive")
    kelvin = (F.col("value") + F.lit(273.15).cast("float")).cast("float")
    raw = cube(spark, sf_dir, by_source=True).select(
        "source", F.col("date").cast("timestamp_ntz").alias("valid_time"),
        "lat", "lon", kelvin.alias("t2m"),
    )
    for _ in range(2):
        ingest.ingest_temperature(
            raw, _all_years(spark, sf_dir), "2m_temperature", GRID, BOX,
            daily, kept, shared_dir(spark, "work"),
        )
    return out(
        store.scan_archive(spark, kept).groupBy("source", "date").agg(
            F.count("*").alias("n_cells"),
            F.min(F.col("value").cast("double")).alias("low"),
            F.max(F.col("value").cast("double")).alias("high"),
        )
    )


_S2 = """SELECT o_orderkey AS scene_id, CAST(o_orderdate AS TIMESTAMP) + to_hours(o_orderkey % 24) AS ts,
    CAST(o_orderdate AS DATE) AS d, CAST(o_custkey % 100 AS DOUBLE) AS cloud,
    CAST(-75 + o_custkey % 40 AS DOUBLE) AS w FROM orders"""


@query(
    "ingest_vegetation",
    f"""WITH found AS (SELECT *, (d - DATE '1995-01-01') // 16 AS b FROM ({_S2})
          WHERE d BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' AND cloud < 60 AND w < -40.2 AND w + 1 > -70.1),
        picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY ts DESC, scene_id) AS k FROM found)),
        px AS (SELECT p.scene_id, p.ts, p.d, x.r, x.c, CASE WHEN nir IS NULL OR nir + red = 0 THEN NULL
            ELSE CAST(CAST(nir - red AS DOUBLE) / CAST(nir + red AS DOUBLE) AS FLOAT) END AS v
          FROM picked p JOIN ({SQL_BANDS}) x ON x.scene_id = p.scene_id WHERE nir IS NOT NULL),
        ok AS (SELECT * FROM px WHERE scene_id IN (SELECT scene_id FROM px WHERE v IS NOT NULL)),
        last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d, r, c ORDER BY ts DESC, scene_id DESC) AS k FROM ok) WHERE k = 1)
        SELECT CAST(d AS VARCHAR) AS date, r AS "row", CAST(c AS BIGINT) AS col, CAST(v AS DOUBLE) AS value FROM last""",
)
def ingest_vegetation(spark, sf_dir):
    daily, kept = shared_dir(spark, "v-daily"), shared_dir(spark, "v-archive")
    west = (F.lit(-75) + F.col("o_custkey") % 40).cast("double")
    bounds = F.struct(
        west.alias("west"), F.lit(-20.0).alias("south"),
        (west + 1).alias("east"), F.lit(-19.0).alias("north"),
    )
    catalog = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scene_id"),
        (
            F.col("o_orderdate").cast("date").cast("timestamp_ntz")
            + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
        ).alias("ts"),
        (F.col("o_custkey") % 100).cast("double").alias("cloud_cover"),
        bounds.alias("bounds"),
    )
    wanted = catalog.groupBy(F.lit("sentinel2").alias("source")).agg(
        F.trunc(F.min("ts"), "year").alias("start_date"),
        F.last_day(F.max("ts")).alias("end_date"),
    )
    picked = vegetation.scenes_of_batches(
        catalog, calendar.day_spine(wanted), BOX, cloud_below=60
    )
    both = bands(spark, sf_dir).select("scene_id", "row", "col", "lat", "lon", "nir", "red")
    scene = both.join(picked.select("scene_id"), "scene_id", "left_semi")
    index = vegetation.scene_ndvi(
        scene.withColumnRenamed("nir", "value"), scene.withColumnRenamed("red", "value"), GRID, 0.5, 0.5
    )
    vegetation.ingest_vegetation(
        index, picked, GRID, BBox(**STUDY_AREA), daily, kept, shared_dir(spark, "work")
    )
    return out(store.scan_archive(spark, kept).select("date", "row", "col", "value"))


def _line_stream(spark, sf_dir):
    """Line items as a stream of cells."""
    schema = read(spark, sf_dir, "lineitem").schema
    lines = cell_stream(spark, sf_dir, schema, glob="lineitem.parquet")
    cells = lines.select(
        source_of_flag().alias("source"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_partkey") % 83).cast("int").alias("row"),
        (F.col("l_orderkey") % 83).cast("int").alias("col"),
        F.col("l_quantity").cast("float").alias("value"),
    )
    placed = cells.withColumns({"lat": geo.lat_of("row", GRID), "lon": geo.lon_of("col", GRID)})
    return conform.with_keys(placed, GRID)


@query(
    "stream_append",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, r AS "row", c AS col, {TILE} AS tile_id,
        CAST(v AS DOUBLE) AS value FROM ({sql_cube(by_source=True)})""",
)
def append_stream(spark, sf_dir):
    """The same files run through twice, as after a lost checkpoint."""
    path = shared_dir(spark, "stream-archive")
    for _ in range(2):
        run = stream_append(_line_stream(spark, sf_dir), path, shared_dir(spark, "check"))
        run.awaitTermination()
    cells = store.scan_archive(spark, path)
    return out(cells.select("source", "date", "row", "col", "tile_id", "value"))


@query(
    "stream_exceedances",
    f"""SELECT s.id AS site_id, source, CAST(d AS VARCHAR) AS date, CAST(v AS DOUBLE) AS value
        FROM ({SQL_SITES}) s JOIN ({sql_raw()}) k ON k.r = s.id % 83 AND k.c = (s.id * 7) % 83
        AND s.id % 13 <> 12 AND v > 20 + s.id % 25""",
)
def exceedance_stream(spark, sf_dir):
    path = shared_dir(spark, "stream-hits")
    watched = sites(spark, sf_dir).withColumn("trigger", F.lit(20.0) + F.col("site_id") % 25)
    run = stream_exceedances(
        _line_stream(spark, sf_dir), watched, GRID, path, shared_dir(spark, "check")
    )
    run.awaitTermination()
    return out(spark.read.parquet(path).select("site_id", "source", "date", "value"))


@query(
    "stream_gaps",
    f"""SELECT w.source, CAST(w.d AS VARCHAR) AS date FROM ({SQL_SPINE}) w
        LEFT JOIN ({SQL_GRANULES}) g ON g.source = w.source AND g.d = w.d
        WHERE g.d IS NULL AND CAST(w.d + {ERA5_LAG_DAYS} AS TIMESTAMP)
          < (SELECT max(CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_orderkey % 11 AS INTEGER))) FROM orders)""",
)
def gap_stream(spark, sf_dir):
    """Orders as files that arrive up to ten days late, in two runs of one stream: days of
    the first that were overdue and came in the second are taken back."""
    inbox, changes, check = (shared_dir(spark, n) for n in ("gap-in", "gap-out", "check"))
    key = F.col("o_orderkey")
    arrivals = read(spark, sf_dir, "orders").select(
        F.when(key % 2 == 0, "chirps").otherwise("merge").alias("source"),
        F.col("o_orderdate").cast("date").alias("date"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(days=(key % 11).cast("int"))).alias("arrived_at"),
    )
    wanted = windows(spark, sf_dir).withColumn("lag_days", F.lit(ERA5_LAG_DAYS))
    first = F.col("arrived_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    for part in (arrivals.filter(first), arrivals.filter(~first)):
        part.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(arrivals.schema).parquet(inbox)
        track_gaps(stream, wanted, changes, check).awaitTermination()
    written = spark.read.schema("source string, date date, change int").parquet(changes)
    return out(overdue_days(written))
