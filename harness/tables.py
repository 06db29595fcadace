"""Climate tables from the driver tables, in Spark and as SQL fragments.

A cell is (l_partkey % 83, l_orderkey % 83) on an 83 x 83 grid of half a degree over
the study area; its value is the largest l_quantity of the day, 50 meaning missing
where a query says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terracell.functions import geo
from terracell.operators.conform import with_keys
from terracell.schema import Grid

N = 83
GRID = Grid(lat0=-35.0, lon0=-75.0, dlat=0.5, dlon=0.5, n_rows=N, n_cols=N)
KNOWN = ("chirps", "merge", "temp")

REGISTRY: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with the SQL that checks it."""

    def add(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def out(df: DataFrame) -> DataFrame:
    """Plain output types: days as text, 64-bit numbers, flags as 0/1."""
    plain = {"date": "string", "float": "double", "int": "bigint", "boolean": "bigint"}
    return df.select(
        *[
            F.col(f"`{n}`").cast(plain[t]).alias(n) if t in plain else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def source_of_flag():
    flag = F.col("l_returnflag")
    return F.when(flag == "A", "chirps").when(flag == "N", "merge").otherwise("temp")


def raw_cells(spark: SparkSession, sf_dir: str, missing: bool = False) -> DataFrame:
    """A row per line item: source, day, cell, value; several rows may share a cell."""
    value = F.col("l_quantity")
    if missing:
        value = F.nullif(value, F.lit(50.0))
    return read(spark, sf_dir, "lineitem").select(
        source_of_flag().alias("source"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_partkey") % N).cast("int").alias("row"),
        (F.col("l_orderkey") % N).cast("int").alias("col"),
        value.cast("float").alias("value"),
    )


def cube(
    spark: SparkSession, sf_dir: str, by_source: bool = False, missing: bool = False
) -> DataFrame:
    """Canonical cells, of one source (``chirps``) or of three."""
    cells = raw_cells(spark, sf_dir, missing)
    if not by_source:
        cells = cells.withColumn("source", F.lit("chirps"))
    cells = cells.groupBy("source", "date", "row", "col").agg(F.max("value").alias("value"))
    cells = cells.withColumns({"lat": geo.lat_of("row", GRID), "lon": geo.lon_of("col", GRID)})
    return with_keys(cells, GRID)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, 0.02 degrees off their cell; every 13th out of tolerance."""
    key = F.col("s_suppkey")
    off = F.when(key % 13 == 12, F.lit(0.2)).otherwise(F.lit(0.02))
    return read(spark, sf_dir, "supplier").select(
        key.alias("site_id"),
        (F.lit(-35.0) + F.lit(0.5) * (key % N) + off).alias("lat"),
        (F.lit(-75.0) + F.lit(0.5) * ((key * 7) % N) - F.lit(0.02)).alias("lon"),
    )


def point_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per supplier; every tenth has its period the wrong way round."""
    key = F.col("site_id")
    wrong = key % 10 == 9
    return sites(spark, sf_dir).select(
        key.alias("request_id"),
        F.when(key % 2 == 0, "chirps").otherwise("merge").alias("source"),
        "lat",
        "lon",
        F.when(wrong, "2001-01-01").otherwise("1996-01-01").alias("start_date"),
        F.when(wrong, "1996-01-01").otherwise("2000-12-31").alias("end_date"),
        (F.lit(20.0) + key % 25).alias("trigger"),
        (F.lit(80.0) + (key % 5) * 30).alias("radius"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scenes: one degree squares, the value as cloud cover."""
    u = F.col("user_id") % 40
    west, south = F.lit(-75.0) + u, F.lit(-34.75) + (F.col("user_id") * 3) % 40
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("scene_id"),
        "ts",
        F.col("value").alias("cloud_cover"),
        F.struct(
            west.alias("west"),
            south.alias("south"),
            (west + 1.0).alias("east"),
            (south + 1.0).alias("north"),
        ).alias("bounds"),
    )


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of two bands; the order is the scene."""
    li = read(spark, sf_dir, "lineitem")
    return (
        li.groupBy(
            F.col("l_orderkey").alias("scene_id"),
            (F.col("l_partkey") % N).cast("int").alias("row"),
            F.col("l_linenumber").cast("int").alias("col"),
        )
        .agg(
            F.max(F.nullif(F.col("l_quantity"), F.lit(50.0))).cast("float").alias("nir"),
            F.max(F.col("l_linenumber")).cast("float").alias("red"),
        )
        .withColumns({"lat": geo.lat_of("row", GRID), "lon": geo.lon_of("col", GRID)})
    )


def granule_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raster files, named in five ways, two of them without a real day."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    path = (
        F.when(key % 5 == 0, F.concat(F.lit("chirps_"), day, F.lit(".tif")))
        .when(key % 5 == 1, F.concat(F.lit("chirps_final_latam_"), day, F.lit(".tif")))
        .when(key % 5 == 2, F.concat(F.lit("merge_"), day, F.lit("_x20260101.tif")))
        .when(key % 5 == 3, F.concat(F.lit("merge_"), F.substring(day, 1, 4), F.lit("1399.tif")))
        .otherwise(F.concat(F.lit("temp_"), F.substring(day, 1, 6), F.lit(".tif")))
    )
    return read(spark, sf_dir, "orders").select(key.alias("granule_id"), path.alias("path"))


def granule_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with a raster file, of two sources."""
    return read(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, "chirps").otherwise("merge").alias("source"),
        F.col("o_orderdate").cast("date").alias("date"),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted period of each source that has cells."""
    return (
        raw_cells(spark, sf_dir)
        .groupBy("source")
        .agg(
            F.trunc(F.min("date"), "year").alias("start_date"),
            F.last_day(F.max("date")).alias("end_date"),
        )
    )


# ---------------------------------------------------------------- SQL fragments

_LAT = "CAST(-35.0 AS DOUBLE) + CAST(0.5 AS DOUBLE) * {r}"
_LON = "CAST(-75.0 AS DOUBLE) + CAST(0.5 AS DOUBLE) * {c}"
LAT_R, LON_C = _LAT.format(r="r"), _LON.format(c="c")
SOURCE = "CASE l_returnflag WHEN 'A' THEN 'chirps' WHEN 'N' THEN 'merge' ELSE 'temp' END"
TILE = "CAST((r // 20) * 5 + c // 20 AS BIGINT)"


def sql_raw(missing: bool = False, by_source: bool = True) -> str:
    value = "nullif(l_quantity, 50)" if missing else "l_quantity"
    source = SOURCE if by_source else "'chirps'"
    return (
        f"SELECT {source} AS source, CAST(l_shipdate AS DATE) AS d,"
        " l_partkey % 83 AS r, l_orderkey % 83 AS c,"
        f" CAST({value} AS FLOAT) AS v FROM lineitem"
    )


def sql_cube(by_source: bool = False, missing: bool = False) -> str:
    """Body of a CTE with source, d, r, c, lat, lon, v."""
    return (
        f"SELECT source, d, r, c, {LAT_R} AS lat, {LON_C} AS lon, max(v) AS v"
        f" FROM ({sql_raw(missing, by_source)}) GROUP BY source, d, r, c"
    )


SQL_SITES = (
    "SELECT s_suppkey AS id,"
    " CAST(-35.0 AS DOUBLE) + CAST(0.5 AS DOUBLE) * (s_suppkey % 83)"
    " + CASE WHEN s_suppkey % 13 = 12 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.02 AS DOUBLE) END AS slat,"
    " CAST(-75.0 AS DOUBLE) + CAST(0.5 AS DOUBLE) * ((s_suppkey * 7) % 83)"
    " - CAST(0.02 AS DOUBLE) AS slon FROM supplier"
)
SQL_REQUESTS = (
    "SELECT id, slat, slon, CASE WHEN id % 2 = 0 THEN 'chirps' ELSE 'merge' END AS source,"
    " id % 10 = 9 AS wrong, DATE '1996-01-01' AS d1, DATE '2000-12-31' AS d2,"
    " CAST(20 + id % 25 AS FLOAT) AS trig, CAST(80 + (id % 5) * 30 AS DOUBLE) AS radius,"
    " id % 13 <> 12 AS near, id % 83 AS sr, (id * 7) % 83 AS sc"
    f" FROM ({SQL_SITES})"
)
SQL_SCENES = (
    "SELECT event_id AS scene_id, ts, value AS cloud,"
    " CAST(-75 + user_id % 40 AS DOUBLE) AS w,"
    " CAST(-34.75 AS DOUBLE) + (user_id * 3) % 40 AS s,"
    " CAST(-75 + user_id % 40 AS DOUBLE) + 1 AS e,"
    " CAST(-34.75 AS DOUBLE) + (user_id * 3) % 40 + 1 AS n FROM events"
)
SQL_BANDS = (
    "SELECT l_orderkey AS scene_id, l_partkey % 83 AS r, l_linenumber AS c,"
    " CAST(max(nullif(l_quantity, 50)) AS FLOAT) AS nir, CAST(max(l_linenumber) AS FLOAT) AS red"
    " FROM lineitem GROUP BY ALL"
)
SQL_PATHS = (
    "SELECT o_orderkey AS granule_id, CASE o_orderkey % 5"
    " WHEN 0 THEN 'chirps_' || strftime(o_orderdate, '%Y%m%d') || '.tif'"
    " WHEN 1 THEN 'chirps_final_latam_' || strftime(o_orderdate, '%Y%m%d') || '.tif'"
    " WHEN 2 THEN 'merge_' || strftime(o_orderdate, '%Y%m%d') || '_x20260101.tif'"
    " WHEN 3 THEN 'merge_' || strftime(o_orderdate, '%Y') || '1399.tif'"
    " ELSE 'temp_' || strftime(o_orderdate, '%Y%m') || '.tif' END AS path FROM orders"
)
SQL_GRANULES = (
    "SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'chirps' ELSE 'merge' END AS source,"
    " CAST(o_orderdate AS DATE) AS d FROM orders"
)
SQL_WINDOWS = (
    "SELECT source, CAST(date_trunc('year', min(d)) AS DATE) AS d1, last_day(max(d)) AS d2"
    f" FROM ({sql_raw()}) GROUP BY source"
)
SQL_SPINE = (
    "SELECT source, CAST(unnest(generate_series(d1, d2, INTERVAL 1 DAY)) AS DATE) AS d"
    f" FROM ({SQL_WINDOWS})"
)
SQL_MISSING = (
    "SELECT w.source, w.d, g.d IS NULL AS mg, a.d IS NULL AS ma"
    f" FROM ({SQL_SPINE}) w"
    f" LEFT JOIN ({SQL_GRANULES}) g ON g.source = w.source AND g.d = w.d"
    f" LEFT JOIN (SELECT DISTINCT source, d FROM ({sql_raw()})) a"
    " ON a.source = w.source AND a.d = w.d WHERE g.d IS NULL OR a.d IS NULL"
)
SQL_ISLANDS = (
    "SELECT source, min(d) AS d1, max(d) AS d2, count(*) AS n FROM ("
    "SELECT source, d, d - CAST(row_number() OVER (PARTITION BY source ORDER BY d) AS INTEGER) AS k"
    f" FROM ({SQL_MISSING})) GROUP BY source, k"
)


def sql_batches(n: int) -> str:
    return (
        f"SELECT source, b AS d1, least(b + {n - 1}, d2) AS d2 FROM ("
        f"SELECT source, d2, CAST(unnest(generate_series(d1, d2, INTERVAL {n} DAY)) AS DATE) AS b"
        f" FROM ({SQL_ISLANDS}))"
    )


def sql_haversine(lat1, lon1, lat2, lon2) -> str:
    return (
        f"(2 * 6371.0::DOUBLE * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"
    )


def sql_inside(lat, lon, clat, clon, radius) -> str:
    half = f"({radius}) / CAST(111.32 AS DOUBLE)"
    return (
        f"({lat} BETWEEN {clat} - {half} AND {clat} + {half}"
        f" AND {lon} BETWEEN {clon} - {half} AND {clon} + {half}"
        f" AND {sql_haversine(clat, clon, lat, lon)} <= {radius})"
    )
