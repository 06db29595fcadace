"""Tables kept beside the archive: extrema of tiles and days, running sums, pyramids."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from harness.points import SQL_AREA_POINTS
from harness.tables import GRID, cube, out, point_requests, query, read, sql_cube
from terracell.functions import values
from terracell.operators import conform
from terracell.plans import areas
from terracell.schema import STUDY_AREA, BBox
from terracell.session import shared_dir
from terracell.sources import archive as store, pyramid, running, tiledays

_SPLIT = "1997-03-10"


def _in_two_writes(spark, sf_dir, path, summarise=False):
    """The archive, summed up after the first write only."""
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    store.write_archive(cells.filter(F.col("date") < _SPLIT), path, summarise=summarise)
    rest = cells.filter(F.col("date") >= _SPLIT)
    store.write_archive(rest, path)
    return rest.select("source", "date").distinct()


@query("area_triggers_by_extrema", SQL_AREA_POINTS)
def area_triggers_by_extrema(spark, sf_dir):
    """Area requests that open only tiles and days which can exceed."""
    path = shared_dir(spark, "extrema")
    _in_two_writes(spark, sf_dir, path, summarise=True)
    summary = tiledays.scan_tile_days(spark, path)
    hits = areas.area_triggers(
        store.scan_archive(spark, path), point_requests(spark, sf_dir), GRID, tile_days=summary
    )
    return out(hits.drop("tile_id"))


@query("area_triggers_in_place", SQL_AREA_POINTS)
def area_triggers_in_place(spark, sf_dir):
    """Area requests that move to an archive bucketed by what they are joined on."""
    path = shared_dir(spark, "bucketed")
    table = os.path.basename(path).replace("-", "_")
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    store.write_archive_table(cells, table, 16, keys=store.REQUEST_KEYS, path=path)
    return out(areas.area_triggers(spark.table(table), point_requests(spark, sf_dir), GRID).drop("tile_id"))


@query(
    "tile_day_extrema",
    f"""SELECT source, CAST(year(d) AS BIGINT) AS year, CAST((r // 20) * 5 + c // 20 AS BIGINT) AS tile_id,
        CAST(d AS VARCHAR) AS date, CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high,
        count(v) AS n_values, count(*) AS n_cells
        FROM ({sql_cube(by_source=True, missing=True)}) GROUP BY ALL""",
)
def tile_day_extrema(spark, sf_dir):
    """The summary after an append that it was told of and one that it was not."""
    path = shared_dir(spark, "extrema")
    _in_two_writes(spark, sf_dir, path, summarise=True)
    return out(tiledays.scan_tile_days(spark, path))


_DAYS_SQL = """SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'chirps' WHEN 1 THEN 'merge' ELSE 'temp' END AS source,
    DATE '1994-06-01' + CAST(s_suppkey * 37 % 1500 AS INTEGER) + i AS d
    FROM (SELECT *, CAST(unnest(range(20 + s_suppkey % 400)) AS INTEGER) AS i FROM supplier)
    WHERE s_suppkey % 2 = 0 OR i % 50 <> 7"""


@query(
    "event_sums",
    f"""SELECT e.id AS event_id, k.source, k.r AS "row", k.c AS col, coalesce(sum(CAST(v AS DOUBLE)), 0) AS total
        FROM ({_DAYS_SQL}) e JOIN ({sql_cube(by_source=True, missing=True)}) k ON k.source = e.source AND k.d = e.d
        GROUP BY ALL""",
)
def event_sums(spark, sf_dir):
    """An event per supplier, of 20 to 419 days, half of them with gaps, from running sums
    that an append has extended."""
    path, sums = shared_dir(spark, "summed"), shared_dir(spark, "carries")
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    store.write_archive(cells.filter(F.col("date") < _SPLIT), path)
    running.write_carries(store.scan_archive(spark, path), sums)
    rest = cells.filter(F.col("date") >= _SPLIT)
    store.write_archive(rest, path)
    archive = store.scan_archive(spark, path)
    running.write_carries(archive, sums, rest.select("source", "date"))
    key = F.col("s_suppkey")
    first = F.date_add(F.lit("1994-06-01").cast("date"), (key * 37 % 1500).cast("int"))
    count = (F.lit(20) + key % 400).cast("int")
    kept = F.filter(F.sequence(F.lit(0), count - 1), lambda i: (key % 2 == 0) | (i % 50 != 7))
    events = read(spark, sf_dir, "supplier").select(
        key.alias("event_id"),
        F.when(key % 3 == 0, "chirps").when(key % 3 == 1, "merge").otherwise("temp").alias("source"),
        F.transform(kept, lambda i: F.date_add(first, i)).alias("days"),
    )
    return out(running.event_sums(archive, running.scan_carries(spark, sums), running.event_intervals(events)))


_BLOCKS = f"""SELECT source, d, r // 8 AS r, c // 8 AS c, CAST(avg(CAST(v AS DOUBLE)) AS FLOAT) AS v
    FROM ({sql_cube(by_source=True, missing=True)}) GROUP BY source, d, r // 8, c // 8"""
_MIDDLE = "{s} + CAST(0.5 AS DOUBLE) * (({i} * 8 + least({i} * 8 + 7, 82)) / 2.0::DOUBLE)"
_COARSE = f"""SELECT *, least(CAST(trunc(px) AS INTEGER), 9) AS x, least(CAST(trunc(py) AS INTEGER), 9) AS y FROM (
    SELECT *, (lon + 75) / 41.5::DOUBLE * 10 AS px, (6.5::DOUBLE - lat) / 41.5::DOUBLE * 10 AS py FROM (
    SELECT *, {_MIDDLE.format(s="CAST(-35.0 AS DOUBLE)", i="r")} AS lat, {_MIDDLE.format(s="CAST(-75.0 AS DOUBLE)", i="c")} AS lon
    FROM ({_BLOCKS})))"""


@query(
    "view_from_pyramid",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y,
        coalesce(CAST(v AS DOUBLE), -9999) AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY source, d, x, y ORDER BY pow(px - x - 0.5::DOUBLE, 2) + pow(py - y - 0.5::DOUBLE, 2), r, c) AS n
        FROM ({_COARSE})) WHERE n = 1 AND d BETWEEN DATE '1998-04-01' AND DATE '1998-04-30'""",
)
def view_from_pyramid(spark, sf_dir):
    """The whole area in ten by ten pixels: means over eight by eight cells are read."""
    path = shared_dir(spark, "pyramid")
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    month = cells.filter(F.col("date").between("1998-04-01", "1998-04-30"))
    pyramid.write_pyramid(month, path, 4, GRID)
    seen = pyramid.view(cells, path, 4, GRID, BBox(**STUDY_AREA), 10, 10, "1998-04-01", "1998-04-30")
    return out(seen.withColumn("value", values.missing_to_sentinel("value")))


@query(
    "replace_days",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, count(*) AS n_cells, count(v) AS n_values,
        sum(CAST(CASE WHEN month(d) = 3 THEN v + 1000 ELSE v END AS DOUBLE)) AS total
        FROM ({sql_cube(by_source=True, missing=True)}) GROUP BY source, d""",
)
def replace_days(spark, sf_dir):
    """All days written, then those of March again: the other days of a year stay."""
    path = shared_dir(spark, "replaced")
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    store.replace_days(cells, path)
    march = cells.filter(F.month("date") == 3)
    store.replace_days(march.withColumn("value", F.col("value") + 1000), path)
    return out(
        store.scan_archive(spark, path).groupBy("source", "date").agg(
            F.count("*").alias("n_cells"),
            F.count("value").alias("n_values"),
            F.sum(F.col("value").cast("double")).alias("total"),
        )
    )


@query(
    "scan_variable",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, r AS "row", c AS col, CAST(v + 1 AS DOUBLE) AS value
        FROM ({sql_cube(by_source=True)})""",
)
def scan_variable(spark, sf_dir):
    """One variable of a table that has two."""
    path = shared_dir(spark, "variables")
    cells = cube(spark, sf_dir, by_source=True).withColumn("t2m", F.col("value") + 1)
    cells.withColumnRenamed("value", "rain").write.parquet(path)
    return out(store.scan_variable(spark, path, "t2m").select("source", "date", "row", "col", "value"))


@query(
    "add_time",
    f"""SELECT '2001-02-03' AS date, r AS "row", c AS col, CAST(max(v) AS DOUBLE) AS value
        FROM ({sql_cube()}) GROUP BY r, c""",
)
def add_time(spark, sf_dir):
    """A raster without a day gets one."""
    raster = cube(spark, sf_dir).groupBy("row", "col").agg(F.max("value").alias("value"))
    return out(conform.add_time(raster, "2001-02-03"))
