"""Point and area queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness.tables import (
    GRID,
    LAT_R,
    LON_C,
    SQL_REQUESTS,
    SQL_SITES,
    cube,
    out,
    point_requests,
    query,
    read,
    sites,
    sql_cube,
    sql_haversine,
    sql_inside,
)
from terracell.functions import geo, values
from terracell.functions.requests import json_pixel_value, request_status
from terracell.operators import aggregates, append, filters, lookup
from terracell.plans import answers, areas, points
from terracell.sources.requests import answer_json, requests_from_json
from terracell.schema import STUDY_AREA, TRIGGER_REQUEST, BBox

BOX = BBox(**STUDY_AREA)
ONE_AREA = dict(lat=-2.5, lon=-69.0, radius_km=500.0, start="1995-01-01", end="2001-12-31", trigger=30.0)
_IN_ONE = sql_inside("lat", "lon", "CAST(-2.5 AS DOUBLE)", "CAST(-69.0 AS DOUBLE)", "CAST(500 AS DOUBLE)")


def one_area(spark, sf_dir):
    return areas.area_exceedances(cube(spark, sf_dir), GRID, source="chirps", **ONE_AREA)


@query(
    "area_triggers_by_date",
    f"""SELECT CAST(d AS VARCHAR) AS date, count(*) AS n_points,
        min(CAST(v AS DOUBLE)) AS min_mm, max(CAST(v AS DOUBLE)) AS max_mm,
        sum(CAST(v AS DOUBLE)) AS sum_mm
        FROM ({sql_cube()}) WHERE v > 30 AND {_IN_ONE} GROUP BY d""",
)
def area_triggers_by_date(spark, sf_dir):
    by_day = one_area(spark, sf_dir).groupBy("date").agg(
        F.count("*").alias("n_points"),
        F.min("precipitation_mm").alias("min_mm"),
        F.max("precipitation_mm").alias("max_mm"),
        F.sum("precipitation_mm").alias("sum_mm"),
    )
    return out(by_day)


@query(
    "exceedances_by_date_lists",
    f"""SELECT CAST(d AS VARCHAR) AS date, round_even(lat, 5) AS latitude,
        round_even(lon, 5) AS longitude, round_even(CAST(v AS DOUBLE), 2) AS precipitation_mm
        FROM ({sql_cube()}) WHERE v > 30 AND {_IN_ONE}""",
)
def exceedances_by_date_lists(spark, sf_dir):
    hits = one_area(spark, sf_dir).withColumn("request_id", F.lit(1))
    lists = aggregates.exceedances_by_date(hits)
    return out(lists.select("date", F.inline("points")))


SQL_AREA_POINTS = f"""SELECT q.id AS request_id, CAST(k.d AS VARCHAR) AS date, round_even(lat, 5) AS latitude,
        round_even(lon, 5) AS longitude, round_even(CAST(v AS DOUBLE), 2) AS precipitation_mm
        FROM ({SQL_REQUESTS}) q JOIN ({sql_cube(by_source=True, missing=True)}) k
        ON k.source = q.source AND NOT wrong AND k.d BETWEEN d1 AND d2 AND v > trig
        AND {sql_inside("lat", "lon", "slat", "slon", "radius")}"""


@query("area_trigger_points", SQL_AREA_POINTS)
def area_trigger_points(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    hits = areas.area_triggers(cells, point_requests(spark, sf_dir), GRID)
    return out(hits.drop("tile_id"))


@query(
    "area_trigger_totals",
    f"""SELECT q.id AS request_id, CASE WHEN any_value(wrong) THEN 'bad_range' ELSE 'ok' END AS status,
        count(v) AS total_exceedances, count(DISTINCT k.d) AS total_trigger_dates
        FROM ({SQL_REQUESTS}) q LEFT JOIN ({sql_cube(by_source=True, missing=True)}) k
        ON k.source = q.source AND NOT wrong AND k.d BETWEEN d1 AND d2 AND v > trig
        AND {sql_inside("lat", "lon", "slat", "slon", "radius")} GROUP BY q.id""",
)
def area_trigger_totals(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    requests = point_requests(spark, sf_dir)
    hits = areas.area_triggers(cells, requests, GRID)
    totals = areas.area_answers(requests, hits)
    return out(totals.select("request_id", "status", "total_exceedances", "total_trigger_dates"))


_SERIES = f"""({SQL_REQUESTS}) q JOIN ({sql_cube(by_source=True, missing=True)}) k
    ON k.source = q.source AND NOT wrong AND near AND k.r = sr AND k.c = sc AND k.d BETWEEN d1 AND d2"""


@query(
    "point_history",
    f"""SELECT q.id AS request_id, CAST(k.d AS VARCHAR) AS date,
        coalesce(round_even(CAST(v AS DOUBLE), 2), -9999) AS value FROM {_SERIES}""",
)
def point_history(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    rows = points.history_rows(cells, point_requests(spark, sf_dir), GRID)
    return out(rows.withColumn("value", values.missing_to_sentinel("value")))


@query(
    "history_map",
    f"""SELECT q.id AS request_id,
        CASE WHEN any_value(wrong) THEN 'bad_range' WHEN any_value(near) THEN 'ok' ELSE 'no_cell' END AS status,
        count(k.d) AS n_days, coalesce(CAST(min(k.d) AS VARCHAR), '') AS first_day,
        count(v) AS n_values, coalesce(sum(CAST(v AS DOUBLE)), 0) AS total
        FROM ({SQL_REQUESTS}) q LEFT JOIN ({sql_cube(by_source=True, missing=True)}) k
        ON k.source = q.source AND NOT wrong AND near AND k.r = sr AND k.c = sc
        AND k.d BETWEEN d1 AND d2 GROUP BY q.id""",
)
def history_map(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    histories = points.point_history(cells, point_requests(spark, sf_dir), GRID)
    values_of = F.map_values("history")
    known = F.filter(values_of, lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    first = F.coalesce(F.array_min(F.map_keys("history")), F.lit(""))
    return out(
        histories.select(
            "request_id",
            "status",
            F.size(values_of).alias("n_days"),
            first.alias("first_day"),
            F.size(known).alias("n_values"),
            total.alias("total"),
        )
    )


@query(
    "point_triggers",
    f"""SELECT q.id AS request_id, CAST(k.d AS VARCHAR) AS date,
        round_even(CAST(v AS DOUBLE), 2) AS value FROM {_SERIES} WHERE v > trig""",
)
def point_triggers(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    found = points.point_triggers(cells, point_requests(spark, sf_dir), GRID)
    return out(points.trigger_rows(found, "request_id"))


@query(
    "n_exceedances",
    f"""SELECT q.id AS request_id, count(CASE WHEN v > trig THEN 1 END) AS n_exceedances FROM {_SERIES} GROUP BY q.id""",
)
def n_exceedances(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    requests = point_requests(spark, sf_dir).filter("start_date <= end_date")
    typed = requests.withColumns(
        {c: F.col(c).cast("date") for c in ("start_date", "end_date")}
    )
    series = lookup.point_lookup(cells, typed, GRID)
    return out(aggregates.exceedance_counts(series, ("request_id",)))


@query(
    "site_batch_triggers",
    f"""SELECT s.id AS request_id, CASE WHEN s.id % 13 = 12 THEN 'no_cell' ELSE 'ok' END AS status,
        count(v) AS n_exceedances
        FROM ({SQL_SITES}) s LEFT JOIN ({sql_cube()}) k
        ON k.r = s.id % 83 AND k.c = (s.id * 7) % 83 AND s.id % 13 <> 12 AND v > 25
        AND d BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' GROUP BY s.id""",
)
def site_batch_triggers(spark, sf_dir):
    found = points.site_batch_triggers(
        cube(spark, sf_dir), sites(spark, sf_dir), GRID, "chirps", "1995-01-01", "2001-12-31", 25
    )
    return out(found.select("request_id", "status", "n_exceedances"))


@query(
    "single_site_series",
    f"""SELECT CAST(d AS VARCHAR) AS date, CAST(v AS DOUBLE) AS value FROM ({sql_cube()})
        WHERE r = 40 AND c = 11 AND d BETWEEN DATE '1995-06-01' AND DATE '2001-06-30'""",
)
def single_site_series(spark, sf_dir):
    series = points.site_series(
        cube(spark, sf_dir), GRID, -15.03, -69.52, "1995-06-01", "2001-06-30", "chirps"
    )
    return out(series.select("date", "value"))


@query(
    "point_lookup_irregular",
    f"""SELECT s.id AS site_id, CAST(d AS VARCHAR) AS date, CAST(v AS DOUBLE) AS value
        FROM ({SQL_SITES}) s JOIN ({sql_cube()}) k
        ON k.r = s.id % 83 AND k.c = (s.id * 7) % 83 AND s.id % 13 <> 12""",
)
def point_lookup_irregular(spark, sf_dir):
    series = lookup.point_lookup_irregular(cube(spark, sf_dir), sites(spark, sf_dir))
    return out(series.select("site_id", "date", "value"))


_PIXEL = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN 'unknown' ELSE 'chirps' END AS source,
    o_orderkey % 19 = 0 AS bad, CAST(o_orderdate AS DATE) AS d,
    CAST(-34.9 AS DOUBLE) + CAST(0.5 AS DOUBLE) * (o_custkey % 83) AS qlat,
    CAST(-74.9 AS DOUBLE) + CAST(0.5 AS DOUBLE) * (o_orderkey % 83) AS qlon FROM orders"""
_PIXEL_XY = f"""SELECT *,
    CAST(trunc((qlon - CAST(-75.0 AS DOUBLE)) / CAST(41.5 AS DOUBLE) * 1200) AS INTEGER) AS x,
    CAST(trunc((CAST(6.5 AS DOUBLE) - qlat) / CAST(41.5 AS DOUBLE) * 1560) AS INTEGER) AS y FROM ({_PIXEL})"""
_PIXEL_CELL = f"""SELECT *,
    CAST(-75.0 AS DOUBLE) + (x + CAST(0.5 AS DOUBLE)) / 1200 * CAST(41.5 AS DOUBLE) AS plon,
    CAST(6.5 AS DOUBLE) - (y + CAST(0.5 AS DOUBLE)) / 1560 * CAST(41.5 AS DOUBLE) AS plat FROM ({_PIXEL_XY})"""


@query(
    "pixel_value",
    f"""SELECT id AS request_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y,
        CASE WHEN bad THEN 'bad_date' WHEN p.source = 'unknown' THEN 'unknown_source'
             WHEN v IS NULL THEN 'no_data' ELSE 'ok' END AS status,
        coalesce(round_even(CAST(v AS DOUBLE), 2), -9999) AS value
        FROM ({_PIXEL_CELL}) p LEFT JOIN ({sql_cube(missing=True)}) k
        ON k.d = p.d AND NOT bad AND p.source = 'chirps'
        AND k.r = floor((plat + 35) / CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE))
        AND k.c = floor((plon + 75) / CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE))""",
)
def pixel_value(spark, sf_dir):
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    requests = read(spark, sf_dir, "orders").select(
        key.alias("request_id"),
        F.when(key % 17 == 0, "unknown").otherwise("chirps").alias("source"),
        F.when(key % 19 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(day).alias("date"),
        (F.lit(-34.9) + F.lit(0.5) * (F.col("o_custkey") % 83)).alias("lat"),
        (F.lit(-74.9) + F.lit(0.5) * (key % 83)).alias("lon"),
        F.lit(1200).alias("width"),
        F.lit(1560).alias("height"),
    )
    found = points.pixel_value(cube(spark, sf_dir, missing=True), requests, GRID)
    found = found.withColumn("value", values.missing_to_sentinel("value"))
    return out(found.select("request_id", "x", "y", "status", "value"))


@query(
    "radius_join",
    f"""SELECT s.id AS site_id, count(*) AS n_cells, count(v) AS n_values,
        sum(CAST(v AS DOUBLE)) AS total
        FROM ({SQL_SITES}) s JOIN ({sql_cube()}) k
        ON {sql_inside("lat", "lon", "slat", "slon", "CAST(150 AS DOUBLE)")} GROUP BY s.id""",
)
def radius_join(spark, sf_dir):
    wide = sites(spark, sf_dir).withColumn("radius", F.lit(150.0))
    near = lookup.radius_join(aggregates.place_totals(cube(spark, sf_dir)), wide, GRID)
    return out(aggregates.site_totals(near))


@query(
    "haversine_distance",
    f"""SELECT c_custkey AS site_id, round({sql_haversine("lat", "lon", "CAST(-2.5 AS DOUBLE)", "CAST(-69.0 AS DOUBLE)")}, 6) AS km
        FROM (SELECT c_custkey, CAST(-35.0 AS DOUBLE) + (c_custkey % 400) / CAST(10 AS DOUBLE) AS lat,
              CAST(-75.0 AS DOUBLE) + (c_custkey % 410) / CAST(10 AS DOUBLE) AS lon FROM customer)""",
)
def haversine_distance(spark, sf_dir):
    km = geo.haversine_km("lat", "lon", F.lit(-2.5), F.lit(-69.0))
    return out(_customers(spark, sf_dir).select("site_id", F.round(km, 6).alias("km")))


def _customers(spark, sf_dir):
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        key.alias("site_id"),
        (F.lit(-35.0) + (key % 400) / F.lit(10.0)).alias("lat"),
        (F.lit(-75.0) + (key % 410) / F.lit(10.0)).alias("lon"),
        (F.lit(10.0) + key % 300).alias("radius"),
    )


_CUSTOMERS = """SELECT c_custkey, CAST(-35.0 AS DOUBLE) + (c_custkey % 400) / CAST(10 AS DOUBLE) AS lat,
    CAST(-75.0 AS DOUBLE) + (c_custkey % 410) / CAST(10 AS DOUBLE) AS lon,
    CAST(10 + c_custkey % 300 AS DOUBLE) AS radius FROM customer"""


@query(
    "radius_bbox",
    f"""SELECT c_custkey AS site_id, lon - radius / CAST(111.32 AS DOUBLE) AS west,
        lat - radius / CAST(111.32 AS DOUBLE) AS south, lon + radius / CAST(111.32 AS DOUBLE) AS east,
        lat + radius / CAST(111.32 AS DOUBLE) AS north FROM ({_CUSTOMERS})""",
)
def radius_bbox(spark, sf_dir):
    box = geo.radius_bbox("lat", "lon", "radius").alias("b")
    return out(_customers(spark, sf_dir).select("site_id", box).select("site_id", "b.*"))


@query(
    "pixel_index",
    f"""SELECT c_custkey AS site_id,
        CAST(trunc((lon + 75) / CAST(41.5 AS DOUBLE) * 12001) AS BIGINT) AS x,
        CAST(trunc((CAST(6.5 AS DOUBLE) - lat) / CAST(41.5 AS DOUBLE) * 1560) AS BIGINT) AS y
        FROM ({_CUSTOMERS})""",
)
def pixel_index(spark, sf_dir):
    x, y = geo.lonlat_to_pixel("lat", "lon", F.lit(12001), F.lit(1560), BOX)
    return out(_customers(spark, sf_dir).select("site_id", x.alias("x"), y.alias("y")))


@query(
    "request_status",
    """SELECT o_orderkey AS request_id,
        CASE WHEN o_orderkey % 7 = 1 THEN 'missing_location'
             WHEN o_orderkey % 7 = 2 THEN 'bad_date'
             WHEN CAST(o_orderdate AS DATE) > DATE '2000-06-30'
                  OR CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 - 3 AS INTEGER) > DATE '2000-06-30' THEN 'future_date'
             WHEN o_orderkey % 7 < 3 THEN 'bad_range'
             WHEN o_orderkey % 11 = 5 THEN 'unknown_source' ELSE 'ok' END AS status FROM orders""",
)
def check_requests(spark, sf_dir):
    key = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    text = F.date_format(day, "yyyy-MM-dd")
    end = F.date_add(day, (key % 7 - 3).cast("int"))
    requests = read(spark, sf_dir, "orders").select(
        key.alias("request_id"),
        F.when(key % 7 != 1, F.lit(-3.5)).alias("lat"),
        F.lit(-60.0).alias("lon"),
        F.when(key % 7 == 2, F.date_format(day, "dd.MM.yyyy")).otherwise(text).alias("start_date"),
        end.cast("string").alias("end_date"),
        F.when(key % 11 == 5, "elsewhere").otherwise("merge").alias("source"),
    )
    status = request_status(requests.columns, ("chirps", "merge"), "2000-06-30")
    return out(requests.select("request_id", status.alias("status")))


@query(
    "requests_from_json",
    """SELECT s_suppkey AS request_id,
        CASE WHEN s_suppkey % 5 = 1 THEN 'missing_lat' WHEN s_suppkey % 5 = 2 THEN 'bad_json'
             WHEN s_suppkey % 5 = 3 THEN 'missing_trigger' ELSE 'ok' END AS status,
        CASE WHEN s_suppkey % 5 IN (1, 2) THEN -9999 ELSE CAST(s_suppkey AS DOUBLE) / 4 END AS lat
        FROM supplier""",
)
def decode_requests(spark, sf_dir):
    key = F.col("s_suppkey")
    lat = F.when(key % 5 != 1, key / F.lit(4.0))
    trigger = F.when(key % 5 != 3, F.lit(60.0))
    body = F.to_json(
        F.struct(
            F.lit("chirps").alias("source"),
            lat.alias("lat"),
            F.lit(-55.5).alias("lon"),
            F.lit("2015-01-01").alias("start_date"),
            F.lit("2025-07-31").alias("end_date"),
            trigger.alias("trigger"),
        )
    )
    broken = F.when(key % 5 == 2, F.lit("{broken")).otherwise(body)
    bodies = read(spark, sf_dir, "supplier").select(key.alias("request_id"), broken.alias("body"))
    decoded = requests_from_json(bodies, TRIGGER_REQUEST)
    lat = F.when(F.col("status") == "bad_json", None).otherwise(F.col("lat"))
    return out(decoded.select("request_id", "status", values.missing_to_sentinel(lat).alias("lat")))


@query(
    "answer_json",
    f"""SELECT q.id AS request_id, '{{"request_id":' || q.id || ',"source":"' || any_value(q.source)
        || '","n_exceedances":' || count(v) || '}}' AS answer
        FROM ({SQL_REQUESTS}) q LEFT JOIN ({sql_cube(by_source=True, missing=True)}) k
        ON k.source = q.source AND NOT wrong AND near AND k.r = sr AND k.c = sc
        AND k.d BETWEEN d1 AND d2 AND v > trig GROUP BY q.id""",
)
def export_answers(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    found = points.point_triggers(cells, point_requests(spark, sf_dir), GRID)
    return found.select(
        "request_id", answer_json("request_id", "source", "n_exceedances").alias("answer")
    )


@query(
    "area_documents",
    f"""SELECT q.id AS request_id, CAST(k.d AS VARCHAR) AS date, round_even(lat, 5) AS latitude,
        round_even(lon, 5) AS longitude, round_even(CAST(v AS DOUBLE), 2) AS precipitation_mm,
        count(*) OVER (PARTITION BY q.id) AS total
        FROM ({SQL_REQUESTS}) q JOIN ({sql_cube(by_source=True, missing=True)}) k
        ON k.source = q.source AND NOT wrong AND k.d BETWEEN d1 AND d2 AND v > trig
        AND {sql_inside("lat", "lon", "slat", "slon", "radius")}""",
)
def area_documents(spark, sf_dir):
    """Documents read back: the totals of the requests with the points of their parts."""
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    requests = point_requests(spark, sf_dir)
    hits = areas.area_triggers(cells, requests, GRID)
    total = F.from_json("answer", "total_exceedances bigint")["total_exceedances"]
    totals = answers.area_documents(requests, hits).select("request_id", total.alias("total"))
    point = "array<struct<latitude:double,longitude:double,precipitation_mm:double>>"
    parts = answers.area_parts(hits).select(
        F.from_json("answer", f"request_id bigint, date string, points {point}").alias("a")
    )
    found = parts.select("a.request_id", "a.date", F.inline("a.points"))
    return found.join(totals, "request_id")


@query(
    "history_documents",
    f"""SELECT q.id AS request_id, CAST(k.d AS VARCHAR) AS date,
        coalesce(round_even(CAST(v AS DOUBLE), 2), -9999) AS value FROM {_SERIES}""",
)
def history_documents(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    histories = points.point_history(cells, point_requests(spark, sf_dir), GRID)
    read_back = answers.history_documents(histories).select(
        "request_id", F.from_json("answer", "history map<string,double>").alias("a")
    )
    rows = read_back.select("request_id", F.explode("a.history").alias("date", "value"))
    return rows.withColumn("value", values.missing_to_sentinel("value"))


@query(
    "trigger_documents",
    f"""SELECT q.id AS request_id, q.source, CAST(k.d AS VARCHAR) AS date,
        round_even(CAST(v AS DOUBLE), 2) AS value FROM {_SERIES} WHERE v > trig""",
)
def trigger_documents(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    triggers = points.point_triggers(cells, point_requests(spark, sf_dir), GRID)
    shape = "source string, exceedances array<struct<date:string,value:double>>"
    read_back = answers.trigger_documents(triggers).select(
        "request_id", F.from_json("answer", shape).alias("a")
    )
    return read_back.select("request_id", "a.source", F.inline("a.exceedances"))


@query(
    "json_pixel_value",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN -9999
        ELSE round_even(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 8, 2) END AS value FROM events""",
)
def pixel_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double") / F.lit(8.0)
    feature = F.struct(F.struct(k.alias("GRAY_INDEX")).alias("properties"))
    body = F.to_json(F.struct(F.array(feature).alias("features")))
    empty = F.lit('{"features":[]}')
    found = read(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 4 == 0, empty).otherwise(body).alias("body")
    )
    value = values.missing_to_sentinel(json_pixel_value("body"))
    return out(found.select("event_id", value.alias("value")))


@query(
    "answer_order",
    f"""SELECT CAST(d AS VARCHAR) AS date, lat AS latitude, lon AS longitude,
        CAST(v AS DOUBLE) AS precipitation_mm
        FROM ({sql_cube()}) WHERE v > 30 AND {_IN_ONE} ORDER BY d, lat, lon""",
)
def answer_order(spark, sf_dir):
    hits = one_area(spark, sf_dir).drop("tile_id")
    return out(hits.orderBy("date", "latitude", "longitude"))
