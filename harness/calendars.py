"""Day algebra, file names and request batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness.tables import (
    SOURCE,
    SQL_GRANULES,
    SQL_ISLANDS,
    SQL_MISSING,
    SQL_PATHS,
    SQL_SPINE,
    granule_days,
    granule_paths,
    out,
    query,
    raw_cells,
    read,
    source_of_flag,
    sql_batches,
    sql_cube,
    sql_raw,
    windows,
    cube,
)
from terracell.functions import dates, names
from terracell.operators import aggregates, append, calendar, filters, timematch
from terracell.schema import STUDY_AREA, BBox
from terracell.sources import catalog, granules

_DAY = "strftime(try_strptime(regexp_extract(path, '{p}', 1), '%Y%m%d'), '%Y-%m-%d')"


def _sql_day(pattern: str) -> str:
    return f"coalesce({_DAY.format(p=pattern)}, '')"


@query(
    "date_from_name",
    f"""SELECT granule_id, {_sql_day("([0-9]{8})".replace("{8}", "{8}"))} AS first_mode,
        {_sql_day(".*([0-9]{8}).*")} AS last_mode,
        {_sql_day("(?:^|_)([0-9]{8})[.]tif$")} AS tail_mode,
        {_sql_day("_latam_([0-9]{8})[.]tif")} AS latam_mode,
        {_sql_day("chirps_([0-9]{8})")} AS prefix_mode FROM ({SQL_PATHS})""",
)
def date_from_name(spark, sf_dir):
    day = lambda **kw: F.coalesce(dates.date_from_name("path", **kw).cast("string"), F.lit(""))
    return granule_paths(spark, sf_dir).select(
        "granule_id",
        day(mode="first").alias("first_mode"),
        day(mode="last").alias("last_mode"),
        day(mode="tail").alias("tail_mode"),
        day(mode="latam").alias("latam_mode"),
        day(prefix="chirps").alias("prefix_mode"),
    )


@query(
    "granule_inventory",
    f"""SELECT granule_id, regexp_extract(path, '^(.*?)_[^_]*[0-9]{{8}}', 1) AS source,
        {_sql_day("([0-9]{8})")} AS date FROM ({SQL_PATHS})
        WHERE {_sql_day("([0-9]{8})")} <> ''""",
)
def granule_inventory(spark, sf_dir):
    found = granules.granule_inventory(granule_paths(spark, sf_dir), mode="first")
    return out(found.select("granule_id", "source", "date"))


@query(
    "mosaic_index",
    f"""SELECT path AS location, {_sql_day("([0-9]{8})")} AS ingestion,
        CAST(-75.0 AS DOUBLE) AS west, CAST(-35.0 AS DOUBLE) AS south,
        CAST(-33.5 AS DOUBLE) AS east, CAST(6.5 AS DOUBLE) AS north FROM ({SQL_PATHS})""",
)
def mosaic_index(spark, sf_dir):
    index = granules.mosaic_index(granule_paths(spark, sf_dir), BBox(**STUDY_AREA))
    day = F.coalesce(F.col("ingestion").cast("string"), F.lit("")).alias("ingestion")
    return index.select("location", day, "footprint.*")


@query(
    "granule_uri",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, CASE source
        WHEN 'chirps' THEN 'https://data.chc.ucsb.edu/products/CHIRPS/v3.0/daily/final/IMERGlate-v07/'
             || strftime(d, '%Y') || '/chirps-v3.0.' || strftime(d, '%Y.%m.%d') || '.tif'
        WHEN 'merge' THEN 'https://ftp.cptec.inpe.br/modelos/tempo/MERGE/GPM/DAILY/'
             || strftime(d, '%Y/%m') || '/MERGE_CPTEC_' || strftime(d, '%Y%m%d') || '.grib2'
        ELSE '' END AS uri, source || '_' || strftime(d, '%Y%m%d') || '.tif' AS local
        FROM (SELECT DISTINCT source, d FROM ({sql_raw()}))""",
)
def granule_uri(spark, sf_dir):
    days = calendar.distinct_dates(raw_cells(spark, sf_dir))
    return out(
        days.select(
            "source",
            "date",
            F.coalesce(names.granule_uri("source", "date"), F.lit("")).alias("uri"),
            names.granule_name("source", "date").alias("local"),
        )
    )


@query(
    "flow_window",
    """SELECT source, CAST(a AS VARCHAR) AS as_of,
        CAST(CAST(CASE source WHEN 'chirps' THEN date_trunc('month', a) - INTERVAL 1 DAY - INTERVAL 10 YEAR + INTERVAL 1 DAY
             ELSE date_trunc('month', a) - INTERVAL 1 MONTH END AS DATE) AS VARCHAR) AS start_date,
        CAST(CAST(CASE source WHEN 'merge' THEN a - 1 WHEN 'era5' THEN a - 7
             ELSE date_trunc('month', a) - INTERVAL 1 DAY END AS DATE) AS VARCHAR) AS end_date
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS a,
              ['chirps', 'merge', 'era5', 'modis'][CAST(1 + o_orderkey % 4 AS INTEGER)] AS source FROM orders)""",
)
def flow_window(spark, sf_dir):
    all_sources = F.array(*[F.lit(s) for s in ("chirps", "merge", "era5", "modis")])
    pick = F.element_at(all_sources, (F.col("o_orderkey") % 4 + 1).cast("int"))
    runs = read(spark, sf_dir, "orders").select(
        pick.alias("source"), F.col("o_orderdate").cast("date").alias("as_of")
    )
    window = dates.flow_window("source", "as_of").alias("w")
    return out(runs.distinct().select("source", "as_of", window).select("source", "as_of", "w.*"))


@query(
    "ingest_status",
    """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 6 = 0 THEN 'bad_range'
        WHEN o_orderkey % 6 > 3 THEN 'not_yet_published' ELSE 'ok' END AS status FROM orders""",
)
def ingest_status(spark, sf_dir):
    day, k = F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 6).cast("int")
    runs = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        day.alias("as_of"),
        F.date_add(day, k - 10).alias("end_date"),
        F.when(k == 0, F.date_add(day, -9)).otherwise(F.date_add(day, -60)).alias("start_date"),
    )
    return runs.select(
        "run_id", dates.ingest_status("start_date", "end_date", "as_of").alias("status")
    )


@query(
    "missing_dates",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, CAST(mg AS BIGINT) AS missing_granule,
        CAST(ma AS BIGINT) AS missing_archive FROM ({SQL_MISSING})""",
)
def missing_dates(spark, sf_dir):
    return out(_missing(spark, sf_dir))


def _missing(spark, sf_dir):
    wanted = calendar.day_spine(windows(spark, sf_dir))
    return calendar.missing_dates(
        wanted, granule_days(spark, sf_dir), raw_cells(spark, sf_dir)
    )


@query(
    "date_islands",
    f"""SELECT source, CAST(d1 AS VARCHAR) AS start_date, CAST(d2 AS VARCHAR) AS end_date,
        n AS n_days FROM ({SQL_ISLANDS})""",
)
def date_islands(spark, sf_dir):
    return out(calendar.date_islands(_missing(spark, sf_dir)))


def _batch_sql(n):
    return f"""SELECT source, CAST(d1 AS VARCHAR) AS start_date, CAST(d2 AS VARCHAR) AS end_date,
        CAST(d2 - d1 + 1 AS BIGINT) AS n_days FROM ({sql_batches(n)})"""


@query("date_batches", _batch_sql(31))
def date_batches(spark, sf_dir):
    return out(calendar.date_batches(_missing(spark, sf_dir), 31))


@query("date_batches_short", _batch_sql(3))
def date_batches_short(spark, sf_dir):
    return out(calendar.date_batches(_missing(spark, sf_dir), 3))


@query(
    "request_footprint",
    f"""SELECT source, CAST(d1 AS VARCHAR) AS start_date,
        CAST(try_strptime(y || m || dd, '%Y%m%d')::DATE AS VARCHAR) AS date,
        CAST(try_strptime(y || m || dd, '%Y%m%d')::DATE BETWEEN d1 AND d2 AS BIGINT) AS wanted
        FROM (SELECT source, d1, d2, ys, ms, unnest(ds) AS dd, y, m FROM (
          SELECT source, d1, d2, ys, ms, ds, y, unnest(ms) AS m FROM (
            SELECT source, d1, d2, ys, ms, ds, unnest(ys) AS y FROM (
              SELECT source, d1, d2,
                list_distinct(list_transform(days, lambda x: strftime(x, '%Y'))) AS ys,
                list_distinct(list_transform(days, lambda x: strftime(x, '%m'))) AS ms,
                list_distinct(list_transform(days, lambda x: strftime(x, '%d'))) AS ds
              FROM (SELECT *, generate_series(d1, d2, INTERVAL 1 DAY) AS days FROM ({sql_batches(31)}))))))
        WHERE try_strptime(y || m || dd, '%Y%m%d') IS NOT NULL""",
)
def request_footprint(spark, sf_dir):
    batches = calendar.date_batches(_missing(spark, sf_dir), 31)
    seen = calendar.request_footprint(batches)
    return out(seen.select("source", "start_date", "date", "wanted"))


@query(
    "date_parts",
    f"""SELECT source, CAST(d1 AS VARCHAR) AS start_date,
        list_aggregate(list_sort(list_distinct(list_transform(days, lambda x: strftime(x, '%Y')))), 'string_agg', ',') AS years,
        list_aggregate(list_sort(list_distinct(list_transform(days, lambda x: strftime(x, '%m')))), 'string_agg', ',') AS months,
        list_aggregate(list_sort(list_distinct(list_transform(days, lambda x: strftime(x, '%d')))), 'string_agg', ',') AS days
        FROM (SELECT *, generate_series(d1, d2, INTERVAL 1 DAY) AS days FROM ({SQL_ISLANDS}))""",
)
def date_parts(spark, sf_dir):
    runs = calendar.date_islands(_missing(spark, sf_dir))
    days = dates.days_between(F.col("start_date"), F.col("end_date"))
    parts = runs.withColumn("_d", days).withColumn("_p", dates.date_parts("_d"))
    text = [F.array_join(f"_p.{c}", ",").alias(c) for c in ("years", "months", "days")]
    return out(parts.select("source", "start_date", *text))


@query(
    "iso_time",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y%m%d')
        ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' END AS iso FROM orders""",
)
def iso_time(spark, sf_dir):
    short = F.date_format("o_orderdate", "yyyyMMdd")
    text = F.when(F.col("o_orderkey") % 3 == 0, short).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("t"))
    return orders.select("id", dates.iso_time("t").alias("iso"))


@query(
    "decode_cf_time",
    """SELECT o_orderkey AS id,
        strftime(TIMESTAMP '1980-01-01' + to_days(CAST(o_custkey AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS from_days,
        strftime(TIMESTAMP '1900-01-01' + to_hours(o_orderkey), '%Y-%m-%d %H:%M:%S') AS from_hours FROM orders""",
)
def decode_cf_time(spark, sf_dir):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        text(dates.decode_cf_time("o_custkey", "days", "1980-01-01")).alias("from_days"),
        text(dates.decode_cf_time("o_orderkey", "hours", "1900-01-01")).alias("from_hours"),
    )


@query(
    "output_name",
    """SELECT p_partkey AS id, CASE
        WHEN v LIKE '%temperature%' THEN CASE WHEN s LIKE '%maximum%' THEN 'temp_max'
             WHEN s LIKE '%minimum%' THEN 'temp_min' ELSE 'temp' END
        WHEN v LIKE '%precipitation%' THEN 'precipitation'
        ELSE replace(v || '_' || s, '_', '-') END AS name,
        CASE p_partkey % 3 WHEN 0 THEN 'ndvi_s2' WHEN 1 THEN 'ndvi_modis' ELSE 'ndvi_landsat' END AS vegetation
        FROM (SELECT p_partkey,
          ['2m_temperature', 'total_precipitation', 'surface_pressure', '2m_dewpoint_temperature'][CAST(1 + p_partkey % 4 AS INTEGER)] AS v,
          ['daily_maximum', 'daily_minimum', 'daily_mean'][CAST(1 + p_partkey % 3 AS INTEGER)] AS s FROM part)""",
)
def output_name(spark, sf_dir):
    pick = lambda items, n: F.element_at(
        F.array(*[F.lit(i) for i in items]), (F.col("p_partkey") % n + 1).cast("int")
    )
    variables = ("2m_temperature", "total_precipitation", "surface_pressure", "2m_dewpoint_temperature")
    asked = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        pick(variables, 4).alias("v"),
        pick(("daily_maximum", "daily_minimum", "daily_mean"), 3).alias("s"),
        pick(("sentinel2", "modis", "landsat"), 3).alias("source"),
    )
    return asked.select(
        "id",
        names.output_name("v", "s").alias("name"),
        names.vegetation_name("source").alias("vegetation"),
    )


@query(
    "dedup_append",
    f"""WITH a AS (SELECT d, v FROM ({sql_cube(by_source=True)}) WHERE source = 'chirps'),
        b AS (SELECT d, v FROM ({sql_cube(by_source=True)}) WHERE source = 'merge')
        SELECT CAST(d AS VARCHAR) AS date, count(*) AS n_cells, sum(CAST(v AS DOUBLE)) AS total FROM (
          SELECT d, v FROM a UNION ALL
          SELECT d, v FROM b WHERE d NOT IN (SELECT d FROM a)) GROUP BY d""",
)
def dedup_append(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True)
    existing = cells.filter("source = 'chirps'")
    new = cells.filter("source = 'merge'").withColumn("source", F.lit("chirps"))
    joined = append.dedup_append(existing, new)
    twice = append.dedup_append(joined, new)
    return out(
        twice.groupBy("date").agg(
            F.count("*").alias("n_cells"), F.sum(F.col("value").cast("double")).alias("total")
        )
    )


@query(
    "restrict_dates",
    f"""SELECT CAST(d AS VARCHAR) AS date, r AS "row", c AS col, CAST(v AS DOUBLE) AS value
        FROM ({sql_cube()}) WHERE d IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'F')""",
)
def restrict_dates(spark, sf_dir):
    days = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    days = days.select(F.col("o_orderdate").cast("date").alias("date"))
    kept = append.restrict_dates(cube(spark, sf_dir), days)
    return out(kept.select("date", "row", "col", "value"))


@query(
    "last_per_day",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, r AS "row", c AS col, v AS value, k AS scene FROM (
        SELECT *, row_number() OVER (PARTITION BY source, d, r, c ORDER BY ts DESC, k DESC, v DESC) AS n FROM (
          SELECT {SOURCE} AS source, date_trunc('month', l_shipdate)::DATE AS d, l_partkey % 83 AS r,
            l_orderkey % 83 AS c, l_quantity AS v, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS k
          FROM lineitem)) WHERE n = 1""",
)
def last_per_day(spark, sf_dir):
    copies = read(spark, sf_dir, "lineitem").select(
        source_of_flag().alias("source"),
        F.trunc("l_shipdate", "month").alias("date"),
        (F.col("l_partkey") % 83).alias("row"),
        (F.col("l_orderkey") % 83).alias("col"),
        F.col("l_quantity").alias("value"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scene"),
    )
    return out(append.last_per_day(copies, order=("ts", "scene")).drop("ts"))


@query(
    "skip_existing",
    f"""SELECT source, CAST(d AS VARCHAR) AS date FROM ({SQL_SPINE}) w
        WHERE NOT EXISTS (SELECT 1 FROM ({SQL_GRANULES}) g WHERE g.source = w.source AND g.d = w.d)""",
)
def skip_existing(spark, sf_dir):
    wanted = calendar.day_spine(windows(spark, sf_dir))
    return out(filters.skip_existing(wanted, granule_days(spark, sf_dir)))


@query(
    "day_set_algebra",
    f"""SELECT CAST(d AS VARCHAR) AS date, op FROM (
        (SELECT d, 'union' AS op FROM (SELECT d FROM ({SQL_GRANULES}) UNION SELECT d FROM ({sql_raw()})))
        UNION ALL (SELECT d, 'difference' FROM (SELECT d FROM ({SQL_GRANULES}) EXCEPT SELECT d FROM ({sql_raw()})))
        UNION ALL (SELECT d, 'intersection' FROM (SELECT d FROM ({SQL_GRANULES}) INTERSECT SELECT d FROM ({sql_raw()}))))""",
)
def day_set_algebra(spark, sf_dir):
    a = granule_days(spark, sf_dir).select("date")
    b = raw_cells(spark, sf_dir).select("date")
    tag = lambda df, op: df.withColumn("op", F.lit(op))
    return out(
        append.concat_time(
            tag(a.union(b).distinct(), "union"),
            tag(a.subtract(b), "difference"),
            tag(a.intersect(b), "intersection"),
        )
    )


@query(
    "distinct_dates",
    "SELECT DISTINCT event_type AS source, CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events",
)
def distinct_dates(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumnRenamed("event_type", "source")
    return out(calendar.distinct_dates(events, "ts"))


@query(
    "time_list",
    f"""SELECT source, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) AS days
        FROM (SELECT DISTINCT source, d FROM ({sql_raw()})) GROUP BY source""",
)
def time_list(spark, sf_dir):
    lists = aggregates.time_list(raw_cells(spark, sf_dir))
    return lists.select("source", F.array_join(F.col("days").cast("array<string>"), ",").alias("days"))


@query(
    "time_extent",
    f"""SELECT source, CAST(min(d) AS VARCHAR) AS start_date, CAST(max(d) AS VARCHAR) AS end_date,
        count(DISTINCT d) AS n_days FROM ({sql_raw()}) GROUP BY source""",
)
def time_extent(spark, sf_dir):
    return out(aggregates.time_extent(raw_cells(spark, sf_dir)))


_ASKED = """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'chirps' WHEN 1 THEN 'merge' ELSE 'none' END AS source,
    CAST(o_orderdate AS DATE) - 200 AS d FROM orders"""


def _asked(spark, sf_dir):
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.when(key % 3 == 0, "chirps").when(key % 3 == 1, "merge").otherwise("none").alias("source"),
        F.date_sub(F.col("o_orderdate").cast("date"), 200).alias("date"),
    )


# Days that have cells.
_DAYS = f"(SELECT DISTINCT source, d FROM ({sql_raw()}))"
# Nearest day by brute force over the distinct wanted days; ties go to the earlier day.
_NEAREST = f"""SELECT a.source, a.d, arg_min(b.d, abs(a.d - b.d) * 2 + CASE WHEN b.d > a.d THEN 1 ELSE 0 END) AS m
    FROM (SELECT DISTINCT source, d FROM ({_ASKED})) a
    LEFT JOIN {_DAYS} b ON a.source = b.source
    GROUP BY a.source, a.d"""


def _match(name, strategy, sql):
    @query(name, sql)
    def run(spark, sf_dir):
        found = timematch.time_match(_asked(spark, sf_dir), raw_cells(spark, sf_dir), strategy)
        day = F.coalesce(F.col("matched_date").cast("string"), F.lit(""))
        return found.select("id", "source", day.alias("matched_date"))

    return run


_match(
    "time_match_nearest",
    "nearest",
    f"""SELECT id, q.source, coalesce(CAST(m AS VARCHAR), '') AS matched_date FROM ({_ASKED}) q
        JOIN ({_NEAREST}) n ON n.source = q.source AND n.d = q.d""",
)
_match(
    "time_match_exact",
    "exact",
    f"""SELECT id, q.source, coalesce(CAST(b.d AS VARCHAR), '') AS matched_date FROM ({_ASKED}) q
        LEFT JOIN {_DAYS} b ON b.source = q.source AND b.d = q.d""",
)
for _name, _fn in (("minimum", "min"), ("maximum", "max")):
    _match(
        f"time_match_{_name}",
        _name,
        f"""SELECT id, q.source, coalesce(CAST(m AS VARCHAR), '') AS matched_date FROM ({_ASKED}) q
            LEFT JOIN (SELECT source, {_fn}(d) AS m FROM {_DAYS} GROUP BY source) b ON b.source = q.source""",
    )
_match(
    "time_match_exact_or_first",
    "exact_or_first",
    f"""SELECT id, q.source, coalesce(CAST(b.d AS VARCHAR), CAST(m AS VARCHAR), '') AS matched_date
        FROM ({_ASKED}) q LEFT JOIN {_DAYS} b ON b.source = q.source AND b.d = q.d
        LEFT JOIN (SELECT source, min(d) AS m FROM {_DAYS} GROUP BY source) f ON f.source = q.source""",
)


@query(
    "availability",
    f"""SELECT w.source, CAST(w.d AS VARCHAR) AS date,
        CASE WHEN g.d IS NOT NULL THEN 'local' WHEN a.d IS NOT NULL THEN 'remote' ELSE 'none' END AS place,
        CAST(g.d IS NOT NULL OR a.d IS NOT NULL AS BIGINT) AS available
        FROM ({SQL_SPINE}) w LEFT JOIN ({SQL_GRANULES}) g ON g.source = w.source AND g.d = w.d
        LEFT JOIN (SELECT DISTINCT source, d FROM ({sql_raw()})) a ON a.source = w.source AND a.d = w.d""",
)
def availability(spark, sf_dir):
    days = calendar.day_spine(windows(spark, sf_dir))
    return out(
        granules.availability(days, granule_days(spark, sf_dir), raw_cells(spark, sf_dir))
    )


@query(
    "files_per_dataset",
    f"""SELECT regexp_extract(path, '^(.*?)_[^_]*[0-9]{{8}}', 1) AS source, count(*) AS n_files
        FROM ({SQL_PATHS}) WHERE {_sql_day("([0-9]{8})")} <> '' GROUP BY 1""",
)
def files_per_dataset(spark, sf_dir):
    found = granules.granule_inventory(granule_paths(spark, sf_dir), mode="first")
    return out(aggregates.files_per_dataset(found))


@query(
    "run_summary",
    """SELECT o_orderpriority AS run, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS created,
        count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS skipped, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS errors
        FROM orders GROUP BY 1""",
)
def run_summary(spark, sf_dir):
    state = F.col("o_orderstatus")
    outcomes = read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("run"),
        F.when(state == "F", "created").when(state == "O", "skipped").otherwise("error").alias("status"),
    )
    return out(aggregates.run_summary(outcomes, ("run",)))


@query(
    "available_sources",
    f"SELECT DISTINCT source FROM ({sql_raw()}) WHERE source IN ('chirps', 'merge')",
)
def available_sources(spark, sf_dir):
    return catalog.available_sources(raw_cells(spark, sf_dir), "precipitation")


@query(
    "is_loaded",
    f"""SELECT id, CAST(source IN (SELECT source FROM ({sql_raw()})) AS BIGINT) AS is_loaded FROM ({_ASKED})""",
)
def is_loaded(spark, sf_dir):
    flagged = catalog.with_loaded_flag(_asked(spark, sf_dir), raw_cells(spark, sf_dir))
    return out(flagged.select("id", "is_loaded"))


@query(
    "dataset_info",
    f"""SELECT source, CAST(min(d) AS VARCHAR) AS start_date, CAST(max(d) AS VARCHAR) AS end_date,
        count(DISTINCT d) AS n_days, count(DISTINCT lat) AS n_lat, count(DISTINCT lon) AS n_lon,
        'value' AS variables FROM ({sql_cube(by_source=True)}) GROUP BY source""",
)
def dataset_info(spark, sf_dir):
    info = catalog.dataset_info(cube(spark, sf_dir, by_source=True))
    return out(info.withColumn("variables", F.array_join("variables", ",")))
