"""Values, filters, statistics, classes and map views."""

from __future__ import annotations

from pyspark.sql import functions as F

from harness.tables import (
    GRID,
    N,
    TILE,
    cube,
    out,
    query,
    raw_cells,
    read,
    source_of_flag,
    sql_cube,
    sql_raw,
)
from terracell.functions import geo, palette, values
from terracell.operators import (
    aggregates,
    conform,
    filters,
    mapview,
    raster,
    styling,
)
from terracell.plans import accumulation, maps, reports
from terracell.schema import CHIRPS_CROP, STUDY_AREA, BBox
from terracell.sources import tiles

CROP = BBox(**CHIRPS_CROP)
SMALL = BBox(west=-60.1, south=-20.3, east=-47.2, north=-4.9)
EVENT = [f"1998-{m:02d}-{d:02d}" for m in (4, 5) for d in range(1, 31) if (m, d) != (4, 30)]
_EVENT_SQL = "(d BETWEEN DATE '1998-04-01' AND DATE '1998-04-29' OR d BETWEEN DATE '1998-05-01' AND DATE '1998-05-30')"


@query(
    "normalize_lon",
    """SELECT o_orderkey AS id, CAST((CAST(o_orderkey % 7200 AS DOUBLE) / 20 + 180) % 360 - 180 AS DOUBLE) AS lon FROM orders""",
)
def normalize_lon(spark, sf_dir):
    lon = (F.col("o_orderkey") % 7200) / F.lit(20.0)
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), geo.normalize_lon(lon).alias("lon")
    )


@query(
    "kelvin_to_celsius",
    """SELECT l_orderkey AS id, name, CAST(CASE WHEN name = 'precip' THEN v
        ELSE v - CAST(273.15 AS FLOAT) END AS DOUBLE) AS value FROM (
        SELECT l_orderkey, ['2M_Temperature', 't2m', 'precip'][CAST(1 + l_partkey % 3 AS INTEGER)] AS name,
        CAST(CAST(250.25 AS DOUBLE) + l_quantity AS FLOAT) AS v FROM lineitem)""",
)
def kelvin_to_celsius(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("2M_Temperature", "t2m", "precip")])
    name = F.element_at(names, (F.col("l_partkey") % 3 + 1).cast("int"))
    raw = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        name.alias("name"),
        (F.lit(250.25) + F.col("l_quantity")).cast("float").alias("v"),
    )
    return out(raw.select("id", "name", values.kelvin_to_celsius("v", "name").alias("value")))


@query(
    "missing_values",
    f"""SELECT count(*) AS n_cells, count(v) AS n_values, count(CASE WHEN v > 45 THEN 1 END) AS n_over,
        sum(coalesce(CAST(v AS DOUBLE), -9999)) AS with_sentinel FROM ({sql_raw(missing=True)})""",
)
def missing_values(spark, sf_dir):
    """NaN comes in, NULL goes on: a missing value exceeds nothing."""
    nan = F.when(F.col("l_quantity") == 50, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    cells = read(spark, sf_dir, "lineitem").select(
        values.missing_if_nan(values.cast_value(nan)).alias("value")
    )
    return out(
        cells.agg(
            F.count("*").alias("n_cells"),
            F.count("value").alias("n_values"),
            F.count_if(values.exceeds("value", 45)).alias("n_over"),
            F.sum(values.missing_to_sentinel("value")).alias("with_sentinel"),
        )
    )


@query(
    "round_values",
    """SELECT l_orderkey AS id, round_even(CAST(CAST(l_extendedprice / 1000 AS FLOAT) AS DOUBLE), 2) AS two,
        round_even(CAST(CAST(l_extendedprice / 1000 AS FLOAT) AS DOUBLE), 5) AS five FROM lineitem""",
)
def round_values(spark, sf_dir):
    v = (F.col("l_extendedprice") / F.lit(1000)).cast("float")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), values.round2(v).alias("two"), values.round5(v).alias("five")
    )


@query(
    "variable_conform",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, r AS "row", c AS col, CAST(year(d) AS BIGINT) AS year,
        {TILE} AS tile_id, lat, lon, coalesce(CAST(v AS DOUBLE), -9999) AS value
        FROM ({sql_cube(by_source=True, missing=True)})""",
)
def variable_conform(spark, sf_dir):
    """Foreign names, 0..360 longitudes and NaN to canonical cells."""
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    foreign = cells.select(
        "source",
        F.col("date").cast("timestamp_ntz").alias("valid_time"),
        F.col("lat").alias("Latitude"),
        F.pmod(F.col("lon"), F.lit(360.0)).alias("long"),
        F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("rdp"),
        F.lit(1013.0).alias("prmsl"),
    )
    shaped = conform.standardize_dims(conform.rename_drop(foreign, {}, drop=("prmsl",)))
    shaped = conform.pick_value(shaped, "prec", ("rdp", "pr"), fuzzy=False)
    done = conform.conform_cells(shaped, GRID)
    done = conform.tag_attrs(done, units="mm", source="test")
    return out(done.withColumn("value", values.missing_to_sentinel("value")))


@query(
    "tiles_to_cells",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, r AS "row", c AS col, {TILE} AS tile_id,
        lat, lon, CAST(v AS DOUBLE) AS value FROM ({sql_cube(by_source=True)})""",
)
def tiles_to_cells(spark, sf_dir):
    """Cells packed into tiles of 1 x 20 and unpacked again."""
    cells = cube(spark, sf_dir, by_source=True)
    first = (F.floor(F.col("col") / 20) * 20).cast("int").alias("first_col")
    entry = F.struct((F.col("col") % 20).alias("k"), F.col("value").alias("v"))
    packed = cells.groupBy("source", "date", F.col("row").alias("first_row"), first).agg(
        F.map_from_entries(F.collect_list(entry)).alias("m")
    )
    block = F.array(*[F.try_element_at("m", F.lit(i)) for i in range(20)]).alias("values")
    packed = packed.select("source", "date", "first_row", "first_col", F.lit(20).alias("width"), block)
    done = filters.drop_missing(tiles.tiles_to_cells(packed, GRID))
    return out(done.drop("year"))


@query(
    "north_up",
    f"""SELECT CAST(d AS VARCHAR) AS date, 82 - r AS "row", c AS col, lat FROM ({sql_cube()})""",
)
def north_up(spark, sf_dir):
    return out(conform.north_up(cube(spark, sf_dir), GRID).select("date", "row", "col", "lat"))


@query(
    "bbox_select",
    f"""SELECT CAST(d AS VARCHAR) AS date, r AS "row", c AS col FROM ({sql_cube()})
        WHERE lat BETWEEN -20.3 AND -4.9 AND lon BETWEEN -60.1 AND -47.2""",
)
def bbox_select(spark, sf_dir):
    return out(filters.select_box(cube(spark, sf_dir), SMALL).select("date", "row", "col"))


@query(
    "bbox_clip",
    f"""SELECT CAST(d AS VARCHAR) AS date, r AS "row", c AS col FROM ({sql_cube()})
        WHERE lat BETWEEN CAST(-20.3 AS DOUBLE) - 0.25 AND CAST(-4.9 AS DOUBLE) + 0.25
        AND lon BETWEEN CAST(-60.1 AS DOUBLE) - 0.25 AND CAST(-47.2 AS DOUBLE) + 0.25""",
)
def bbox_clip(spark, sf_dir):
    return out(filters.clip_box(cube(spark, sf_dir), SMALL, GRID).select("date", "row", "col"))


_BOXES = """SELECT c_custkey AS id, CAST(c_custkey % 50 - 25 AS DOUBLE) AS south, CAST(c_custkey % 70 - 75 AS DOUBLE) AS west,
    CAST((c_custkey * 7) % 50 - 25 AS DOUBLE) AS north, CAST((c_custkey * 11) % 70 - 75 AS DOUBLE) AS east FROM customer"""


def _boxes(spark, sf_dir):
    k = F.col("c_custkey")
    s, w = k % 50 - 25, k % 70 - 75
    n, e = (k * 7) % 50 - 25, (k * 11) % 70 - 75
    numbers = F.array(*[x.cast("double") for x in (n, w, s, e)])
    boxes = read(spark, sf_dir, "customer").select(k.alias("id"), numbers.alias("edges"))
    return boxes.withColumn("box", geo.bbox_reorder("edges", "nwse"))


@query(
    "bbox_validate",
    f"""SELECT *, CASE WHEN north <= south OR west >= east THEN 'bad_bbox' ELSE 'ok' END AS status
        FROM ({_BOXES})""",
)
def bbox_validate(spark, sf_dir):
    return _boxes(spark, sf_dir).select("id", "box.*", geo.bbox_status("box").alias("status"))


@query(
    "rect_intersection",
    f"""SELECT id, greatest(west, -60) AS west, greatest(south, -20) AS south, least(east, -45) AS east,
        least(north, 0) AS north FROM ({_BOXES}) WHERE north > south AND west < east
        AND greatest(west, -60) < least(east, -45) AND greatest(south, -20) < least(north, 0)""",
)
def rect_intersection(spark, sf_dir):
    area = geo.box_literal(BBox(-60, -20, -45, 0))
    valid = _boxes(spark, sf_dir).filter(geo.bbox_status("box") == "ok")
    shared = valid.select("id", geo.rect_intersection("box", area).alias("s"))
    return shared.filter("s IS NOT NULL").select("id", "s.*")


@query(
    "time_range",
    f"""SELECT CAST(d AS VARCHAR) AS date, count(*) AS n FROM ({sql_cube()})
        WHERE d BETWEEN DATE '1997-03-15' AND DATE '1999-02-10' GROUP BY d""",
)
def time_range(spark, sf_dir):
    window = filters.time_range(cube(spark, sf_dir), "1997-03-15", "1999-02-10")
    return out(window.groupBy("date").agg(F.count("*").alias("n")))


@query(
    "exceeds",
    f"""SELECT CAST(d AS VARCHAR) AS date, r AS "row", c AS col, CAST(v AS DOUBLE) AS value
        FROM ({sql_cube(missing=True)}) WHERE v > 40""",
)
def exceeds(spark, sf_dir):
    over = filters.exceeds(cube(spark, sf_dir, missing=True), 40)
    return out(over.select("date", "row", "col", "value"))


@query(
    "drop_empty_days",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, count(*) AS n_cells, count(v) AS n_values
        FROM (SELECT source, d, r, c, CASE WHEN v >= 46 THEN v END AS v FROM ({sql_cube(by_source=True)}))
        GROUP BY source, d HAVING count(v) > 0""",
)
def drop_empty_days(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True)
    cells = cells.withColumn("value", F.when(F.col("value") >= 46, F.col("value")))
    kept = filters.drop_empty_days(cells)
    return out(
        kept.groupBy("source", "date").agg(
            F.count("*").alias("n_cells"), F.count("value").alias("n_values")
        )
    )


@query(
    "accumulate_dates",
    f"""SELECT lat, lon, coalesce(sum(CAST(v AS DOUBLE)), 0) AS total
        FROM ({sql_cube(missing=True)}) WHERE {_EVENT_SQL} GROUP BY lat, lon""",
)
def accumulate_dates(spark, sf_dir):
    cells = filters.dates_in(cube(spark, sf_dir, missing=True), EVENT)
    return out(aggregates.accumulate(cells))


def _class_sql(bounds, v="total"):
    cases = " ".join(f"WHEN {v} < {b} THEN {i - 1}" for i, b in enumerate(bounds))
    return f"CAST(CASE {cases} ELSE {len(bounds) - 1} END AS BIGINT)"


_BOUNDS = [0.0] + [float(b) for b in palette.DEFAULT_BOUNDS.split(",")]
_COLORS = [palette.TRANSPARENT, *palette.DEFAULT_COLORS.split(",")]
_COLOR_SQL = "CASE class WHEN -1 THEN '{}' {} ELSE '{}' END".format(
    _COLORS[0], " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_COLORS)), _COLORS[-1]
)


@query(
    "accumulate_classes",
    f"""SELECT lat, lon, total, class, {_COLOR_SQL} AS color FROM (
        SELECT lat, lon, total, {_class_sql(_BOUNDS)} AS class FROM (
        SELECT lat, lon, coalesce(sum(CAST(v AS DOUBLE)), 0) AS total
        FROM ({sql_cube(missing=True)}) WHERE {_EVENT_SQL} GROUP BY lat, lon))""",
)
def accumulate_classes(spark, sf_dir):
    return out(accumulation.event_accumulation(cube(spark, sf_dir, missing=True), EVENT))


@query(
    "parse_palette",
    """SELECT id, array_to_string(list_transform(b, lambda x: coalesce(CAST(CAST(x AS INTEGER) AS VARCHAR), '?')), ' ') AS bounds,
        array_to_string(c, ' ') AS colors,
        CASE WHEN id % 5 = 1 THEN 'bad_bounds' WHEN len(c) < len(b) - 1 THEN 'too_few_colors'
             WHEN id % 5 = 3 THEN 'bad_color' ELSE 'ok' END AS status,
        CASE WHEN id % 5 = 1 THEN -9999 ELSE CAST(len(list_filter(b, lambda x: x <= size)) - 1 AS BIGINT) END AS class FROM (
        SELECT p_partkey AS id, p_size AS size,
          [0, p_size, CASE WHEN p_partkey % 5 = 1 THEN NULL ELSE p_size + 5 END, p_size + 10]
            || CASE WHEN p_partkey % 5 = 2 THEN [p_size + 20, p_size + 30] ELSE [] END AS b,
          ['#00000000', '#FF00' || lpad(CAST(p_size AS VARCHAR), 2, '0'),
           CASE WHEN p_partkey % 5 = 3 THEN '#GGGGGG' ELSE '#00FFFF' END, '#ABCDEF'] AS c FROM part)""",
)
def parse_palette(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    bounds = F.concat(
        size, F.lit(","), F.when(k % 5 == 1, "x").otherwise((size + 5).cast("string")),
        F.lit(", "), size + 10,
        F.when(k % 5 == 2, F.concat(F.lit(","), size + 20, F.lit(","), size + 30)).otherwise(""),
    )
    colors = F.concat(
        F.lit("FF00"), F.lpad(size.cast("string"), 2, "0"), F.lit(", #"),
        F.when(k % 5 == 3, "GGGGGG").otherwise("00FFFF"), F.lit(",#ABCDEF"),
    )
    asked = read(spark, sf_dir, "part").select(
        k.alias("id"), size.cast("double").alias("size"), bounds.alias("bt"), colors.alias("ct")
    )
    parsed = asked.withColumns({"b": palette.parse_bounds("bt"), "c": palette.parse_colors("ct")})
    shown = F.transform("b", lambda x: F.coalesce(x.cast("int").cast("string"), F.lit("?")))
    status = palette.palette_status("b", "c")
    klass = F.when(status == "bad_bounds", -9999).otherwise(palette.classify("size", F.col("b")))
    return out(
        parsed.select(
            "id",
            F.array_join(shown, " ").alias("bounds"),
            F.array_join("c", " ").alias("colors"),
            status.alias("status"),
            klass.alias("class"),
        )
    )


_STYLE_SQL = "(VALUES {}) AS s(style, q, color, label, op)".format(
    ", ".join(
        f"('{name}', CAST({q} AS DOUBLE), '{c}', '{label}', CAST({op} AS DOUBLE))"
        for name, stops in palette.STYLES.items()
        for q, c, label, op in stops
    )
)
_STOPS_SQL = f"SELECT *, lead(q) OVER (PARTITION BY style ORDER BY q) AS nq FROM {_STYLE_SQL}"


@query(
    "style_classes",
    f"""SELECT k.style, coalesce(color, '') AS color, coalesce(label, '') AS label,
        coalesce(q, -9999) AS quantity, coalesce(nq, -9999) AS next_quantity,
        count(*) AS n, sum(coalesce(CAST(v AS DOUBLE), 0)) AS total FROM (
          SELECT ['precipitation', 'precipitation_4', 'precipitation_7', 'temperature'][CAST(1 + r % 4 AS INTEGER)] AS style,
          CAST(v - 2 AS FLOAT) AS v FROM ({sql_cube(missing=True)})) k
        LEFT JOIN ({_STOPS_SQL}) s ON s.style = k.style AND v >= q AND (nq IS NULL OR v < nq)
        GROUP BY ALL""",
)
def style_classes(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in ("precipitation", "precipitation_4", "precipitation_7", "temperature")])
    shown = cube(spark, sf_dir, missing=True).select(
        F.element_at(names, F.col("row") % 4 + 1).alias("style"),
        (F.col("value") - F.lit(2).cast("float")).alias("value"),
    )
    styled = styling.style_join(shown, styling.style_table(spark))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    number = lambda c: values.missing_to_sentinel(c).alias(c)
    return out(
        styled.groupBy("style", text("color"), text("label"), number("quantity"), number("next_quantity"))
        .agg(
            F.count("*").alias("n"),
            F.sum(F.coalesce(F.col("value").cast("double"), F.lit(0.0))).alias("total"),
        )
    )


def _ramp_sql(style: str, v: str) -> str:
    stops = palette.style_stops(style)

    def rgb(c):
        return [int(c[i : i + 2], 16) for i in (1, 3, 5)]

    def fmt(parts):
        return "'#' || " + " || ".join(f"lpad(upper(to_hex({p})), 2, '0')" for p in parts)

    cases = [f"WHEN {v} IS NULL THEN '{palette.TRANSPARENT}'", f"WHEN {v} < {stops[0][0]} THEN '{stops[0][1]}'"]
    for lo, hi in zip(stops, stops[1:]):
        share = f"(CAST({v} AS DOUBLE) - {lo[0]}::DOUBLE) / ({hi[0]}::DOUBLE - {lo[0]}::DOUBLE)"
        mix = [
            f"CAST(floor({a} + ({b} - {a}) * ({share}) + 0.5::DOUBLE) AS BIGINT)"
            for a, b in zip(rgb(lo[1]), rgb(hi[1]))
        ]
        cases.append(f"WHEN {v} < {hi[0]} THEN {fmt(mix)}")
    return f"CASE {' '.join(cases)} ELSE '{stops[-1][1]}' END"


@query(
    "color_ramp",
    f"""SELECT coalesce(CAST(v AS DOUBLE), -9999) AS value, {_ramp_sql("precipitation", "v")} AS color,
        {_ramp_sql("temperature", "v")} AS warm, count(*) AS n
        FROM (SELECT CAST(v AS DOUBLE) * 1.25::DOUBLE AS v FROM ({sql_cube(missing=True)})) GROUP BY ALL""",
)
def color_ramp(spark, sf_dir):
    cells = cube(spark, sf_dir, missing=True).select(
        (F.col("value").cast("double") * 1.25).alias("value")
    )
    colored = cells.select(
        values.missing_to_sentinel("value").alias("value"),
        palette.color_ramp("value", "precipitation")["color"].alias("color"),
        palette.color_ramp("value", "temperature")["color"].alias("warm"),
    )
    return out(colored.groupBy("value", "color", "warm").agg(F.count("*").alias("n")))


@query(
    "extent",
    f"""SELECT source, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max
        FROM ({sql_cube(by_source=True)}) GROUP BY source""",
)
def extent(spark, sf_dir):
    return aggregates.extent(cube(spark, sf_dir, by_source=True), ("source",))


_STATS = """min(CAST(v AS DOUBLE)) AS min, max(CAST(v AS DOUBLE)) AS max,
    round(avg(CAST(v AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(v AS DOUBLE)), 6) AS std,
    count(*) - count(v) AS n_missing, max(r) + 1 AS n_rows, max(c) + 1 AS n_cols"""


@query(
    "raster_stats",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, {_STATS}
        FROM ({sql_cube(by_source=True, missing=True)}) GROUP BY source, d HAVING count(v) > 0""",
)
def raster_stats(spark, sf_dir):
    stats = raster.raster_stats(cube(spark, sf_dir, by_source=True, missing=True))
    stats = stats.filter("max IS NOT NULL")
    return out(stats.withColumns({c: F.round(c, 6) for c in ("mean", "std")}))


def _hist_sql(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    on = " AND ".join(f"a.{x.strip()} = b.{x.strip()}" for x in keys.split(",")) if keys else "true"
    cells = f"SELECT source, year(d) AS y, CAST(v AS DOUBLE) AS v FROM ({sql_cube(by_source=True, missing=True)}) WHERE v IS NOT NULL"
    return f"""SELECT {''.join(f'a.{x.strip()}, ' for x in keys.split(','))} lo, hi,
        CAST(CASE WHEN lo = hi THEN 26 ELSE least(floor((v - lo) / (hi - lo) * 50) + 1, 50) END AS BIGINT) AS bin,
        count(*) AS count FROM ({cells}) a
        JOIN (SELECT {k} min(v) AS lo, max(v) AS hi FROM ({cells}) {group}) b ON {on} GROUP BY ALL"""


@query(
    "raster_histogram",
    f"SELECT source, CAST(y AS BIGINT) AS year, lo AS low, hi AS high, bin, count FROM ({_hist_sql('source, y')})",
)
def raster_histogram(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    return out(raster.histogram(cells, keys=("source", "year")))


@query(
    "raster_report",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, count(v) AS n_values, count(*) - count(v) AS n_missing,
        CAST(CASE WHEN min(v) = max(v) THEN 26 ELSE 1 END AS BIGINT) AS first_bin
        FROM ({sql_cube(by_source=True, missing=True)}) GROUP BY source, d HAVING count(v) > 0""",
)
def raster_report(spark, sf_dir):
    report = reports.raster_report(cube(spark, sf_dir, by_source=True, missing=True))
    total = F.aggregate("histogram", F.lit(0).cast("bigint"), lambda a, b: a + b["count"])
    return out(
        report.filter("max IS NOT NULL").select(
            "source",
            "date",
            total.alias("n_values"),
            "n_missing",
            F.array_min("histogram.bin").alias("first_bin"),
        )
    )


_PAIR = f"""SELECT coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, a.v AS a, b.v AS b FROM
    (SELECT r, c, max(v) AS v FROM ({sql_raw(missing=True)}) WHERE source = 'chirps' GROUP BY r, c) a
    FULL OUTER JOIN (SELECT r, c, max(v) AS v FROM ({sql_raw(missing=True)}) WHERE source = 'merge' GROUP BY r, c) b
    ON a.r = b.r AND a.c = b.c"""


def _pair(spark, sf_dir):
    cells = raw_cells(spark, sf_dir, missing=True)
    one = lambda s: cells.filter(F.col("source") == s).groupBy("row", "col").agg(F.max("value").alias("value"))
    return raster.raster_align(one("chirps"), one("merge"))


@query(
    "raster_align",
    f"""SELECT CAST(r AS BIGINT) AS "row", CAST(c AS BIGINT) AS col, coalesce(CAST(a AS DOUBLE), -9999) AS a,
        coalesce(CAST(b AS DOUBLE), -9999) AS b FROM ({_PAIR})""",
)
def raster_align(spark, sf_dir):
    pair = _pair(spark, sf_dir)
    return out(pair.withColumns({c: values.missing_to_sentinel(c) for c in ("a", "b")}))


@query(
    "raster_compare",
    f"""SELECT CAST(max(abs(a - b)) AS DOUBLE) AS max_abs, round(avg(CAST(abs(a - b) AS DOUBLE)), 6) AS mean_abs,
        count(CASE WHEN abs(a - b) > 0.001 THEN 1 END) AS n_different,
        round(100.0::DOUBLE * count(CASE WHEN abs(a - b) > 0.001 THEN 1 END) / count(*), 6) AS pct_different FROM ({_PAIR})""",
)
def raster_compare(spark, sf_dir):
    stats = raster.raster_diff_stats(_pair(spark, sf_dir))
    return out(stats.withColumns({c: F.round(c, 6) for c in ("mean_abs", "pct_different")}))


_TWO_DAYS = f"""SELECT coalesce(a.source, b.source) AS source, a.v AS a, b.v AS b FROM
    (SELECT * FROM ({sql_cube(by_source=True, missing=True)}) WHERE d = DATE '1998-04-15') a FULL OUTER JOIN
    (SELECT * FROM ({sql_cube(by_source=True, missing=True)}) WHERE d = DATE '1998-10-16') b
    ON a.source = b.source AND a.r = b.r AND a.c = b.c"""


@query(
    "raster_compare_days",
    f"""SELECT source, CAST(max(abs(a - b)) AS DOUBLE) AS max_abs, round(avg(CAST(abs(a - b) AS DOUBLE)), 6) AS mean_abs,
        count(CASE WHEN abs(a - b) > 0.001 THEN 1 END) AS n_different,
        round(100.0::DOUBLE * count(CASE WHEN abs(a - b) > 0.001 THEN 1 END) / count(*), 6) AS pct_different
        FROM ({_TWO_DAYS}) GROUP BY source""",
)
def raster_compare_days(spark, sf_dir):
    """Two days of each source against each other."""
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    stats = reports.raster_compare(cells, "1998-04-15", "1998-10-16", keys=("source",))
    return out(stats.withColumns({c: F.round(c, 6) for c in ("mean_abs", "pct_different")}))


@query(
    "validate_granule",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, CASE WHEN source = 'temp' AND day(d) = 1 THEN 'no_crs'
        WHEN count(CASE WHEN v - 30 >= 0 THEN 1 END) = 0 THEN 'no_valid_value' ELSE 'ok' END AS status
        FROM ({sql_cube(by_source=True, missing=True)}) GROUP BY source, d""",
)
def validate_granule(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    bare = (F.col("source") == "temp") & (F.day("date") == 1)
    cells = cells.withColumns(
        {"value": F.col("value") - F.lit(30).cast("float"), "crs": F.when(~bare, "EPSG:4326")}
    )
    return out(raster.validate_granules(cells))


def _overview_sql(k):
    return f"""SELECT source, CAST(y AS BIGINT) AS year, CAST({k} AS BIGINT) AS level, r >> {k} AS "row", c >> {k} AS col,
        coalesce(CAST(CAST(sum(CAST(v AS DOUBLE)) / nullif(count(v), 0) AS FLOAT) AS DOUBLE), -9999) AS value FROM (
          SELECT source, year(d) AS y, r, c, v FROM ({sql_cube(by_source=True, missing=True)})) GROUP BY ALL"""


@query("overviews", " UNION ALL ".join(f"({_overview_sql(k)})" for k in (1, 2, 3)))
def overviews(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    levels = raster.overviews(cells, 3, keys=("source", "year"))
    return out(levels.withColumn("value", values.missing_to_sentinel("value")))


_VIEW = f"""SELECT source, d, r, c, v, least(CAST(trunc(px) AS INTEGER), 59) AS x, least(CAST(trunc(py) AS INTEGER), 39) AS y, px, py FROM (
    SELECT *, (lon + 75) / 41.5::DOUBLE * 60 AS px, (6.5::DOUBLE - lat) / 41.5::DOUBLE * 40 AS py
    FROM ({sql_cube(by_source=True, missing=True)}) WHERE lat BETWEEN -35 AND 6.5 AND lon BETWEEN -75 AND -33.5)"""


@query(
    "map_window",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y,
        coalesce(CAST(v AS DOUBLE), -9999) AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY source, d, x, y ORDER BY pow(px - x - 0.5::DOUBLE, 2) + pow(py - y - 0.5::DOUBLE, 2), r, c) AS n
        FROM ({_VIEW})) WHERE n = 1""",
)
def map_window(spark, sf_dir):
    view = mapview.map_window(
        cube(spark, sf_dir, by_source=True, missing=True), BBox(**STUDY_AREA), 60, 40
    )
    return out(view.withColumn("value", values.missing_to_sentinel("value")))


@query(
    "map_view",
    f"""SELECT source, CAST(d AS VARCHAR) AS date, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y,
        coalesce(CAST(v AS DOUBLE), -9999) AS value, {_ramp_sql("precipitation", "v")} AS color,
        CASE WHEN v IS NULL THEN CAST(0 AS DOUBLE) WHEN v < 1 THEN CAST(v AS DOUBLE) ELSE 1 END AS opacity FROM (
        SELECT *, row_number() OVER (PARTITION BY source, d, x, y ORDER BY pow(px - x - 0.5::DOUBLE, 2) + pow(py - y - 0.5::DOUBLE, 2), r, c) AS n
        FROM ({_VIEW})) WHERE n = 1 AND d = DATE '1998-04-15'""",
)
def map_view(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True, missing=True)
    view = maps.map_view(cells, "1998-04-15", width=60, height=40)
    return out(view.withColumn("value", values.missing_to_sentinel("value")))


@query(
    "tile_ids",
    f"""SELECT {TILE} AS tile_id, count(*) AS n_cells, count(DISTINCT r * 83 + c) AS n_places
        FROM ({sql_cube(by_source=True)}) GROUP BY 1""",
)
def tile_ids(spark, sf_dir):
    cells = cube(spark, sf_dir, by_source=True)
    # Places are made distinct first, so that no tile counts its cells in one task.
    places = cells.groupBy("tile_id", "row", "col").agg(F.count("*").alias("n"))
    return out(
        places.groupBy("tile_id").agg(
            F.sum("n").alias("n_cells"), F.count("*").alias("n_places")
        )
    )
