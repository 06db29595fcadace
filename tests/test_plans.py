"""Physical plans: what is pruned, pushed, shuffled and broadcast."""

import pytest
from pyspark.sql import functions as F

from tests.test_jobs import BOX, GRID, days_of_cells
from terracell.operators import aggregates, filters, lookup, raster
from terracell.plans import areas, points
from terracell.sources import archive as store, tiledays


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "archive")
    store.write_archive(days_of_cells(spark, "2019-12-30", 4), path)
    return store.scan_archive(spark, path)


def test_time_range_prunes_partitions(archive, plan_of):
    plan = plan_of(filters.time_range(archive, "2020-01-01", "2020-06-30"))
    assert "PartitionFilters: [isnotnull(year" in plan and "year#" in plan


def test_one_area_is_a_filtered_scan(archive, plan_of):
    df = areas.area_exceedances(archive, GRID, -9.0, -50.0, 300.0, "2020-01-01", "2020-01-02", 0.5, "chirps")
    plan = plan_of(df)
    assert "Exchange" not in plan and "Join" not in plan
    for pushed in ("In(tile_id", "GreaterThan(value", "GreaterThanOrEqual(row"):
        assert pushed in plan
    assert "source#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert df.count() > 0


def test_one_site_is_a_filtered_scan(archive, plan_of):
    plan = plan_of(points.site_series(archive, GRID, -3.0, -55.0, "2020-01-01", "2020-01-02", "chirps"))
    assert "Exchange" not in plan and "EqualTo(tile_id" in plan and "EqualTo(row" in plan


def _sites(spark, n):
    return spark.range(n).select(
        F.col("id").alias("site_id"), (F.lit(-3.0) - F.col("id") % 10).alias("lat"), F.lit(-55.0).alias("lon"),
        F.lit("chirps").alias("source"), F.lit(150.0).alias("radius"),
        F.lit("2020-01-01").cast("date").alias("start_date"), F.lit("2020-01-02").cast("date").alias("end_date"))


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_site_joins_are_equi_joins(spark, archive, plan_of, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for df in (lookup.point_lookup(archive, _sites(spark, 10), GRID),
                   lookup.radius_join(archive, _sites(spark, 10), GRID)):
            plan = plan_of(df)
            assert "NestedLoop" not in plan and "Cartesian" not in plan
            assert ("BroadcastHashJoin" in plan) == (threshold == "10MB")
            assert df.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_spelled_out_requests_are_not_broadcast(spark, archive, plan_of):
    """Spark sees 60,000 rows of a range, not the tiles that they are spelled out on."""
    sites = _sites(spark, 60_000).withColumns({"radius": F.lit(900.0), "trigger": F.lit(0.5), "request_id": F.col("site_id")})
    few = lookup.radius_join(archive, sites.limit(2), GRID)
    assert "BroadcastHashJoin" in plan_of(few)
    assert "BroadcastExchange" not in plan_of(lookup.radius_join(archive, sites, GRID))
    summary = tiledays.tile_days(archive)
    periods = sites.withColumn("trigger", F.col("site_id") / 120_000)  # one period: a tile meets its lowest trigger
    hot = areas.hot_tile_days(summary, periods, GRID)
    own = areas.hot_tile_days(summary, periods.filter("site_id < 10"), GRID)
    assert sorted(hot.collect()) == sorted(own.collect()) and hot.count() > 0
    rows = _rows_out(hot, "Join")
    assert rows and max(rows) <= summary.count()


def _rows_out(df, name, metric="numOutputRows"):
    """Rows out of each node of that name in a run that ends here."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan().finalPhysicalPlan(), []

    def walk(node):
        if name in node.nodeName():
            rows.append(node.metrics().apply(metric).value())
        inner = [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        for child in inner:
            walk(child)

    walk(plan)
    return rows


def test_site_years_prune_the_archive_at_run_time(spark, archive, plan_of, tmp_path):
    _sites(spark, 10).write.parquet(str(tmp_path / "sites"))
    sites = spark.read.parquet(str(tmp_path / "sites"))
    for df in (lookup.point_lookup(archive, sites, GRID), lookup.radius_join(archive, sites, GRID)):
        assert "dynamicpruningexpression(year" in plan_of(df)


def test_columns_are_pruned(archive, plan_of):
    plan = plan_of(aggregates.time_extent(archive))
    assert "ReadSchema: struct<date:date>" in plan


def test_scan_of_days_broadcasts_days_not_cells(archive, plan_of):
    plan = plan_of(filters.drop_empty_days(archive))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_aggregates_start_before_the_shuffle(archive, plan_of):
    for df in (raster.raster_stats(archive), aggregates.accumulate(archive), raster.overviews(archive, 3)):
        assert "partial_" in plan_of(df)


def test_raster_compare_keeps_sources_apart(spark):
    from terracell.plans import reports

    rows = [(s, d, 0, 0, v) for s, v in (("a", 1.0), ("b", 100.0)) for d in ("2001-01-01", "2001-01-02")]
    cells = spark.createDataFrame(rows, "source string, date string, row int, col int, value float").selectExpr(
        "source", "cast(date as date) date", "2001 year", "row", "col", "value"
    )
    got = reports.raster_compare(cells, "2001-01-01", "2001-01-02").first().asDict()
    assert got["max_abs"] == 0


def test_accumulation_of_one_source(spark):
    from terracell.plans import accumulation

    rows = [(s, "2001-01-01", 0, 0, -35.0, -75.0, v) for s, v in (("a", 1.0), ("b", 100.0))]
    cells = spark.createDataFrame(
        rows, "source string, date string, row int, col int, lat double, lon double, value float"
    ).selectExpr("source", "cast(date as date) date", "2001 year", "row", "col", "lat", "lon", "value")
    assert [r.total for r in accumulation.event_accumulation(cells, ["2001-01-01"], source="a").collect()] == [1.0]


def _archive_side(plan: str, table: str) -> str:
    """Operators between the scan of a table and the join above it, from the plan as text."""
    lines = plan.split("== Initial Plan ==")[0].splitlines()
    scan = next(k for k, line in enumerate(lines) if "FileScan parquet" in line and table in line)
    join = max(k for k, line in enumerate(lines[:scan]) if "SortMergeJoin" in line)
    depth = lambda line: next(i for i, c in enumerate(line) if c.isalpha())
    chain, level = [], depth(lines[scan]) + 1
    for line in reversed(lines[join + 1 : scan + 1]):
        if depth(line) < level:
            chain.append(line)
            level = depth(line)
    return "\n".join(chain)


@pytest.mark.parametrize("bucketed", [True, False])
def test_many_requests_move_to_the_bucketed_archive(spark, plan_of, tmp_path, bucketed):
    cells = days_of_cells(spark, "2019-12-30", 4).unionByName(days_of_cells(spark, "2019-12-30", 4, 2.0, "merge"))
    table = f"requests_in_place_{bucketed}".lower()
    path = str(tmp_path / table)
    if bucketed:
        store.write_archive_table(cells, table, 6, keys=store.REQUEST_KEYS, path=path)
    else:
        cells.write.option("path", path).saveAsTable(table)
    requests = _sites(spark, 30).withColumnRenamed("site_id", "request_id").withColumn("trigger", F.lit(0.5))
    requests = requests.withColumns({"start_date": F.lit("2019-12-31"), "end_date": F.lit("2020-01-02"),
                                     "source": F.when(F.col("request_id") % 3 == 0, "merge").otherwise("chirps")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = areas.area_triggers(spark.table(table), requests, GRID, as_of="2020-02-01")
        side = _archive_side(plan_of(found), table)
        assert ("Exchange" in side) is not bucketed, side
        direct = areas.area_triggers(cells, requests, GRID, as_of="2020-02-01")
        rows = lambda df: sorted(tuple(r) for r in df.select("request_id", "date", "latitude", "longitude").collect())
        assert rows(found) == rows(direct) != []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {table}")


def test_totals_move_words_of_days(spark):
    """Days before 1970 and none at all, too; one row for 64 days of a request is shuffled, not 64."""
    points = spark.range(0, 60_000, 1, 2).select(
        (F.col("id") % 3).alias("request_id"),
        F.when(F.col("id") % 500 != 7, F.date_add(F.lit("1969-11-01").cast("date"), (F.col("id") * F.col("id") % 640).cast("int"))).alias("date"),
    )
    totals = aggregates.exceedance_totals(points)
    days = points.groupBy("request_id").agg(
        F.count("*").alias("total_exceedances"), F.countDistinct("date").alias("n"), F.max(F.col("date").isNull().cast("int")).alias("none")
    )
    want = days.select("request_id", "total_exceedances", (F.col("n") + F.col("none")).alias("total_trigger_dates"))
    assert sorted(totals.collect()) == sorted(want.collect())
    assert 0 < max(_rows_out(totals, "Exchange", "shuffleRecordsWritten")) <= 2 * 3 * (640 // 64 + 3)
