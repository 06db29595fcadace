"""Day algebra: invariants and borders."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from terracell.functions import dates, names
from terracell.operators import append, calendar, filters, timematch

D = dt.date.fromisoformat


def days(spark, *items, source="a"):
    rows = [(source, D(i) if isinstance(i, str) else i) for i in items]
    return spark.createDataFrame(rows, "source string, date date")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_inverted_range_has_no_days(spark):
    assert one(spark, dates.days_between("2020-01-02", "2020-01-01")) == []
    assert one(spark, dates.days_between("2020-01-01", "2020-01-01")) == [D("2020-01-01")]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.integers(0, 60), min_size=1, max_size=40), st.integers(1, 9))
def test_batches_partition_the_missing_days(spark, offsets, n):
    wanted = {D("2024-02-10") + dt.timedelta(days=i) for i in offsets}
    table = days(spark, *wanted)
    batches = calendar.date_batches(table, n).collect()
    covered = []
    for b in batches:
        size = (b.end_date - b.start_date).days + 1
        assert 1 <= size <= n and size == b.n_days
        covered += [b.start_date + dt.timedelta(days=i) for i in range(size)]
    assert sorted(covered) == sorted(wanted)
    in_batch = calendar.with_batch(table, n).collect()
    assert {r.date for r in in_batch} == wanted and len(in_batch) == len(wanted)


@pytest.mark.parametrize("length,sizes", [(1, [1]), (31, [31]), (32, [1, 31])])
def test_batch_borders(spark, length, sizes):
    run = [D("2023-12-20") + dt.timedelta(days=i) for i in range(length)]
    got = [b.n_days for b in calendar.date_batches(days(spark, *run), 31).collect()]
    assert sorted(got) == sizes


def test_missing_dates_flags(spark):
    wanted = days(spark, "2020-01-01", "2020-01-02", "2020-01-03", "2020-01-04")
    got = calendar.missing_dates(
        wanted, days(spark, "2020-01-01", "2020-01-02"), days(spark, "2020-01-01", "2020-01-03")
    ).collect()
    assert {(r.date.day, r.missing_granule, r.missing_archive) for r in got} == {
        (2, False, True), (3, True, False), (4, True, True)}


def test_footprint_over_fetches_across_months(spark):
    batch = spark.createDataFrame([("a", D("2024-01-30"), D("2024-02-02"))],
                                  "source string, start_date date, end_date date")
    got = calendar.request_footprint(batch).collect()
    # Months 01, 02 times days 30, 31, 01, 02; February has no 30th.
    assert sorted(r.date.isoformat() for r in got if not r.wanted) == ["2024-01-01", "2024-01-02"]
    assert sum(r.wanted for r in got) == 4


def test_name_modes(spark):
    names_ = {
        "a_20250705_x20260101.tif": ("2025-07-05", "2026-01-01", None, None),
        "chirps_final_latam_20250710.tif": ("2025-07-10", "2025-07-10", "2025-07-10", "2025-07-10"),
        "/x/temp_max_20240229.tif": ("2024-02-29", "2024-02-29", "2024-02-29", None),
        "temp_20230229.tif": (None, None, None, None),
        "notes.tif": (None, None, None, None),
    }
    table = spark.createDataFrame([(k,) for k in names_], "path string")
    got = table.select("path", *[dates.date_from_name("path", m).alias(m) for m in dates.NAME_PATTERNS])
    for r in got.collect():
        want = [d and D(d) for d in names_[r.path]]
        assert [r["first"], r["last"], r["tail"], r["latam"]] == want


def test_default_windows(spark):
    w = lambda s, d: tuple(x.isoformat() for x in one(spark, dates.flow_window(F.lit(s), F.lit(d).cast("date"))))
    assert w("chirps", "2025-08-15") == ("2015-08-01", "2025-07-31")
    assert w("chirps", "2024-03-01") == ("2014-03-01", "2024-02-29")
    assert w("merge", "2025-01-01") == ("2024-12-01", "2024-12-31")
    assert w("era5", "2025-03-05") == ("2025-02-01", "2025-02-26")
    assert w("modis", "2024-03-31") == ("2024-02-01", "2024-02-29")


def test_append_is_idempotent(spark):
    old = days(spark, "2020-01-01", "2020-01-02").withColumn("v", F.lit(1))
    new = days(spark, "2020-01-02", "2020-01-03").withColumn("v", F.lit(2))
    once = append.dedup_append(old, new)
    twice = append.dedup_append(once, new)
    key = lambda df: sorted((r.date, r.v) for r in df.collect())
    assert key(once) == key(twice)
    assert [v for _, v in key(once)] == [1, 1, 2]


def test_date_list_none_is_all_and_empty_is_none(spark):
    table = days(spark, "2024-04-29", "2024-04-30", "2024-05-01")
    assert filters.dates_in(table, None).count() == 3
    assert filters.dates_in(table, []).count() == 0
    assert filters.dates_in(table, ["2024-04-29", "2024-05-01"]).count() == 2


def test_nearest_day(spark):
    have = days(spark, "2020-01-01", "2020-01-11", "2020-01-20")
    asked = days(spark, "2019-12-01", "2020-01-06", "2020-01-07", "2020-01-11", "2020-03-01", "2020-03-01")
    got = timematch.time_match(asked, have, "nearest").collect()
    assert sorted((r.date.isoformat(), r.matched_date.isoformat()) for r in got) == [
        ("2019-12-01", "2020-01-01"), ("2020-01-06", "2020-01-01"), ("2020-01-07", "2020-01-11"),
        ("2020-01-11", "2020-01-11"), ("2020-03-01", "2020-01-20"), ("2020-03-01", "2020-01-20")]


def test_scene_time_of_day_counts_as_its_day(spark):
    scenes = spark.sql("SELECT 'a' AS source, TIMESTAMP_NTZ '2024-05-01 13:44:10' AS ts")
    assert calendar.distinct_dates(scenes, "ts").first().date == D("2024-05-01")


def test_variable_names():
    pick = names.resolve_variable
    assert pick(["rdp", "pr"], "prec", ("rdp", "pr"), fuzzy=False) == "rdp"
    assert pick(["x", "t2m"], "2m_temperature", ("t2m",)) == "t2m"
    assert pick(["lat", "air_temperature"], "2m_temperature", ("t2m",)) == "air_temperature"
    with pytest.raises(ValueError):
        pick(["lat"], "prec", ("rdp",), fuzzy=False)
    assert names.time_attribute(["time", "lat"]) == "time"
    assert names.time_attribute(["lat"]) == "ingestion"


def test_cf_time(spark):
    got = one(spark, dates.decode_cf_time(F.lit(1.5), "days", "1980-01-01"))
    assert got == dt.datetime(1980, 1, 2, 12)


def test_bad_dates_and_statuses(spark):
    assert one(spark, dates.parse_day(F.lit("2023/01/01"))) is None
    assert one(spark, dates.parse_day(F.lit("2023-02-30"))) is None
    s = lambda a, b: one(spark, dates.ingest_status(F.lit(a).cast("date"), F.lit(b).cast("date"), F.lit("2025-03-10").cast("date")))
    assert s("2025-03-02", "2025-03-01") == "bad_range"
    assert s("2025-03-01", "2025-03-03") == "ok"
    assert s("2025-03-01", "2025-03-04") == "not_yet_published"
    assert one(spark, dates.iso_time(F.lit("2020-01-01"))) == "2020-01-01T00:00:00Z"
    assert one(spark, dates.iso_time(F.lit("20200101"))) == "20200101"
