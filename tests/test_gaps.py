"""Overdue days of a stream of arrivals, against a plain replay."""

import datetime as dt
import random

from pyspark.sql import functions as F

from terracell.streaming import overdue_days, track_gaps

ARRIVALS = "source string, date date, arrived_at timestamp_ntz"
WINDOWS = "source string, start_date date, end_date date, lag_days int"


def day(n):
    return dt.date(2021, 1, 1) + dt.timedelta(days=n)


def at(n, hours=0):
    return dt.datetime(2021, 1, 1) + dt.timedelta(days=n, hours=hours)


def run(spark, tmp_path, batches, windows, **kw):
    """Each batch is one run over the folder, as a job started anew every time."""
    inbox, hits, check = (str(tmp_path / p) for p in ("in", "out", "check"))
    spark.createDataFrame([], ARRIVALS).write.parquet(inbox)
    table = spark.createDataFrame(windows, WINDOWS)
    for rows in batches:
        spark.createDataFrame(rows, ARRIVALS).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(ARRIVALS).parquet(inbox)
        track_gaps(stream, table, hits, check, **kw).awaitTermination()
    return spark.read.schema("source string, date date, change int").parquet(hits)


def rows_of(df):
    return sorted((r.source, r.date) for r in df.collect())


def test_overdue_then_arrived(spark, tmp_path):
    windows = [("a", day(0), day(9), 2), ("silent", day(0), day(1), 3), ("backwards", day(5), day(1), 0)]
    first = [("a", day(0), at(1)), ("a", day(2), at(5)), ("a", day(2), at(5)), ("b", day(1), at(5)),
             (None, day(1), at(2)), ("a", None, at(2)), ("a", day(99), at(3))]
    changes = run(spark, tmp_path, [first, [("a", day(1), at(6)), ("a", day(0), at(6))]], windows)
    logged = sorted((r.source, r.date, r.change) for r in changes.collect())
    # At the end of the fifth day days 0 to 2 of "a" are due, and both of "silent" after it.
    assert [(s, d, c) for s, d, c in logged if s == "a"] == [
        ("a", day(1), -1), ("a", day(1), 1), ("a", day(3), 1)]
    assert rows_of(overdue_days(changes)) == [("a", day(3)), ("silent", day(0)), ("silent", day(1))]


def test_settings_of_the_session_stay(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    changes = run(spark, tmp_path, [[]], [("a", day(0), day(3), 1)])
    assert changes.count() == 0 and spark.conf.get(name) == before


def test_against_a_replay(spark, tmp_path):
    """Any split into batches ends with the days that are due and have not come."""
    rng = random.Random(1)
    lags = {"a": 3, "b": 7, "c": 0}
    windows = [(s, day(0), day(40), lag) for s, lag in lags.items()]
    rows = [(rng.choice("ab"), day(rng.randrange(-2, 45)), at(rng.randrange(0, 50), rng.randrange(1, 24)))
            for _ in range(80)]
    rows.sort(key=lambda r: r[2])
    batches = [rows[:20], rows[20:25], rows[25:70], rows[70:]]
    changes = run(spark, tmp_path, batches, windows, delay="12 hours")
    now = rows[-1][2] - dt.timedelta(hours=12)
    came = {(s, d) for s, d, _ in rows}
    expected = sorted((s, day(n)) for s, lag in lags.items() for n in range(41)
                      if at(n + lag) < now and (s, day(n)) not in came)
    assert rows_of(overdue_days(changes)) == expected
    per_day = changes.groupBy("source", "date").agg(F.sum("change").alias("n")).filter("n NOT IN (0, 1)")
    assert per_day.count() == 0
