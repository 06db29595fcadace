"""Which days of a source are overdue, kept up to date as its files arrive.

``operators.calendar.missing_dates`` compares whole tables.  Here a source keeps its own
list between batches: a day is overdue once the clock has passed it by the lag its source
publishes with, and no longer so when it arrives.  The clock is the watermark of the
arrival times, so a replay gives the same days as the first run.

State of a source, all bounded by its calendar: its period and the first day not yet due,
the days that came before they were due, the overdue ones.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

CHANGES = "source string, date date, change int"
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS = 86_400_000
_EPOCH = dt.date(1970, 1, 1)


def _due(day: int, lag: int) -> int:
    """First millisecond at which a day that has not come is overdue."""
    return (day + lag) * _DAY_MS + 1


class _Gaps(StatefulProcessor):
    """Days are numbers since 1970."""

    def init(self, handle) -> None:
        self._handle = handle
        self._plan = handle.getValueState("plan", "next int, first int, last int, lag int")
        self._early = handle.getMapState("early", "day int", "here boolean")
        self._overdue = handle.getMapState("overdue", "day int", "open boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        first, last, lag = int(row["first"]), int(row["last"]), int(row["lag"])
        if first <= last:
            self._plan.update((first, first, last, lag))
            self._handle.registerTimer(_due(first, lag))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        plan = self._plan.get() if self._plan.exists() else None
        seen: set[int] = set()
        came = []
        for batch in rows:
            for day in set(batch["day"].tolist()) - seen if plan else ():
                seen.add(day)
                if plan[1] <= day <= plan[2]:
                    if day >= plan[0]:
                        self._early.updateValue((day,), (True,))
                    elif self._overdue.containsKey((day,)):
                        self._overdue.removeKey((day,))
                        came.append(day)
        yield _changes(key, came, -1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day, first, last, lag = self._plan.get()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        late = []
        while day <= last and _due(day, lag) <= now:
            if self._early.containsKey((day,)):
                self._early.removeKey((day,))
            else:
                self._overdue.updateValue((day,), (True,))
                late.append(day)
            day += 1
        self._plan.update((day, first, last, lag))
        if day <= last:
            self._handle.registerTimer(_due(day, lag))
        yield _changes(key, late, 1)

    def close(self) -> None:
        pass


def _changes(key, days: list[int], change: int) -> pd.DataFrame:
    dates = [_EPOCH + dt.timedelta(days=d) for d in days]
    return pd.DataFrame({"source": pd.Series([key[0]] * len(days), dtype="object"),
                         "date": pd.Series(dates, dtype="object"),
                         "change": pd.Series([change] * len(days), dtype="int32")})


def _once_a_batch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A day has thousands of files, all of one source: most go before the shuffle."""
    for batch in batches:
        yield from pa.Table.from_batches([batch]).group_by(["source", "day"]).aggregate([]).to_batches()


def gap_changes(arrivals: DataFrame, windows: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Days that become overdue (``change`` 1) and overdue days that arrive (-1).

    ``arrivals`` is a stream of ``source, date, arrived_at``; ``windows`` a table of
    ``source, start_date, end_date, lag_days`` with a row for each source, also for one of
    which nothing arrives.  No row is dropped for being late: the watermark, ``delay``
    behind the latest arrival, only tells the time.  Repeated arrivals, days outside the
    period, sources without a window and NULLs change nothing; a period the wrong way
    round has no days.
    """
    # Without its time column a row can't be taken for a late one.
    named = arrivals.filter("source IS NOT NULL AND date IS NOT NULL")
    if named.schema["arrived_at"].dataType == T.TimestampNTZType():
        # A time without a zone is one of UTC, as days are, whatever the session's zone.
        utc = F.concat(F.col("arrived_at").cast("string"), F.lit("Z")).cast("timestamp")
        named = named.withColumn("arrived_at", utc)
    days = named.withWatermark("arrived_at", delay)
    days = days.select("source", F.unix_date("date").alias("day"))
    days = days.mapInArrow(_once_a_batch, days.schema)
    periods = windows.filter("source IS NOT NULL").groupBy("source").agg(
        F.min(F.unix_date("start_date")).alias("first"),
        F.max(F.unix_date("end_date")).alias("last"),
        F.max("lag_days").cast("int").alias("lag"),
    ).dropna()
    return days.groupBy("source").transformWithStateInPandas(
        _Gaps(), CHANGES, "Append", "EventTime", initialState=periods.groupBy("source")
    )


def track_gaps(
    arrivals: DataFrame, windows: DataFrame, out_path: str, checkpoint: str, delay: str = "0 seconds"
) -> StreamingQuery:
    """Writes ``gap_changes`` as Parquet.  ``windows`` counts when the checkpoint is new."""
    spark = arrivals.sparkSession
    # The query copies the session's settings when it starts; the caller's stay.
    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, _ROCKS)
    try:
        return (
            gap_changes(arrivals, windows, delay)
            .writeStream.format("parquet")
            .option("path", out_path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(_STATE_STORE, before)


def overdue_days(changes: DataFrame) -> DataFrame:
    """Days overdue after all ``changes``: ``source, date``."""
    net = changes.groupBy("source", "date").agg(F.sum("change").alias("net"))
    return net.filter("net > 0").select("source", "date")
