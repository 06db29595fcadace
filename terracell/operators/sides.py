"""Which join sides may be broadcast.

Spark broadcasts a side whose estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, and adaptive
execution splits hot keys; almost every join here leaves it at that.  The exceptions
are tables with one row for each source and day, which the calendar bounds, and tables
whose rows were spelled out, which Spark estimates at their size before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def per_day_side(days: DataFrame) -> DataFrame:
    """Hint for a side that was just reduced to one row per source and day.

    Sources are a short catalog and a century has 36,525 days, so such a side is a
    few megabytes whatever the size of the cells it came from.  Spark estimates it
    at the size of those cells and would shuffle them instead.
    """
    return F.broadcast(days)


MOST_SPELLED = 100_000  # rows of a spelled-out side that Spark may broadcast, some ten megabytes


def spelled_side(rows: DataFrame) -> DataFrame:
    """A side with rows made by ``explode``: shuffled if they are many.

    Spark estimates such a side at the size of what it was made from, so it would send
    any multiple of the broadcast threshold through the driver.  Rows are counted up to
    the bound; a hint is all that is added.
    """
    if rows.isStreaming or rows.limit(MOST_SPELLED + 1).count() <= MOST_SPELLED:
        return rows
    return rows.hint("merge")
