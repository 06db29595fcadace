"""Idempotent appends and duplicate handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terracell.operators.sides import per_day_side

DAY = ("source", "date")
CELL = ("source", "date", "row", "col")


def last_per_day(df: DataFrame, keys=CELL, order=("ts",)) -> DataFrame:
    """One row per key, the last by ``order``.

    A maximum over (order, rest of the row): it is pre-aggregated before the shuffle,
    so a key with a great many copies costs one row per task.  Rows that tie in
    ``order`` are settled by the rest of the row.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not order and len(rest) == 1:
        # The same maximum, of a plain column: a hash aggregate instead of a sort.
        return df.groupBy(*keys).agg(F.max(rest[0]).alias(rest[0])).select(*df.columns)
    last = F.max(F.struct(*order, *rest)).alias("_last")
    picked = df.groupBy(*keys).agg(last).select(*keys, "_last.*")
    return picked.select(*df.columns)


def new_rows(existing: DataFrame, new: DataFrame, keys=DAY) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing`` yet."""
    keys = list(keys)
    seen = existing.select(*keys).distinct()
    if set(keys) <= set(DAY):
        seen = per_day_side(seen)
    return new.join(seen, keys, "left_anti")


def dedup_append(existing: DataFrame, new: DataFrame, keys=DAY) -> DataFrame:
    """Existing rows and the new ones with unseen keys; running it twice adds nothing."""
    return existing.unionByName(new_rows(existing, new, keys))


def restrict_dates(df: DataFrame, days: DataFrame) -> DataFrame:
    """Rows on the listed days (per source where the list names one).  The hint also
    lets Spark drop the other days before an aggregation over the day, not after it."""
    keys = ["source", "date"] if "source" in days.columns else ["date"]
    return df.join(per_day_side(days.select(*keys).distinct()), keys, "left_semi")


def concat_time(*tables: DataFrame) -> DataFrame:
    """Tables of the same columns one after the other, columns matched by name."""
    result = tables[0]
    for t in tables[1:]:
        result = result.unionByName(t)
    return result
