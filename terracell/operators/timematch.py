"""Which day of a source answers a request for a day.

``requests`` and ``days`` have ``source`` and ``date``; the answer is
``matched_date`` (NULL when there is none).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from terracell.operators.sides import per_day_side

STRATEGIES = ("exact", "nearest", "minimum", "maximum", "exact_or_first")


def time_match(requests: DataFrame, days: DataFrame, strategy: str = "exact") -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    days = days.select("source", "date").distinct()
    if strategy == "nearest":
        return _nearest(requests, days)
    result = requests
    exact = F.lit(None).cast("date")
    if strategy.startswith("exact"):
        present = days.withColumn("_exact", F.col("date"))
        result = result.join(per_day_side(present), ["source", "date"], "left")
        exact = F.col("_exact")
    edge = exact
    if strategy != "exact":
        pick = F.max if strategy == "maximum" else F.min
        # One row per source.
        edges = days.groupBy("source").agg(pick("date").alias("_edge"))
        result = result.join(per_day_side(edges), "source", "left")
        edge = F.coalesce(exact, F.col("_edge"))
    return result.withColumn("matched_date", edge).drop("_exact", "_edge")


def _nearest(requests: DataFrame, days: DataFrame) -> DataFrame:
    """As-of match on both sides; of two equally near days the earlier one.

    Only the distinct wanted days go through the window, at most one row per source
    and day; the requests themselves, however many share a source, join the result.
    """
    asked = requests.select("source", "date").distinct().withColumn("_have", F.lit(None).cast("date"))
    line = asked.unionByName(days.withColumn("_have", F.col("date")))
    order = Window.partitionBy("source").orderBy("date")
    before = F.last("_have", True).over(order)
    after = F.first("_have", True).over(order.rangeBetween(0, Window.unboundedFollowing))
    near = (
        line.withColumns({"_before": before, "_after": after})
        .filter(F.col("_have").isNull())
        .withColumn(
            "matched_date",
            F.when(F.col("_before").isNull(), F.col("_after"))
            .when(F.col("_after").isNull(), F.col("_before"))
            .when(
                F.datediff("date", "_before") <= F.datediff("_after", "date"), F.col("_before")
            )
            .otherwise(F.col("_after")),
        )
        .select("source", "date", "matched_date")
    )
    return requests.join(near, ["source", "date"], "left")
