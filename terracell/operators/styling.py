"""Styles as tables.  For a style known in advance see ``functions.palette``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from terracell.functions.palette import STYLES
from terracell.schema import STYLE_SCHEMA


def style_table(spark: SparkSession, names=None) -> DataFrame:
    """Stops of the built-in styles, as a relation Spark knows the size of."""
    rows = [
        F.struct(
            *[
                F.lit(v).cast(f.dataType).alias(f.name)
                for f, v in zip(STYLE_SCHEMA, (name, q, color, label, opacity))
            ]
        )
        for name in (names or STYLES)
        for q, color, label, opacity in STYLES[name]
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def next_stop(style: DataFrame) -> DataFrame:
    """Each stop with the quantity of the one above it (NULL for the last)."""
    order = Window.partitionBy("style").orderBy("quantity")
    return style.withColumn("next_quantity", F.lead("quantity").over(order))


def style_join(values: DataFrame, style: DataFrame) -> DataFrame:
    """Values (with ``style``) to the stop whose interval holds them.

    The style name is an equality key and the interval is tested on a name's few
    stops.  Values under the first stop and missing values keep NULLs.
    """
    stops = next_stop(style).withColumnRenamed("style", "_style")
    v = F.col("value").cast("double")
    inside = (v >= F.col("quantity")) & (
        F.col("next_quantity").isNull() | (v < F.col("next_quantity"))
    )
    return values.join(stops, (F.col("style") == F.col("_style")) & inside, "left").drop("_style")
