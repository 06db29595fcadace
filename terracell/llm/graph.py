"""Connected components by alternating stars, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terracell.llm.store import checkpointed, free, shuffled


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of ``edges(a, b)`` with the smallest node it can reach.

    Nodes without an edge are not returned; loops and rows with a null end are ignored,
    repeated edges count once.  Every round ties all neighbours of a node to the
    smallest one, first the larger neighbours, then the smaller, so depths shrink
    geometrically; a node with very many neighbours is an aggregation with map-side
    combine and a join whose hot side adaptive execution splits.  Each round is
    written to the shared folder, and then takes the place of the round before.
    """
    edges = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct()
    edges, mark = _kept(edges)
    while mark[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        old, tied = edges, _tied(both, larger=True)
        edges, now = _kept(_tied(tied.select(F.col("hi").alias("u"), F.col("lo").alias("v")), larger=False))
        free(old)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def _kept(edges: DataFrame):
    edges = checkpointed(edges)
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))"), F.expr("bit_xor(xxhash64(lo, hi))")).first()
    return edges, tuple(row)


def _tied(pairs: DataFrame, larger: bool) -> DataFrame:
    """Edges (hi, lo) that tie the neighbours v of u to the smallest of them and u."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(shuffled(least), "u")
    if larger:
        tied = joined.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        tied = joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(
            least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))
        )
    return tied.where("hi != lo").distinct()
