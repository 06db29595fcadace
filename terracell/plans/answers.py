"""Answers as JSON documents, one per request."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terracell.operators import aggregates
from terracell.plans.areas import area_answers
from terracell.sources.requests import answer_json


def history_documents(histories: DataFrame) -> DataFrame:
    """``plans.points.point_history`` as documents."""
    body = answer_json("lat", "lon", "source", "status", "history")
    return histories.select("request_id", body.alias("answer"))


def trigger_documents(triggers: DataFrame) -> DataFrame:
    """``plans.points.point_triggers`` as documents."""
    place = F.struct("lat", "lon").alias("location")
    fields = ("source", "start_date", "end_date", "trigger", "status")
    body = answer_json(place, *fields, "n_exceedances", "exceedances")
    return triggers.select("request_id", body.alias("answer"))


def area_documents(requests: DataFrame, points: DataFrame, **check) -> DataFrame:
    """Area requests as documents with their totals; ``area_parts`` has their points.

    The shape is the same whatever a request finds, and no document is built from an
    unbounded group.  ``points`` is read by both: give a written table where finding
    them is costly.
    """
    place = F.struct("lat", "lon", F.col("radius").alias("radius_km")).alias("location")
    trigger = F.col("trigger").alias("trigger_mm")
    fields = ("start_date", "end_date", "status", "total_exceedances", "total_trigger_dates")
    body = answer_json(place, "source", trigger, *fields)
    return area_answers(requests, points, **check).select("request_id", body.alias("answer"))


def area_parts(points: DataFrame) -> DataFrame:
    """All points as documents, one for each request, day and tile."""
    parts = aggregates.exceedances_by_date(points)
    return parts.select(
        "request_id", answer_json("request_id", "date", "tile_id", "points").alias("answer")
    )
