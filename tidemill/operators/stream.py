"""Ordered reads of the durable log; signals never show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def after(events: DataFrame, event_id: int, limit: int) -> DataFrame:
    """The next ``limit`` events; the filter reaches the Parquet scan and the order is a top-k."""
    return events.where("signal = 0").where(F.col("event_id") > event_id).orderBy("event_id").limit(limit)


def last(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events, oldest first."""
    return events.where("signal = 0").orderBy(F.desc("event_id")).limit(n).orderBy("event_id")


def latest_id(events: DataFrame) -> DataFrame:
    return events.where("signal = 0").agg(F.coalesce(F.max("event_id"), F.lit(0).cast("long")).alias("latest_event_id"))
