"""Signals: events that live while work of theirs is outstanding."""

from __future__ import annotations

from pyspark.sql import DataFrame


def held_by_lease(signals: DataFrame, leased: DataFrame) -> DataFrame:
    """Signals whose emitter (``work_id, lease_id``) still holds its lease; the others are dropped silently."""
    return signals.join(leased.where("lease_id is not null and dead = 0").select("work_id", "lease_id"), ["work_id", "lease_id"], "left_semi")


def finished(signals: DataFrame, outstanding: DataFrame) -> DataFrame:
    """Ids of live signals without outstanding signal work, dead items counting as outstanding.

    Covers both signals that never made work and those whose last item was acknowledged.
    """
    work = outstanding.where("signal = 1").select(outstanding["source_event_id"].alias("event_id"))
    return signals.where("signal = 1").join(work, "event_id", "left_anti").select("event_id")
