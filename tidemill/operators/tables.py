"""The log's tables.

``events`` only grows. ``work`` holds transitions: a row per change of a work item, of which the one
with the largest ``seq`` is its state, and ``gone`` marks an acknowledged one. ``pruned`` lists
signals that are no longer live. ``projections`` holds rows of keyed projections, of which the one with
the largest ``seq`` counts. Nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("payload_json", T.StringType()),
        T.StructField("causation_event_id", T.LongType()),
        T.StructField("dedupe_key", T.StringType()),
        T.StructField("signal", T.IntegerType()),
    ]
)
WORK = T.StructType(
    [
        T.StructField("work_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("queue_name", T.StringType()),
        T.StructField("payload_json", T.StringType()),
        T.StructField("source_event_id", T.LongType()),
        T.StructField("signal", T.IntegerType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("available_at_ms", T.LongType()),
        T.StructField("lease_id", T.StringType()),
        T.StructField("lease_acquired_at_ms", T.LongType()),
        T.StructField("lease_expires_at_ms", T.LongType()),
        T.StructField("dead", T.IntegerType()),
        T.StructField("last_error", T.StringType()),
        T.StructField("gone", T.BooleanType()),
    ]
)
PRUNED = T.StructType([T.StructField("event_id", T.LongType())])
PROJECTIONS = T.StructType(
    [
        T.StructField("projection", T.StringType()),
        T.StructField("key_json", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("row_json", T.StringType()),
    ]
)
SCHEMAS = {"events": EVENTS, "work": WORK, "pruned": PRUNED, "projections": PROJECTIONS}
#: What a column holds in files that were written before it was there.
DEFAULTS = {"signal": 0, "attempt": 0, "dead": 0, "gone": False}
#: The column of each table that single rows are looked up by.
KEYS = {"events": "dedupe_key", "projections": "key_json", "work": "work_id"}
#: What a row of a table is the state of, for tables whose last row counts.
LAST = {"work": ("work_id",), "projections": ("key_json", "projection")}


def live_events(events: DataFrame, pruned: DataFrame) -> DataFrame:
    return events.join(pruned, "event_id", "left_anti")


def last_of(table: str, rows: DataFrame, whole: bool) -> DataFrame:
    """The rows that still say something: each key's last one, partly summed before the shuffle; every event and pruned id.

    ``whole`` says that no other rows of the table exist, so that acknowledged work can go.
    """
    if table not in LAST:
        return rows.sort("event_id")
    keys = LAST[table]
    rest = [c for c in SCHEMAS[table].names if c not in (*keys, "seq")]
    last = rows.groupBy(*keys).agg(F.max(F.struct("seq", *rest)).alias("t")).select(*keys, "t.*")
    if whole and table == "work":
        last = last.where(~F.coalesce("gone", F.lit(False)))
    return last.select(SCHEMAS[table].names)


def current_work(transitions: DataFrame) -> DataFrame:
    """Every work item's last transition, without acknowledged ones."""
    return last_of("work", transitions, whole=True)


def state_of(work: DataFrame) -> DataFrame:
    """``state``: dead, leased or ready."""
    state = F.when(F.col("dead") == 1, "dead").when(F.col("lease_id").isNotNull(), "leased").otherwise("ready")
    return work.withColumn("state", state)
