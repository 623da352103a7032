"""Appending events: validation, ids, first-writer-wins keys, and the work that events make."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.schema import Schema, fits_column

#: Rows numbered by one task, about.
ROWS_PER_TASK = 1_000_000
#: Ranges (16 bytes each) whose first numbers are broadcast; more are joined.
BROADCAST_RANGES = 100_000


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp with or without zone, rounded down, whatever the session's zone."""
    return F.floor(F.unix_micros(F.concat(ts.cast("string"), F.lit("Z")).cast("timestamp")) / 1000).cast("long")


def numbered(df: DataFrame, key: str, *ties: str, first: int = 1, into: str = "n") -> DataFrame:
    """Dense numbers in the order of ``key`` and ``ties``, without sorting everything in one task.

    Rows that are more than one task's are dealt out by ranges of the order, equal rows too, and written to
    the checkpoint folder; each range is numbered by itself and starts where the ones before it end. The
    driver sees one count per range of ``ROWS_PER_TASK`` rows.
    """
    n = df.count()
    parts = -(-n // ROWS_PER_TASK)
    if parts <= 1:
        order = Window.partitionBy(F.lit(0)).orderBy(key, *ties)
        return df.withColumn(into, (F.row_number().over(order) + F.lit(first - 1)).cast("long"))
    spark = df.sparkSession
    _checkpointed(spark)
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(parts, key, *ties, "__tie").sortWithinPartitions(key, *ties, "__tie").drop("__tie")
    # the range and the place in it: once written, they stay
    ranged = ranged.withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    at, starts = first, []
    for r in sorted(ranged.groupBy(part.alias("part")).count().collect()):
        starts.append((r[0], at))
        at += r[1]
    begins = spark.createDataFrame(starts, "__part long, __first long")
    begins = F.broadcast(begins) if len(starts) <= BROADCAST_RANGES else begins
    return ranged.join(begins, part == F.col("__part")).withColumn(into, (place + F.col("__first")).cast("long")).drop("__at", "__part", "__first")


def _checkpointed(spark) -> None:
    """Checkpoints go to the folder that the session names; one process without any takes a folder of its machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(place or os.path.join(tempfile.gettempdir(), "tidemill-checkpoints"))


def validity(df: DataFrame, schemas: Mapping[str, Schema], name: str = "event_name", payload: str = "payload_json") -> Column:
    """Null if the row's payload fits its name's schema, else what is wrong with it."""
    wrong = F.concat(F.lit(f"unknown {name}: "), F.coalesce(F.col(name), F.lit("null")))
    for k, schema in schemas.items():
        bad = F.concat(F.lit("invalid payload of "), F.lit(k))
        wrong = F.when(F.col(name) == k, F.when(~fits_column(schema, F.col(payload)), bad)).otherwise(wrong)
    return wrong


def validated(df: DataFrame, schemas: Mapping[str, Schema], name: str = "event_name", payload: str = "payload_json") -> DataFrame:
    """The rows as they are; the first one that doesn't fit fails the job, before anything is committed.

    Validation comes before dedupe: a duplicate with a bad payload fails too.
    """
    wrong = validity(df, schemas, name, payload)
    return df.withColumn(payload, F.when(wrong.isNull(), F.col(payload)).otherwise(F.raise_error(wrong).cast("string")))


def winners(log: DataFrame, key: str = "dedupe_key", order: str = "event_id") -> DataFrame:
    """The first row of each key; rows without a key all win. A hot key is reduced before the shuffle."""
    rest = [c for c in log.columns if c != order]
    first = log.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(order, *rest)).alias("w"))
    return first.select("w.*").select(log.columns).unionByName(log.where(F.col(key).isNull()))


def resolution(log: DataFrame, key: str = "dedupe_key", order: str = "event_id") -> DataFrame:
    """``attempt_id, winner_event_id, created`` of every attempt."""
    first = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("winner"))
    joined = log.join(first, key, "left")
    winner = F.coalesce("winner", order)
    return joined.select(F.col(order).alias("attempt_id"), winner.alias("winner_event_id"), (winner == F.col(order)).alias("created"))


def fresh(batch: DataFrame, live: DataFrame) -> DataFrame:
    """The batch's winners whose key no live event or signal has."""
    taken = live.where("dedupe_key is not null").select("dedupe_key")
    return winners(batch).join(taken, "dedupe_key", "left_anti").select(batch.columns)


@dataclass(frozen=True)
class Route:
    """A declared handler: events of this name make one work item in ``queue``."""

    event_name: str
    queue: str
    ordinal: int = 0
    delay_ms: int = 0
    when: str | None = None  # SQL over the event's columns
    payload: str | None = None  # SQL; the event's payload if None


def route_table(spark: SparkSession, routes: Sequence[Route]) -> DataFrame:
    """The plain routes as rows; a few, and counted by their declaration."""
    rows = [(r.event_name, r.ordinal, r.queue, r.delay_ms) for r in routes]
    return spark.createDataFrame(rows, "event_name string, ordinal int, queue_name string, delay_ms long")


def routed(events: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """The work that events make, in (event_id, ordinal) order, not numbered yet.

    Routes are literals of the plan: each event is expanded where it is, without a shuffle or join.
    """
    made = [
        F.when(
            (F.col("event_name") == r.event_name) & (F.expr(r.when) if r.when else F.lit(True)),
            F.struct(
                F.lit(r.ordinal).alias("ordinal"),
                F.lit(r.queue).alias("queue_name"),
                (F.expr(r.payload) if r.payload else F.col("payload_json")).alias("work_payload"),
                (F.col("ts_ms") + r.delay_ms).alias("available_at_ms"),
            ),
        )
        for r in routes
    ]
    kind = "struct<ordinal:int,queue_name:string,work_payload:string,available_at_ms:bigint>"
    every = F.array(*made) if made else F.array().cast(f"array<{kind}>")
    rows = events.withColumn("r", F.explode(F.filter(every, lambda x: x.isNotNull())))
    return rows.select(
        "r.queue_name", F.col("r.work_payload").alias("payload_json"), F.col("event_id").alias("source_event_id"), "signal", "r.available_at_ms", "r.ordinal"
    )


def materialized(events: DataFrame, routes: Sequence[Route], first_work_id: int = 1) -> DataFrame:
    """``routed`` with dense work ids."""
    work = numbered(routed(events, routes), "source_event_id", "ordinal", first=first_work_id, into="work_id")
    return work.withColumn("work_id", F.col("work_id").cast("long")).select(
        "work_id", "queue_name", "payload_json", "source_event_id", "signal", "available_at_ms"
    )


def gated(events: DataFrame, keys: DataFrame, on: str, queue: str) -> DataFrame:
    """A handler's query that decides on enqueueing, over a projection that the batch doesn't change."""
    return events.join(keys.select(on).distinct(), on, "left_semi").select(F.col("event_id").alias("source_event_id"), F.lit(queue).alias("queue_name"))
