"""The fixture log over the ``events`` table: how its rows become events, keys, routes and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import append

DAY_MS = 86_400_000
ROUTES = (
    append.Route("purchase", "q.fulfil", 0, 0),
    append.Route("purchase", "q.receipt", 1, DAY_MS),
    append.Route("signup", "q.welcome", 0, 0),
    append.Route("view", "sq.notice", 0, 0),
)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are signals; a user's event of one type and properties has one key."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        (F.col("event_id") + 1).alias("event_id"),
        append.epoch_ms(F.col("ts")).alias("ts_ms"),
        F.col("event_type").alias("event_name"),
        "user_id",
        F.col("props").alias("payload_json"),
        F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type", F.lit(":"), "props").alias("dedupe_key"),
        (F.col("event_type") == "view").cast("int").alias("signal"),
    )


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append.materialized(append.winners(log(spark, sf_dir)), ROUTES)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work with a state from its id: one in ten dead, one leased, one acknowledged."""
    d = F.col("work_id") % 10
    return work(spark, sf_dir).withColumn("state", F.when(d == 0, "dead").when(d == 1, "leased").when(d == 2, "acked").otherwise("ready"))


def as_items(st: DataFrame) -> DataFrame:
    """The work table's columns for fixture states."""
    leased = F.col("state") == "leased"
    return st.where("state <> 'acked'").select(
        "work_id",
        F.lit(1).cast("long").alias("seq"),
        "queue_name",
        "payload_json",
        "source_event_id",
        "signal",
        F.when(F.col("state") == "ready", 0).otherwise(1).alias("attempt"),
        "available_at_ms",
        F.when(leased, F.concat(F.lit("lease-"), F.col("work_id").cast("string"))).alias("lease_id"),
        F.lit(None).cast("long").alias("lease_acquired_at_ms"),
        F.lit(None).cast("long").alias("lease_expires_at_ms"),
        (F.col("state") == "dead").cast("int").alias("dead"),
        F.lit(None).cast("string").alias("last_error"),
        F.lit(False).alias("gone"),
    )


def now(log_df: DataFrame) -> int:
    return log_df.agg(F.max("ts_ms")).first()[0] or 0


_EM = "epoch_us(ts)//1000"
_LOG = f"""log AS (SELECT event_id+1 AS event_id, {_EM} AS ts_ms, event_type AS event_name, user_id, props AS payload_json,
 concat(CAST(user_id AS VARCHAR),':',event_type,':',props) AS dedupe_key, CASE WHEN event_type='view' THEN 1 ELSE 0 END AS signal FROM events)"""
_WIN = "win AS (SELECT * FROM (SELECT l.*, ROW_NUMBER() OVER (PARTITION BY dedupe_key ORDER BY event_id) AS rn FROM log l) x WHERE rn=1)"
_WORK = f"""{_WIN}, work AS (SELECT ROW_NUMBER() OVER (ORDER BY w.event_id, r.ord) AS work_id, r.queue_name, w.payload_json, w.event_id AS source_event_id, w.signal,
 w.ts_ms + r.delay_ms AS available_at_ms FROM win w JOIN (SELECT * FROM (VALUES ('purchase',0,'q.fulfil',0),('purchase',1,'q.receipt',86400000),
 ('signup',0,'q.welcome',0),('view',0,'sq.notice',0)) v(event_name,ord,queue_name,delay_ms)) r ON w.event_name=r.event_name)"""
_STATE = f"""{_WORK}, st AS (SELECT work_id,queue_name,source_event_id,signal,available_at_ms,
 CASE work_id % 10 WHEN 0 THEN 'dead' WHEN 1 THEN 'leased' WHEN 2 THEN 'acked' ELSE 'ready' END AS state FROM work)"""
_NOW = "(SELECT MAX(ts_ms) FROM log)"
SQL = {"LOG": _LOG, "WIN": _WIN, "WORK": _WORK, "STATE": _STATE, "NOW": _NOW}
