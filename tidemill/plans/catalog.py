"""The engine's queries over the fixture log, and DuckDB SQL that states what each returns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import cursor, retry
from tidemill.functions.schema import INTEGER, fits_column, obj
from tidemill.ledger import Ledger
from tidemill.model import define
from tidemill.operators import append, projection, signals, stream, tables
from tidemill.operators import work as machine
from tidemill.plans import fixture
from tidemill.plans.fixture import SQL
from tidemill.runtime import VirtualTime
from tidemill.sources.projection import StoredProjection

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.format(**SQL)
        return f

    return add


@query("WITH {LOG} SELECT event_id, ts_ms, event_name, payload_json FROM log")
def emit_append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.log(spark, sf_dir).select("event_id", "ts_ms", "event_name", "payload_json")


@query("WITH {LOG}, {WIN} SELECT event_id, dedupe_key FROM win")
def emit_dedupe_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append.winners(fixture.log(spark, sf_dir).select("event_id", "dedupe_key"))


@query(
    "WITH {LOG} SELECT event_id AS attempt_id, MIN(event_id) OVER (PARTITION BY dedupe_key) AS winner_event_id, "
    "event_id = MIN(event_id) OVER (PARTITION BY dedupe_key) AS created FROM log"
)
def emit_dedupe_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return append.resolution(fixture.log(spark, sf_dir).select("event_id", "dedupe_key"))


@query(
    "WITH {LOG}, old AS (SELECT * FROM log WHERE event_id <= 500), new AS (SELECT * FROM log WHERE event_id > 500) "
    "SELECT event_id, dedupe_key FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dedupe_key ORDER BY event_id) AS rn FROM new) x "
    "WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.dedupe_key = x.dedupe_key)"
)
def emit_dedupe_against_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture.log(spark, sf_dir).select("event_id", "dedupe_key")
    return append.fresh(log.where("event_id > 500"), log.where("event_id <= 500"))


@query("WITH {LOG} SELECT event_id, event_name, payload_json FROM log WHERE signal=0 AND event_id>1234 ORDER BY event_id LIMIT 256")
def resume_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.after(fixture.log(spark, sf_dir), 1234, 256).select("event_id", "event_name", "payload_json")


@query("WITH {LOG} SELECT * FROM (SELECT event_id, event_name FROM log WHERE signal=0 ORDER BY event_id DESC LIMIT 100) t ORDER BY event_id")
def tail_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.last(fixture.log(spark, sf_dir).select("event_id", "event_name", "signal"), 100).select("event_id", "event_name")


@query("WITH {LOG} SELECT COALESCE(MAX(event_id),0) AS latest_event_id FROM log WHERE signal=0")
def latest_event_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.latest_id(fixture.log(spark, sf_dir))


@query("WITH {LOG}, {WORK} SELECT * FROM work")
def materialize_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.work(spark, sf_dir)


@query(
    "WITH {LOG}, {STATE} SELECT work_id, queue_name FROM st WHERE state='ready' AND available_at_ms <= "
    "(SELECT ts_ms FROM log WHERE event_id=300) ORDER BY work_id LIMIT 16"
)
def claim_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fixture.log(spark, sf_dir).where("event_id = 300").select("ts_ms").first()
    items = fixture.as_items(fixture.state(spark, sf_dir))
    return machine.claimable(items, at[0] if at else -1, 16).select("work_id", "queue_name")


@query("WITH {LOG}, {STATE} SELECT MIN(available_at_ms) AS due_at_ms FROM st WHERE state='ready'")
def next_dispatch_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machine.next_due(fixture.as_items(fixture.state(spark, sf_dir)))


@query(
    "WITH {LOG}, {STATE} SELECT w.event_id FROM win w WHERE w.signal=1 AND NOT EXISTS "
    "(SELECT 1 FROM st WHERE st.signal=1 AND st.state<>'acked' AND st.source_event_id=w.event_id)"
)
def signal_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = append.winners(fixture.log(spark, sf_dir).select("event_id", "dedupe_key", "signal"))
    return signals.finished(live, fixture.as_items(fixture.state(spark, sf_dir)))


@query(
    "WITH {LOG}, {WIN} SELECT w.event_id FROM win w WHERE w.signal=1 AND w.event_name NOT IN ('purchase','signup')"
)
def signal_prune_workless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals pruned at once where no route takes them."""
    live = append.winners(fixture.log(spark, sf_dir))
    plain = [r for r in fixture.ROUTES if r.event_name != "view"]
    made = append.routed(live, plain).select("source_event_id", "signal")
    return signals.finished(live, made)


@query(
    "WITH {LOG}, {STATE}, sig AS (SELECT event_id, source FROM (SELECT event_id, event_id % 1000 + 1 AS source, signal FROM log) x WHERE signal=1) "
    "SELECT s.event_id FROM sig s JOIN st ON st.work_id = s.source WHERE st.state='leased' AND s.event_id % 4 <> 0"
)
def signal_emit_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of handlers that still hold their lease; one in four comes with a lease that was lost."""
    log = fixture.log(spark, sf_dir).where("signal = 1")
    source = F.col("event_id") % 1000 + 1
    lease = F.concat(F.when(F.col("event_id") % 4 == 0, F.lit("lost-")).otherwise(F.lit("lease-")), source.cast("string"))
    sent = log.select("event_id", source.alias("work_id"), lease.alias("lease_id"))
    return signals.held_by_lease(sent, fixture.as_items(fixture.state(spark, sf_dir))).select("event_id")


@query("WITH {LOG}, {STATE} SELECT signal, state, COUNT(*) AS total FROM st GROUP BY signal, state")
def work_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machine.counts(fixture.state(spark, sf_dir))


@query(
    "WITH {LOG}, {WIN} SELECT a.user_id AS source_key, COUNT(b.event_id) AS attempts FROM (SELECT DISTINCT user_id FROM win WHERE event_name='signup') a "
    "LEFT JOIN win b ON a.user_id=b.user_id AND b.event_name='purchase' GROUP BY a.user_id"
)
def projection_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = append.winners(fixture.log(spark, sf_dir))
    keys, hits = win.where("event_name = 'signup'"), win.where("event_name = 'purchase'")
    return projection.incremented(keys, hits, "user_id", "attempts").withColumnRenamed("user_id", "source_key")


@query(
    "WITH {LOG}, {WIN} SELECT user_id, payload_json FROM (SELECT w.*, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r2 "
    "FROM win w WHERE event_name='error') z WHERE r2=1"
)
def projection_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.last_write(append.winners(fixture.log(spark, sf_dir)).where("event_name = 'error'"), "user_id", "payload_json")


@query(
    "WITH {LOG}, {WIN}, a AS (SELECT DISTINCT user_id FROM win WHERE event_name='signup' AND event_id<=500), "
    "b AS (SELECT DISTINCT user_id FROM win WHERE event_name='signup' AND event_id>500) "
    "SELECT user_id, 0 AS attempts FROM a UNION ALL SELECT user_id, 1 FROM b WHERE user_id NOT IN (SELECT user_id FROM a)"
)
def projection_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = append.winners(fixture.log(spark, sf_dir)).where("event_name = 'signup'")
    old = win.where("event_id <= 500").select("user_id").distinct().select("user_id", F.lit(0).alias("attempts"))
    return projection.inserted_if_absent(old, win.where("event_id > 500").select("user_id", F.lit(1).alias("attempts")), "user_id")


@query(
    "WITH {LOG}, {WIN} SELECT CAST(COALESCE((SELECT COUNT(*) FROM win b WHERE b.user_id = 7 AND b.event_name='purchase' "
    "AND EXISTS (SELECT 1 FROM win s WHERE s.user_id = 7 AND s.event_name='signup')), 0) AS BIGINT) AS attempts"
)
def query_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = append.winners(fixture.log(spark, sf_dir))
    table = projection.incremented(win.where("event_name = 'signup'"), win.where("event_name = 'purchase'"), "user_id", "attempts")
    return projection.point(table, "user_id", 7, "attempts")


@query("WITH {LOG}, {WIN} SELECT DISTINCT user_id FROM win WHERE event_name='signup' ORDER BY user_id")
def query_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = append.winners(fixture.log(spark, sf_dir)).where("event_name = 'signup'")
    return projection.ordered(win.select("user_id").distinct(), "user_id")


@query("SELECT CAST(a AS BIGINT) AS attempt, CAST(LEAST(50, POWER(2,a)) AS BIGINT) AS delay_ms FROM (VALUES (1),(2),(3),(4),(5),(6),(7),(8)) v(a)")
def busy_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 9).select(F.col("id").alias("attempt"), retry.backoff_column(F.col("id")).alias("delay_ms"))


_SETTLE = (
    "ls AS (SELECT st.*, (work_id % 7 <> 0) AS lease_ok, CASE source_event_id % 3 WHEN 0 THEN 'ack' WHEN 1 THEN 'retry' ELSE "
    "CASE WHEN signal=1 THEN 'retry' ELSE 'dead_letter' END END AS disp FROM st WHERE state='leased')"
)


@query(
    "WITH {LOG}, {STATE}, " + _SETTLE + " SELECT work_id, CASE WHEN lease_ok AND disp='dead_letter' THEN 1 ELSE 0 END AS dead, NOT lease_ok AS still_leased, "
    "CASE WHEN lease_ok AND disp='retry' THEN {NOW} + 1000 ELSE available_at_ms END AS available_at_ms, CASE WHEN lease_ok THEN disp END AS last_error "
    "FROM ls WHERE NOT (lease_ok AND disp='ack')"
)
def settle_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leased items after settlement: one lease in seven was lost meanwhile."""
    now = fixture.now(fixture.log(spark, sf_dir))
    leased = fixture.as_items(fixture.state(spark, sf_dir)).where("lease_id is not null")
    third = F.col("source_event_id") % 3
    how = F.when(third == 0, "ack").when(third == 1, "retry").otherwise("dead_letter")
    text = F.when((F.col("signal") == 1) & (how == "dead_letter"), "retry").otherwise(how)
    lease = F.when(F.col("work_id") % 7 != 0, F.col("lease_id")).otherwise("another")
    outcomes = leased.select("work_id", lease.alias("lease_id"), how.alias("disposition"), text.alias("error"), F.lit(None).cast("long").alias("retry_at_ms"))
    moved = machine.settled(leased, outcomes, now, 1000)
    after = leased.join(moved.select("work_id"), "work_id", "left_anti").unionByName(moved).where("not gone")
    return after.select("work_id", "dead", F.col("lease_id").isNotNull().alias("still_leased"), "available_at_ms", "last_error")


@query(
    "WITH {LOG}, {STATE}, ls AS (SELECT work_id, available_at_ms, {NOW} + (source_event_id % 5 - 2) * 1000 AS lease_expires_at_ms FROM st WHERE state='leased') "
    "SELECT work_id, lease_expires_at_ms < {NOW} AS released, CASE WHEN lease_expires_at_ms < {NOW} THEN {NOW} ELSE available_at_ms END AS available_at_ms FROM ls"
)
def release_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = fixture.now(fixture.log(spark, sf_dir))
    leased = fixture.as_items(fixture.state(spark, sf_dir)).where("lease_id is not null")
    leased = leased.withColumn("lease_expires_at_ms", F.lit(now) + (F.col("source_event_id") % 5 - 2) * 1000)
    gone = machine.released(machine.expired(leased, now), now)
    kept = leased.where(F.col("lease_expires_at_ms") >= now)
    return gone.unionByName(kept).select("work_id", F.col("lease_id").isNull().alias("released"), "available_at_ms")


@query(
    "WITH {LOG}, {STATE} SELECT work_id, {NOW} + 1000 AS lease_expires_at_ms FROM st WHERE state='leased' AND work_id % 7 <> 0"
)
def renew_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = fixture.now(fixture.log(spark, sf_dir))
    items = fixture.as_items(fixture.state(spark, sf_dir))
    held = items.select("work_id", F.when(F.col("work_id") % 7 != 0, F.col("lease_id")).otherwise("another").alias("lease_id"))
    return machine.renewed(items.where("lease_id is not null"), held, now, 1000).select("work_id", "lease_expires_at_ms")


@query(
    "WITH {LOG}, {STATE} SELECT work_id, concat('no handler for ', CASE WHEN signal=1 THEN 'signal ' ELSE '' END, 'queue ', queue_name) AS last_error "
    "FROM st WHERE state='ready' AND NOT EXISTS (SELECT 1 FROM (VALUES ('q.fulfil'),('q.welcome')) h(name) WHERE h.name=st.queue_name)"
)
def no_handler_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = fixture.as_items(fixture.state(spark, sf_dir)).where(machine.IS_READY)
    return machine.without_handler(ready, ["q.fulfil", "q.welcome"]).select("work_id", "last_error")


@query(
    "WITH p AS (SELECT event_id+1 AS event_id, CASE WHEN event_id % 11 = 0 THEN '{{\"k\":\"7\"}}' WHEN event_id % 13 = 0 THEN '{{}}' "
    "WHEN event_id % 17 = 0 THEN '{{\"k\":1.5}}' ELSE props END AS p FROM events) "
    "SELECT event_id, COALESCE(json_type(p,'$.k') IN ('BIGINT','UBIGINT'), FALSE) AS valid FROM p"
)
def validate_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    p = F.when(k % 11 == 0, '{"k":"7"}').when(k % 13 == 0, "{}").when(k % 17 == 0, '{"k":1.5}').otherwise(F.col("props"))
    return e.select((k + 1).alias("event_id"), fits_column(obj(k=INTEGER), p).alias("valid"))


@query(
    "WITH {LOG}, {WIN}, en AS (SELECT DISTINCT user_id FROM win WHERE event_name='signup' AND event_id <= 500) "
    "SELECT w.event_id AS source_event_id, 'q.fulfil' AS queue_name FROM win w JOIN en ON w.user_id=en.user_id WHERE w.event_name='purchase' AND w.event_id > 500"
)
def enqueue_if_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    win = append.winners(fixture.log(spark, sf_dir))
    enabled = win.where("event_name = 'signup' and event_id <= 500")
    return append.gated(win.where("event_name = 'purchase' and event_id > 500"), enabled, "user_id", "q.fulfil")


@query(
    "WITH {LOG}, {STATE} SELECT st.work_id, st.queue_name, CASE WHEN work_id % 3 = 0 THEN 'dead' ELSE 'ready' END AS state FROM st "
    "WHERE state='ready' AND work_id % 3 <> 1"
)
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that several transitions of an item add up to."""
    first = fixture.as_items(fixture.state(spark, sf_dir)).where(machine.IS_READY)
    second = first.where("work_id % 3 < 2").withColumns({"seq": F.lit(2).cast("long"), "dead": (F.col("work_id") % 3 == 0).cast("int"), "gone": F.col("work_id") % 3 == 1})
    moved = tables.current_work(first.unionByName(second))
    return tables.state_of(moved).select("work_id", "queue_name", "state")


@query(
    "SELECT event_id+1 AS event_id, event_id+1 AS decoded FROM events"
)
def cursor_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors of all events, decoded again."""
    page = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") + 1).alias("event_id"))
    return page.withColumn("decoded", cursor.decode_column(cursor.encode_column(F.col("event_id"))))


def _appended(spark: SparkSession, sf_dir: str, kind: str = "") -> Ledger:
    """A new ledger in the session's shared folder that the fixture's events were appended to, signals after them."""
    names = ("view", "signup", "error", "purchase", "click")
    fits = dict.fromkeys(names, obj(k=INTEGER))
    queues = {r.queue: obj(k=INTEGER) for r in fixture.ROUTES if not r.queue.startswith("sq.")}
    model = define(
        events={k: v for k, v in fits.items() if k != "view"}, signals={"view": fits["view"]}, queues=queues, signal_queues={"sq.notice": fits["view"]}
    ).register(routes=fixture.ROUTES)
    append._checkpointed(spark)
    latest = StoredProjection("latest")
    ledger = Ledger(spark, f"{spark.sparkContext.getCheckpointDir()}/log-{uuid.uuid4().hex}", model, VirtualTime(0), projections=(latest,))
    log = fixture.log(spark, sf_dir)
    batch = log.select(F.col("event_id").alias("at"), "event_name", "payload_json", "dedupe_key", "signal")
    ledger.append(batch.where("signal = 0"), "at", project=((latest, _latest),) if kind == "projection" else ())
    if kind == "signals":
        ledger.append(batch.where("signal = 1"), "at", signal=True)
    return ledger


def _latest(events: DataFrame, rows: DataFrame) -> DataFrame:
    """The last event of each name and how many there were, on top of what the projection had."""
    new = events.groupBy("event_name").agg(F.max("event_id").alias("last"), F.count("*").alias("n"))
    old = rows.select(F.get_json_object("key_json", "$").alias("event_name"), F.get_json_object("row_json", "$.n").cast("long").alias("before"))
    both = new.join(old, "event_name", "left")
    row = F.to_json(F.struct("last", (F.col("n") + F.coalesce("before", F.lit(0))).alias("n")))
    return both.select(F.concat(F.lit('"'), "event_name", F.lit('"')).alias("key_json"), row.alias("row_json"))


_PLAIN_IDS = "app AS (SELECT w.*, ROW_NUMBER() OVER (ORDER BY event_id) AS id FROM win w WHERE signal=0)"


@query("WITH {LOG}, {WIN}, " + _PLAIN_IDS + " SELECT id AS event_id, event_name, payload_json, dedupe_key FROM app")
def append_batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that a ledger appended, read back: validated, deduplicated, numbered densely."""
    return _appended(spark, sf_dir).events().select("event_id", "event_name", "payload_json", "dedupe_key")


@query(
    "WITH {LOG}, {WIN}, " + _PLAIN_IDS + " SELECT ROW_NUMBER() OVER (ORDER BY a.id, r.ord) AS work_id, r.queue_name, a.id AS source_event_id, "
    "r.delay_ms AS available_at_ms, 'ready' AS state FROM app a JOIN (SELECT * FROM (VALUES ('purchase',0,'q.fulfil',0),('purchase',1,'q.receipt',86400000),"
    "('signup',0,'q.welcome',0)) v(event_name,ord,queue_name,delay_ms)) r ON a.event_name=r.event_name"
)
def append_batch_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work that an appended batch made, at time 0."""
    return _appended(spark, sf_dir).work().select("work_id", "queue_name", "source_event_id", "available_at_ms", "state")


@query(
    "WITH {LOG}, {WIN}, " + _PLAIN_IDS + " SELECT (SELECT COUNT(*) FROM app) + ROW_NUMBER() OVER (ORDER BY event_id) AS event_id, event_name, dedupe_key, "
    "1 AS n_work FROM win WHERE signal=1"
)
def append_batch_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals appended after the events, with the items that keep them alive."""
    ledger = _appended(spark, sf_dir, "signals")
    work = ledger.work().where("signal = 1").groupBy(F.col("source_event_id").alias("event_id")).agg(F.count("*").cast("int").alias("n_work"))
    return ledger.events().where("signal = 1").join(work, "event_id").select("event_id", "event_name", "dedupe_key", "n_work")


@query("WITH {LOG}, {WIN}, " + _PLAIN_IDS + " SELECT event_name, MAX(id) AS last_event_id, COUNT(*) AS n FROM app GROUP BY event_name")
def append_batch_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored projection that the commit of the batch changed."""
    rows = _appended(spark, sf_dir, "projection").projections[0].frame()
    return rows.select(
        F.get_json_object("key_json", "$").alias("event_name"),
        F.get_json_object("row_json", "$.last").cast("long").alias("last_event_id"),
        F.get_json_object("row_json", "$.n").cast("long").alias("n"),
    )
