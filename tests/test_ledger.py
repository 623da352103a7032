"""Contract of the ledger on virtual time: what each kind of handler leads to."""

import threading

import pytest
from pyspark.sql import functions as F

from tidemill import model
from tidemill.functions.schema import INTEGER, STRING, Array, Literal, obj
from tidemill.ledger import KeyedProjection, Ledger
from tidemill.runtime import VirtualHarness

START = 1_900_000_000_000


def _defined():
    return model.define(
        events={
            "message.received": obj(type=Literal("message.received"), text=STRING),
            "decision.attempted": obj(sourceEventId=INTEGER, attempt=INTEGER),
            "intent.planned": obj(sourceEventId=INTEGER),
            "dispatch.completed": obj(sourceEventId=INTEGER),
        },
        queues={"evaluate.message": obj(sourceEventId=INTEGER, text=STRING), "dispatch.intent": obj(intentEventId=INTEGER, sourceEventId=INTEGER)},
        indexers={n: obj(sourceEventId=INTEGER) for n in ("upsertObserved", "incrementAttempts", "incrementDispatches")},
        queries={
            "attempts": model.Query(obj(sourceEventId=INTEGER), INTEGER),
            "dispatches": model.Query(obj(sourceEventId=INTEGER), INTEGER),
            "seen": model.Query(obj(), Array(INTEGER)),
        },
    )


class World:
    """One store that ledgers can be opened on again and again."""

    def __init__(self, spark, path, mode, fail=False):
        self.spark, self.path, self.mode, self.fail = spark, path, mode, fail
        self.harness = VirtualHarness(START)
        self.table = KeyedProjection()

    def open(self, mode=None):
        mode, t = mode or self.mode, self.table

        def received(e, a):
            a.index("upsertObserved", {"sourceEventId": e.event_id})
            if self.fail:
                raise RuntimeError("no")
            a.enqueue("evaluate.message", {"sourceEventId": e.event_id, "text": e.payload["text"]})

        def evaluate(work, lease, actions, control):
            actions.emit("decision.attempted", {"sourceEventId": work.source_event_id, "attempt": work.attempt})
            if mode == "retry_once" and work.attempt == 1:
                control.retry("later", self.harness.time.now_ms() + 200)
            if mode == "throw_once" and work.attempt == 1:
                raise ValueError("oops")
            if mode == "dead_letter":
                control.dead_letter("never")
            if mode == "block":
                lease.wait()
                raise RuntimeError("aborted")
            actions.emit("intent.planned", {"sourceEventId": work.source_event_id}, f"intent:{work.source_event_id}")

        def planned(e, a):
            a.enqueue("dispatch.intent", {"intentEventId": e.event_id, "sourceEventId": e.payload["sourceEventId"]})

        registered = _defined().register(
            events={
                "message.received": received,
                "decision.attempted": lambda e, a: a.index("incrementAttempts", {"sourceEventId": e.payload["sourceEventId"]}),
                "intent.planned": planned,
                "dispatch.completed": lambda e, a: a.index("incrementDispatches", {"sourceEventId": e.payload["sourceEventId"]}),
            },
            queues={
                "evaluate.message": evaluate,
                "dispatch.intent": lambda w, lease, a, c: a.emit("dispatch.completed", {"sourceEventId": w.payload["sourceEventId"]}),
            },
        )
        bound = registered.bind(
            indexers={
                "upsertObserved": lambda v: t.insert(v["sourceEventId"], attempts=0, dispatches=0),
                "incrementAttempts": lambda v: t.increment(v["sourceEventId"], "attempts"),
                "incrementDispatches": lambda v: t.increment(v["sourceEventId"], "dispatches"),
            },
            queries={
                "attempts": lambda p: t.get(p["sourceEventId"], "attempts"),
                "dispatches": lambda p: t.get(p["sourceEventId"], "dispatches"),
                "seen": lambda p: t.keys(),
            },
        )
        self.ledger = Ledger(self.spark, self.path, bound, self.harness.time, projections=(t,))
        return self.ledger

    def work(self):
        self.harness.worker = self.ledger.start_workers(self.harness.time)
        self.harness.flush()

    def numbers(self, source=1):
        return self.ledger.query("attempts", {"sourceEventId": source}), self.ledger.query("dispatches", {"sourceEventId": source})


MESSAGE = {"type": "message.received", "text": "hi"}


@pytest.fixture
def world(spark, tmp_path):
    worlds = []

    def make(mode, **kw):
        worlds.append(World(spark, f"file://{tmp_path}/log", mode, **kw))
        worlds[-1].open()
        return worlds[-1]

    yield make
    for w in worlds:
        w.ledger.close()


def test_processes_once_and_dedupes(world):
    w = world("ack")
    w.ledger.emit("message.received", MESSAGE, "k")
    w.ledger.emit("message.received", MESSAGE, "k")
    assert w.ledger.work().count() == 1  # nothing runs before workers start
    w.work()
    assert w.numbers() == (1, 1)
    assert w.ledger.query("seen", {}) == [1]
    assert w.ledger.work().count() == 0
    assert [r[0] for r in w.ledger.events().orderBy("event_id").select("causation_event_id").collect()] == [None, 1, 1, 3]


def test_a_failing_handler_rolls_back(world):
    w = world("ack", fail=True)
    with pytest.raises(RuntimeError):
        w.ledger.emit("message.received", MESSAGE)
    assert w.ledger.query("seen", {}) == [] and w.ledger.events().count() == 0


def test_retry_at(world):
    w = world("retry_once")
    w.ledger.emit("message.received", MESSAGE)
    w.work()
    w.harness.advance(1)
    assert w.numbers() == (1, 0)
    w.harness.advance(200)
    assert w.numbers() == (2, 1)


def test_dead_letter_stays(world):
    w = world("dead_letter")
    w.ledger.emit("message.received", MESSAGE)
    w.work()
    assert w.numbers() == (1, 0)
    w.harness.advance(5000)
    assert w.numbers() == (1, 0)
    row = w.ledger.work().first()
    assert (row["state"], row["last_error"], row["attempt"]) == ("dead", "never", 1)


def test_throw_retries_after_the_default_delay(world):
    w = world("throw_once")
    w.ledger.emit("message.received", MESSAGE)
    w.work()
    assert w.numbers() == (1, 0) and w.ledger.work().first()["last_error"] == "oops"
    w.harness.advance(1000)
    assert w.numbers() == (2, 1)


def test_restart_with_delayed_retry(world):
    w = world("retry_once")
    w.ledger.emit("message.received", MESSAGE)
    w.work()
    w.ledger.close()
    w.harness.worker = None
    w.open()
    w.work()
    assert w.numbers() == (1, 0)
    w.harness.advance(200)
    assert w.numbers() == (2, 1)


def test_restart_gives_back_what_was_in_flight(world):
    w = world("block")
    w.ledger.emit("message.received", MESSAGE)
    w.work()
    assert w.numbers() == (0, 0)
    w.ledger.close()
    w.harness.worker = None
    w.open("ack")
    w.work()
    w.harness.advance(1000)
    assert w.numbers() == (2, 1)  # what the aborted run staged is kept


def test_leases_are_renewed(world):
    w = world("block")
    w.ledger.emit("message.received", MESSAGE)
    w.work()
    w.harness.advance(2500)
    assert w.numbers() == (0, 0)
    assert w.ledger.work().first()["attempt"] == 1  # the same lease all along


def _signal_model():
    return model.define(
        events={"response.generate": obj(id=INTEGER)},
        queues={"response.run": obj(id=INTEGER)},
        signals={"response.delta": obj(id=INTEGER, seq=INTEGER)},
        signal_queues={"delta.broadcast": obj(id=INTEGER, seq=INTEGER)},
    )


def test_signals_live_as_long_as_their_work(spark, tmp_path):
    h, hold, seen, sent = VirtualHarness(START), threading.Event(), [], []

    def run(work, lease, actions, control):
        actions.emit_signal("response.delta", {"id": 1, "seq": work.attempt}, "one")
        if work.attempt == 1:
            raise RuntimeError("fails after its signal")

    def broadcast(work, lease, actions, control):
        sent.append(work.payload)
        if not hold.is_set():
            control.dead_letter("signal work can't die")

    m = _signal_model().register(
        events={"response.generate": lambda e, a: a.enqueue("response.run", e.payload)},
        queues={"response.run": run},
        signals={"response.delta": lambda e, a: a.enqueue_signal("delta.broadcast", e.payload)},
        signal_queues={"delta.broadcast": broadcast},
    )
    with Ledger(spark, f"file://{tmp_path}/log", m, h.time) as ledger:
        end = ledger.on_signal("response.delta", seen.append)
        with pytest.raises(KeyError):
            ledger.on_signal("nothing", print)
        ledger.emit("response.generate", {"id": 1})
        h.worker = ledger.start_workers(h.time)
        h.flush()
        assert ledger.events().where("signal = 1").count() == 1  # it outlives its failing emitter
        assert [(r["signal"], r["state"]) for r in ledger.work().orderBy("work_id").collect()] == [(0, "ready"), (1, "ready")]
        assert [e.payload["seq"] for e in seen] == [1]
        end()
        hold.set()
        h.advance(1000)
        h.advance(1000)
        assert [r.asDict() for r in ledger.work().collect()] == []
        assert ledger.events().where("signal = 1").count() == 0
        assert len(seen) == 1 and len(sent) >= 2
        ledger.emit("response.generate", {"id": 1})
        h.flush()


def test_work_without_a_handler_dies(spark, tmp_path):
    h = VirtualHarness(START)
    m = _signal_model().register(events={"response.generate": lambda e, a: a.enqueue("response.run", e.payload)})
    with Ledger(spark, f"file://{tmp_path}/log", m, h.time) as ledger:
        ledger.emit("response.generate", {"id": 1})
        h.worker = ledger.start_workers(h.time)
        with pytest.raises(RuntimeError):
            ledger.start_workers(h.time)
        h.flush()
        row = ledger.work().first()
        assert (row["state"], row["last_error"]) == ("dead", "no handler for queue response.run")


def test_streams_tail_and_resume(spark, tmp_path):
    m = model.define(events={"message.received": obj(id=INTEGER)})
    ledger = Ledger(spark, f"file://{tmp_path}/log", m, VirtualHarness(START).time)
    for k in (1, 2, 3):
        ledger.emit("message.received", {"id": k})
    items = ledger.tail_events(2)
    a, b = next(items), next(items)
    assert [a.event.payload["id"], b.event.payload["id"]] == [2, 3]
    ledger.emit("message.received", {"id": 4})
    assert next(items).event.payload["id"] == 4
    resumed = ledger.resume_events(a.cursor)
    assert [next(resumed).event.payload["id"] for _ in range(2)] == [3, 4]
    with pytest.raises(ValueError):
        ledger.resume_events("bad-cursor")
    with pytest.raises(ValueError):
        ledger.tail_events(-1)
    ledger.close()
    assert list(items) == [] and list(resumed) == []
    ledger.close()


def test_batches_append_with_routes(spark, tmp_path):
    from tidemill.operators.append import Route

    m = model.define(events={"e": obj(k=INTEGER)}, queues={"q": obj(k=INTEGER)}).register(routes=(Route("e", "q", 0, 5),))
    ledger = Ledger(spark, f"file://{tmp_path}/log", m, VirtualHarness(START).time)
    batch = spark.range(20).select("id", F.lit("e").alias("event_name"), F.format_string('{"k": %d}', F.col("id") % 7).alias("payload_json"), (F.col("id") % 10).cast("string").alias("dedupe_key"))
    ledger.append(batch, "id")
    ledger.append(batch, "id")
    assert [tuple(r) for r in ledger.events().orderBy("event_id").select("event_id", "dedupe_key").collect()] == [(k + 1, str(k)) for k in range(10)]
    assert [tuple(r) for r in ledger.work().orderBy("work_id").select("work_id", "source_event_id", "available_at_ms").collect()] == [(k, k, START + 5) for k in range(1, 11)]
    with pytest.raises(Exception, match="invalid payload of e"):
        ledger.append(batch.withColumn("payload_json", F.lit('{"k": "7"}')), "id")
    assert ledger.events().count() == 10
    bad = Ledger(spark, f"file://{tmp_path}/bad", model.define(events={"e": obj(k=INTEGER)}, queues={"q": obj(other=INTEGER)}).register(routes=(Route("e", "q", 0, 5),)))
    with pytest.raises(Exception, match="invalid payload of q"):  # work that no handler could take is never made
        bad.append(batch, "id")
    assert bad.events().count() == 0 and bad.work().count() == 0
    ledger.store.compact()
    assert ledger.events().count() == 10 and ledger.work().count() == 10
    ledger.close()


def test_two_writers_and_a_crash(spark, tmp_path):
    from tidemill.functions.retry import Conflict

    m = model.define(events={"e": obj(k=INTEGER)})
    one = Ledger(spark, f"file://{tmp_path}/log", m)
    two = Ledger(spark, f"file://{tmp_path}/log", m)
    base = two.store.snapshot()
    one.emit("e", {"k": 1}, "same")
    with pytest.raises(Conflict):
        two.store.commit(base, {})
    two.store.rows("events", [(9, 0, "e", '{"k":9}', None, None, 0)])  # written, never committed
    two.emit("e", {"k": 2}, "same")
    two.emit("e", {"k": 3})
    assert sorted(r[0] for r in one.events().select("payload_json").collect()) == ['{"k": 1}', '{"k": 3}']


def test_streaming_source(spark, tmp_path):
    from tidemill.functions import cursor
    from tidemill.streaming import follow

    path = f"file://{tmp_path}/log"
    m = model.define(events={"e": obj(k=INTEGER)})
    ledger = Ledger(spark, path, m)
    for k in range(4):
        ledger.emit("e", {"k": k})
    got = []
    q = follow.for_each(follow.resumed(spark, path, cursor.encode(2)), lambda df, k: got.extend(r["event_id"] for r in df.collect()), f"{tmp_path}/cp", once=True)
    q.awaitTermination(60)
    assert got == [3, 4]
    backlog, _ = follow.tail(spark, path, 2)
    assert [r["event_id"] for r in backlog.collect()] == [3, 4]
    assert spark.read.format("tidemill_events").option("path", path).option("after", "1").load().count() == 3
