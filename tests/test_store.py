"""The store over many commits, projections in it, and what ledgers and workers do in awkward moments."""

import glob
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemill import model
from tidemill.functions import cursor
from tidemill.functions.schema import INTEGER, obj
from tidemill.ledger import Ledger
from tidemill.operators.append import Route
from tidemill.runtime import VirtualHarness
from tidemill.sources import manifests, store
from tidemill.sources.events import snapshot
from tidemill.sources.projection import StoredProjection

START = 1_900_000_000_000


def test_cursor_columns_agree_with_cursors(spark):
    ids = [0, 1, 35, 36, 36**4 - 1, 36**4, 36**5 - 1, 36**5, 36**12 - 1, 36**12, 2**53, 2**63 - 1]
    rows = spark.createDataFrame([(k, cursor.encode(k)) for k in ids], "k long, c string")
    for r in rows.select("k", "c", cursor.encode_column(F.col("k")).alias("e"), cursor.decode_column(F.col("c")).alias("d")).collect():
        assert (r["e"], r["d"]) == (r["c"], r["k"])
    good = cursor.encode(7)
    bad = [None, "", "v1:", "7", good[:-1], good + "q", good[:-1] + "Q", good.upper(), "v1:" + "u" * 13 + "q", "v1:" + "u" * 40, good + "\n"]
    found = spark.createDataFrame([(b,) for b in bad], "c string").select(cursor.decode_column(F.col("c"))).collect()
    assert [r[0] for r in found] == [None] * len(bad)
    assert spark.createDataFrame([(-1,), (None,)], "k long").select(cursor.encode_column(F.col("k"))).collect() == [(None,), (None,)]


def _counted():
    """A model whose events count per key in a stored projection."""
    table = StoredProjection("counts")
    m = model.define(events={"e": obj(k=INTEGER)}, indexers={"count": obj(k=INTEGER)}, queries={"n": model.Query(obj(k=INTEGER), INTEGER)}).register(
        events={"e": lambda e, a: (a.index("count", e.payload), _boom(e, a))}
    )

    def count(v):
        table.insert(v["k"], n=0)
        table.increment(v["k"], "n")

    return m.bind(indexers={"count": count}, queries={"n": lambda p: table.get(p["k"], "n")}), table


def _boom(event, actions):
    if event.payload["k"] == 13:
        assert actions.query("n", {"k": 13}) == 1  # a handler sees what it staged
        raise RuntimeError("no")


def test_stored_projections_outlive_the_process_and_roll_back(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    m, table = _counted()
    with Ledger(spark, path, m, projections=(table,)) as ledger:
        for k in (1, 2, 1):
            ledger.emit("e", {"k": k})
        with pytest.raises(RuntimeError):
            ledger.emit("e", {"k": 13})
        assert [ledger.query("n", {"k": k}) for k in (1, 2, 13)] == [2, 1, 0]
        with pytest.raises(RuntimeError):
            table.insert(5, n=0)  # outside any transaction
    again, other = _counted()
    with Ledger(spark, path, again, projections=(other,)) as second:
        assert [second.query("n", {"k": k}) for k in (1, 2, 13)] == [2, 1, 0]
        second.emit("e", {"k": 1})
        assert other.keys() == [1, 2] and other.get(1, "n") == 3
        m3, t3 = _counted()
        with Ledger(spark, path, m3, projections=(t3,)) as third:  # two at once see each other's rows
            third.emit("e", {"k": 1})
            assert second.query("n", {"k": 1}) == 4
            second.emit("e", {"k": 1})
            assert third.query("n", {"k": 1}) == 5


def test_folders_are_folded_and_manifests_checkpointed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FOLD", 4)
    monkeypatch.setattr(manifests, "CHECKPOINT_EVERY", 4)
    path = f"file://{tmp_path}/log"
    m, table = _counted()
    with Ledger(spark, path, m, projections=(table,)) as ledger:
        for k in range(10):
            ledger.emit("e", {"k": k % 3}, str(k % 9))
        assert len(ledger.store.snapshot().files["events"]) < 5
        assert [r[0] for r in ledger.events().orderBy("event_id").select("event_id").collect()] == list(range(1, 10))
        assert [table.get(k, "n") for k in range(3)] == [3, 3, 3]
        fresh = store.Store(spark, path)
        read = []
        at = manifests.newest(lambda name: (read.append(name), fresh._read(name))[1])
        assert at == ledger.store.snapshot() == snapshot(path) and len(read) < 7
        # a checkpoint that a crash cut short is passed over
        (tmp_path / "log/commits/checkpoint.json").write_text('{"version": 3')
        assert manifests.newest(store.Store(spark, path)._read) == at
        from tidemill.sources import events

        events.register(spark)
        assert [r["event_id"] for r in spark.read.format("tidemill_events").option("path", path).option("after", "4").load().orderBy("event_id").collect()] == [5, 6, 7, 8, 9]
        ledger.store.compact()
        assert ledger.events().count() == 9 and [table.get(k, "n") for k in range(3)] == [3, 3, 3]
        assert ledger.store.vacuum() == []  # too young
        time.sleep(0.01)
        assert ledger.store.vacuum(0) and len(glob.glob(f"{tmp_path}/log/data/events/*")) == 1
        assert ledger.events().count() == 9


def test_a_fold_gives_way_to_writers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FOLD", 3)
    path = f"file://{tmp_path}/log"
    m = model.define(events={"e": obj(k=INTEGER)})
    one, two = Ledger(spark, path, m), Ledger(spark, path, m)
    monkeypatch.setattr(one, "_fold", lambda: None)
    monkeypatch.setattr(two, "_fold", lambda: None)
    for k in range(3):
        one.emit("e", {"k": k})
    write = one.store.write

    def late(table, df):
        folder = write(table, df)
        two.emit("e", {"k": 9})  # while the fold is being written
        return folder

    monkeypatch.setattr(one.store, "write", late)
    assert one.store.fold() == ["events"]
    assert [r[0] for r in two.events().orderBy("event_id").select("event_id").collect()] == [1, 2, 3, 4]


def test_folded_work_keeps_its_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FOLD", 3)
    h = VirtualHarness(START)

    def run(work, lease, actions, control):
        if work.payload["k"] == 1:
            control.dead_letter("never")

    m = model.define(events={"e": obj(k=INTEGER)}, queues={"q": obj(k=INTEGER)}).register(events={"e": lambda e, a: a.enqueue("q", e.payload)}, queues={"q": run})
    with Ledger(spark, f"file://{tmp_path}/log", m, h.time) as ledger:
        for k in range(3):
            ledger.emit("e", {"k": k})
        h.worker = ledger.start_workers(h.time, max_in_flight=1)
        h.flush()
        assert [(r["work_id"], r["state"]) for r in ledger.work().collect()] == [(2, "dead")]
        ledger.emit("e", {"k": 1})
        h.flush()
        assert ledger.work().count() == 2


def test_batches_of_signals_and_projected_batches(spark, tmp_path):
    m = model.define(signals={"s": obj(k=INTEGER), "idle": obj(k=INTEGER)}, signal_queues={"sq": obj(k=INTEGER)}, events={"e": obj(k=INTEGER)})
    m = m.register(routes=(Route("s", "sq"),))
    totals = StoredProjection("totals")
    ledger = Ledger(spark, f"file://{tmp_path}/log", m, projections=(totals,))
    batch = spark.range(6).select("id", F.when(F.col("id") < 4, "s").otherwise("idle").alias("event_name"), F.lit('{"k": 1}').alias("payload_json"))
    ledger.append(batch, "id", signal=True)
    assert [tuple(r) for r in ledger.events().orderBy("event_id").select("event_id", "event_name", "signal").collect()] == [(k, "s", 1) for k in (1, 2, 3, 4)]
    assert [tuple(r) for r in ledger.work().select("queue_name", "signal").distinct().collect()] == [("sq", 1)]
    with pytest.raises(Exception, match="unknown event_name"):
        ledger.append(batch, "id")

    def total(events, rows):
        old = rows.select(F.get_json_object("row_json", "$.n").cast("long").alias("n"))
        return events.select(F.lit(1).cast("long").alias("n")).unionByName(old).agg(F.sum("n").alias("n")).select(F.lit('"all"').alias("key_json"), F.to_json(F.struct("n")).alias("row_json"))

    for _ in range(2):
        ledger.append(batch.withColumn("event_name", F.lit("e")), "id", project=((totals, total),))
    assert totals.get("all", "n") == 12
    before = ledger.store.snapshot()
    ledger.append(batch.limit(0), "id")
    assert ledger.store.snapshot() == before  # an empty batch makes no version
    with pytest.raises(ValueError):
        ledger.append(batch, "id", project=((StoredProjection("stranger"), total),))
    ledger.close()


def test_a_slow_observer_holds_up_nobody(spark, tmp_path):
    m = model.define(signals={"s": obj(k=INTEGER)}, signal_queues={"sq": obj()}, events={"e": obj()}, queues={"q": obj()}).register(
        signals={"s": lambda e, a: a.enqueue_signal("sq", {})}, queues={"q": lambda w, lease, a, c: [a.emit_signal("s", {"k": k}) for k in range(2)]}, events={"e": lambda e, a: a.enqueue("q", {})}
    )
    go, fast, slow = threading.Event(), [], []
    h = VirtualHarness(START)
    with Ledger(spark, f"file://{tmp_path}/log", m, h.time) as ledger:
        ledger.on_signal("s", lambda e: (go.wait(60), slow.append(e.payload["k"])))
        ledger.on_signal("s", lambda e: fast.append(e.payload["k"]))
        ledger.emit("e", {})
        h.worker = ledger.start_workers(h.time)
        deadline = time.time() + 60
        while len(fast) < 2 and time.time() < deadline:
            time.sleep(0.05)
        assert (fast, slow) == ([0, 1], [])
        go.set()
        assert ledger.observed(60) and slow == [0, 1]


def _jobs(run):
    return model.define(events={"e": obj(k=INTEGER)}, queues={"q": obj(k=INTEGER)}).register(events={"e": lambda e, a: a.enqueue("q", e.payload)}, queues={"q": run})


def test_no_more_handlers_run_than_allowed(spark, tmp_path):
    h, now, most, lock, begun, go = VirtualHarness(START), [0], [0], threading.Lock(), threading.Semaphore(0), threading.Event()

    def run(work, lease, actions, control):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        begun.release()
        go.wait(60)
        with lock:
            now[0] -= 1

    with Ledger(spark, f"file://{tmp_path}/log", _jobs(run), h.time) as ledger:
        for k in range(5):
            ledger.emit("e", {"k": k})
        h.worker = ledger.start_workers(h.time, lease_ms=10_000_000, max_in_flight=2)
        assert begun.acquire(timeout=60) and begun.acquire(timeout=60)
        assert not begun.acquire(timeout=1)  # the others wait for a slot
        go.set()
        h.flush()
        assert most[0] == 2 and ledger.work().count() == 0


def test_closing_during_a_claim_gives_the_items_back(spark, tmp_path, monkeypatch):
    h, ran = VirtualHarness(START), []
    with Ledger(spark, f"file://{tmp_path}/log", _jobs(lambda w, lease, a, c: ran.append(w.work_id)), h.time) as ledger:
        ledger.emit("e", {"k": 1})
        claiming, go, commit = threading.Event(), threading.Event(), ledger.store.commit

        def slow(*a, **kw):
            claiming.set()
            go.wait(60)
            commit(*a, **kw)

        monkeypatch.setattr(ledger.store, "commit", slow)
        worker = ledger.start_workers(h.time)
        assert claiming.wait(60)
        closing = threading.Thread(target=worker.close)
        closing.start()
        while not worker._closed:
            time.sleep(0.01)
        go.set()
        closing.join(60)
        assert not closing.is_alive() and ran == []
        assert [(r["state"], r["lease_id"]) for r in ledger.work().collect()] == [("ready", None)]


def test_close_reports_what_failed(spark, tmp_path, monkeypatch):
    h = VirtualHarness(START)
    ledger = Ledger(spark, f"file://{tmp_path}/log", _jobs(lambda w, lease, a, c: None), h.time)
    ledger.emit("e", {"k": 1})
    worker = ledger.start_workers(h.time)
    h.worker = worker
    h.flush()

    def broken(*a, **kw):
        raise OSError("the store is gone")

    monkeypatch.setattr(ledger.store, "snapshot", broken)
    worker.request()
    h.flush()
    with pytest.raises(ExceptionGroup) as failed:
        ledger.close()
    assert [str(e) for e in failed.value.exceptions] == ["the store is gone"]
    ledger.close()  # once closed, closed


def test_a_tail_never_sees_what_is_rolled_back(spark, tmp_path):
    inside, go = threading.Event(), threading.Event()

    def handler(event, actions):
        if event.payload["k"] == 1:
            inside.set()
            go.wait(60)
            raise RuntimeError("no")

    m = model.define(events={"e": obj(k=INTEGER)}).register(events={"e": handler})
    failed, seen = [], []
    with Ledger(spark, f"file://{tmp_path}/log", m) as ledger:

        def emit():
            try:
                ledger.emit("e", {"k": 1})
            except RuntimeError as error:
                failed.append(error)

        items = ledger.tail_events(10)
        reading = threading.Thread(target=lambda: seen.append(next(items)))
        writing = threading.Thread(target=emit)
        writing.start()
        assert inside.wait(60)
        reading.start()
        time.sleep(1)
        assert seen == []
        go.set()
        writing.join(60)
        ledger.emit("e", {"k": 2})
        reading.join(60)
        assert len(failed) == 1 and [i.event.payload["k"] for i in seen] == [2]
