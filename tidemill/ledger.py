"""The ledger: one object that appends, projects, queries, streams and starts workers over a store."""

from __future__ import annotations

import json
import threading
import warnings
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import cursor as cursors
from tidemill.functions.retry import MAX_DELAY_MS, MAX_RETRIES, whole, with_retries
from tidemill.functions.schema import fits
from tidemill.model import Model
from tidemill.operators import append, signals, stream, tables
from tidemill.runtime import SystemClock
from tidemill.sources.manifests import Snapshot
from tidemill.sources.projection import StoredProjection
from tidemill.sources.store import Store

PAGE = 256


@dataclass(frozen=True)
class Event:
    event_id: int
    ts_ms: int
    name: str
    payload: Any
    causation_event_id: int | None
    dedupe_key: str | None
    signal: bool


@dataclass(frozen=True)
class Item:
    """An event of a stream with the cursor that resumes after it."""

    event: Event
    cursor: str


class Transaction:
    """Rows that one commit will add, on top of one version."""

    def __init__(self, ledger: Ledger, base: Snapshot):
        self.ledger, self.base = ledger, base
        self.events: list[tuple] = []
        self.work: list[tuple] = []
        self.pruned: list[tuple] = []
        self.keys: dict[str, int] = {}
        self.signals: list[Event] = []
        self.n_events = self.n_work = 0

    def holder(self, key: str) -> int | None:
        """The live event or signal that has a key."""
        if key in self.keys:
            return self.keys[key]
        store = self.ledger.store
        found = store.read("events", self.base).where(F.col("dedupe_key") == key)
        row = tables.live_events(found, store.read("pruned", self.base)).select("event_id").first()
        return row[0] if row else None

    def append(self, name: str, payload: Any, key: str | None = None, causation: int | None = None, signal: bool = False) -> tuple[int, bool]:
        """Validate, dedupe, store, run the handler; ``(event id, created)``."""
        model = self.ledger.model
        kind, schemas = ("signal", model.signals) if signal else ("event", model.events)
        _validate(kind, schemas, name, payload)
        if key is not None and (winner := self.holder(key)) is not None:
            return winner, False
        event_id = self.base.next_event_id + self.n_events
        self.n_events += 1
        now = self.ledger.clock.now_ms()
        event = Event(event_id, now, name, payload, causation, key, signal)
        self.events.append((event_id, now, name, json.dumps(payload), causation, key, int(signal)))
        if key is not None:
            self.keys[key] = event_id
        made = len(self.work)
        handler = (model.on_signal if signal else model.on_event).get(name)
        if handler is not None:
            handler(event, SignalActions(self, event) if signal else EventActions(self, event))
        plain = [r for r in model.routes if r.event_name == name]
        for r in sorted(plain, key=lambda r: r.ordinal):
            if r.when or r.payload:
                raise ValueError("routes with SQL are for batches; give single events a handler")
            self.enqueue(r.queue, payload, event, now + r.delay_ms)
        if signal:
            self.signals.append(event)
            if len(self.work) == made:
                self.prune(event_id)
        return event_id, True

    def enqueue(self, queue: str, payload: Any, event: Event, available_at_ms: int | None) -> None:
        model = self.ledger.model
        _validate("signal queue" if event.signal else "queue", model.signal_queues if event.signal else model.queues, queue, payload)
        work_id = self.base.next_work_id + self.n_work
        self.n_work += 1
        at = event.ts_ms if available_at_ms is None else available_at_ms
        self.work.append((work_id, self.base.next_seq, queue, json.dumps(payload), event.event_id, int(event.signal), 0, at, None, None, None, 0, None, False))

    def prune(self, event_id: int) -> None:
        self.pruned.append((event_id,))
        self.keys = {k: v for k, v in self.keys.items() if v != event_id}

    def transition(self, rows: list[tuple]) -> None:
        """Rows of the work table, taken over at this commit's sequence number."""
        at = tables.WORK.names.index("seq")
        self.work += [(*r[:at], self.base.next_seq, *r[at + 1 :]) for r in rows]

    def commit(self) -> None:
        changed = [r for p in self.ledger.projections if isinstance(p, StoredProjection) for r in p.rows(self.base.next_seq)]
        rows = {"events": self.events, "work": self.work, "pruned": self.pruned, "projections": changed}
        if not any(rows.values()):
            return
        store = self.ledger.store
        files = {table: store.rows(table, made) for table, made in rows.items()}
        store.commit(self.base, {t: [f] for t, f in files.items()}, self.n_events, self.n_work, rows={f: len(rows[t]) for t, f in files.items() if f})


class EventActions:
    """What an event handler may do: write projections, enqueue, and query what was written so far."""

    def __init__(self, tx: Transaction, event: Event):
        self._tx, self._event = tx, event

    def index(self, name: str, value: Any) -> None:
        self._tx.ledger._index(name, value)

    def enqueue(self, queue: str, payload: Any, available_at_ms: int | None = None) -> None:
        self._tx.enqueue(queue, payload, self._event, available_at_ms)

    def query(self, name: str, params: Any = None) -> Any:
        return self._tx.ledger._query(name, params)


class SignalActions:
    """A signal's handler may only enqueue signal work."""

    def __init__(self, tx: Transaction, event: Event):
        self._tx, self._event = tx, event

    def enqueue_signal(self, queue: str, payload: Any, available_at_ms: int | None = None) -> None:
        self._tx.enqueue(queue, payload, self._event, available_at_ms)


def _validate(kind: str, schemas, name: str, value: Any) -> None:
    if name not in schemas:
        raise KeyError(f"unknown {kind}: {name}")
    if not fits(schemas[name], value):
        raise ValueError(f"invalid payload of {kind} {name}")


class KeyedProjection:
    """Rows by key that take part in a ledger's transactions: a failed one leaves no trace."""

    def __init__(self):
        self.rows: dict[Any, dict[str, Any]] = {}
        self._undo: dict[Any, dict | None] | None = None

    def begin(self) -> None:
        self._undo = {}

    def rollback(self) -> None:
        for key, row in (self._undo or {}).items():
            if row is None:
                self.rows.pop(key, None)
            else:
                self.rows[key] = row
        self._undo = None

    def commit(self) -> None:
        self._undo = None

    def _touch(self, key: Any) -> None:
        if self._undo is not None and key not in self._undo:
            self._undo[key] = dict(self.rows[key]) if key in self.rows else None

    def insert(self, key: Any, **values: Any) -> None:
        """A new row unless the key has one."""
        if key not in self.rows:
            self._touch(key)
            self.rows[key] = values

    def increment(self, key: Any, column: str, by: int = 1) -> None:
        if key in self.rows:
            self._touch(key)
            self.rows[key][column] += by

    def set(self, key: Any, column: str, value: Any) -> None:
        if key in self.rows:
            self._touch(key)
            self.rows[key][column] = value

    def get(self, key: Any, column: str, default: Any = 0) -> Any:
        return self.rows.get(key, {}).get(column, default)

    def keys(self) -> list:
        return sorted(self.rows)


class Ledger:
    """Opening one does nothing but make its folders: no work is claimed until workers are started."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        model: Model,
        clock=None,
        projections: tuple = (),
        max_retries: int = MAX_RETRIES,
        max_delay_ms: int = MAX_DELAY_MS,
    ):
        self.max_retries, self.max_delay_ms = whole("max_retries", max_retries, 0), whole("max_delay_ms", max_delay_ms, 1)
        self.spark, self.model, self.clock = spark, model, clock or SystemClock()
        self.projections = projections
        self.store = Store(spark, path)
        for p in projections:
            if isinstance(p, StoredProjection):
                p.open(self.store)
        self.closed = False
        self.worker = None
        self._lock, self._owner = threading.Lock(), None
        self._appended = threading.Condition()
        self._sequence = 0
        self._observers: dict[str, dict[int, tuple[Callable, ThreadPoolExecutor]]] = {}
        self._observing: set[Future] = set()
        self._folding = threading.Lock()

    # -- transactions

    def _transaction(self, body: Callable[[Transaction], Any]) -> Any:
        """Run ``body`` and commit what it gathered; one at a time here, anew if another process was first."""
        if self._owner == threading.get_ident():
            raise RuntimeError("a handler may not call its own ledger; use its actions")
        with self._lock:
            self._owner = threading.get_ident()
            try:
                tx, out = with_retries(lambda: self._attempt(body), self.max_retries, self.max_delay_ms)
            finally:
                self._owner = None
        if tx.events:
            with self._appended:
                self._sequence += 1
                self._appended.notify_all()
        for event in tx.signals:
            self._notify(event)
        if (tx.work or tx.events) and self.worker is not None:
            self.worker.request()
        self._fold()
        return out

    def _fold(self) -> None:
        """Merge small folders now and then; other transactions go on meanwhile."""
        if self._folding.acquire(blocking=False):
            try:
                self.store.fold()
            except Exception as error:  # the transaction stands; the next one tries again
                warnings.warn(f"small folders were not merged: {error}", stacklevel=2)
            finally:
                self._folding.release()

    def _attempt(self, body):
        tx = Transaction(self, self.store.snapshot())
        for p in self.projections:
            if isinstance(p, StoredProjection):
                p.enter(tx.base)
            p.begin()
        try:
            out = body(tx)
            tx.commit()
        except BaseException:
            for p in self.projections:
                p.rollback()
            raise
        for p in self.projections:
            p.commit()
        return tx, out

    # -- writing

    def emit(self, name: str, payload: Any, dedupe_key: str | None = None) -> None:
        self._transaction(lambda tx: tx.append(name, payload, dedupe_key))

    def append(self, batch: DataFrame, order: str, signal: bool = False, project: Sequence[tuple[StoredProjection, Callable[[DataFrame, DataFrame], DataFrame]]] = ()) -> None:
        """Append ``batch(event_name, payload_json[, dedupe_key])`` in the order of its column ``order``.

        The declared routes make the work; names with Python handlers are refused, since those see
        what single events did before them. Validation (of events and of the work they make), dedupe, ids and
        work are all distributed; a row that doesn't fit fails the call, and nothing is appended.

        ``signal``: the rows are signals, and those that make no work are pruned at once. Observers aren't
        called for each of a batch; ``streaming.follow.signals_to`` polls them.

        ``project``: stored projections of this ledger, each with a function of the new events and the projection's
        rows ``(key_json, row_json)`` that returns the changed rows, one a key; the same commit holds them.
        """
        model = self.model
        if model.on_signal if signal else model.on_event:
            raise ValueError("a batch can't run Python event handlers: declare routes or emit single events")
        if any(p not in self.projections for p, _ in project):
            raise ValueError("a batch changes only projections that the ledger was opened with")
        if "dedupe_key" not in batch.columns:
            batch = batch.withColumn("dedupe_key", F.lit(None).cast("string"))
        schemas, queues = (model.signals, model.signal_queues) if signal else (model.events, model.queues)

        def body(tx: Transaction):
            store, base, now = self.store, tx.base, self.clock.now_ms()
            good = append.validated(batch.select(F.col(order).alias("event_id"), "event_name", "payload_json", "dedupe_key"), schemas)
            live = tables.live_events(store.read("events", base), store.read("pruned", base))
            events = append.numbered(append.fresh(good, live), "event_id", "event_name", "payload_json", first=base.next_event_id)
            events = events.withColumn("event_id", F.col("n").cast("long")).withColumns(
                {"ts_ms": F.lit(now).cast("long"), "signal": F.lit(int(signal)), "causation_event_id": F.lit(None).cast("long")}
            )
            folder = store.write("events", events)
            stored = store.read("events", folders=[folder])
            count = stored.count()
            if not count:
                return 0
            work = append.validated(append.materialized(stored, model.routes, base.next_work_id), queues, "queue_name")
            made = store.write(
                "work",
                work.withColumns({"seq": F.lit(base.next_seq), "attempt": F.lit(0), "dead": F.lit(0), "gone": F.lit(False), **{c: F.lit(None) for c in ("lease_id", "lease_acquired_at_ms", "lease_expires_at_ms", "last_error")}}),
            )
            n_work = store.read("work", folders=[made]).count()
            files, rows = {"events": [folder], "work": [made]}, {folder: count, made: n_work}
            if signal:
                files["pruned"] = [store.write("pruned", signals.finished(stored, store.read("work", folders=[made])))]
            for p, changed in project:
                new = changed(stored, p.frame(base)).select(F.lit(p.name).alias("projection"), "key_json", F.lit(base.next_seq).alias("seq"), "row_json")
                files.setdefault("projections", []).append(store.write("projections", new))
            for table in ("pruned", "projections"):
                rows.update({f: store.read(table, folders=[f]).count() for f in files.get(table, ())})
            store.commit(base, files, count, n_work, rows=rows)
            return count

        count = self._transaction(body)
        if count:
            with self._appended:
                self._sequence += 1
                self._appended.notify_all()
            if self.worker is not None:
                self.worker.request()

    def _index(self, name: str, value: Any) -> None:
        _validate("indexer", self.model.indexers, name, value)
        if name not in self.model.index_code:
            raise KeyError(f"no code for indexer: {name}")
        self.model.index_code[name](value)

    # -- reading

    def _query(self, name: str, params: Any = None) -> Any:
        if name not in self.model.queries:
            raise KeyError(f"unknown query: {name}")
        if name not in self.model.query_code:
            raise KeyError(f"no code for query: {name}")
        if not fits(self.model.queries[name].params, params):
            raise ValueError(f"invalid parameters of query {name}")
        result = self.model.query_code[name](params)
        if not fits(self.model.queries[name].result, result):
            raise ValueError(f"invalid result of query {name}")
        return result

    def query(self, name: str, params: Any = None) -> Any:
        """A typed read of a projection; it doesn't wait for writes."""
        return self._query(name, params)

    def events(self) -> DataFrame:
        """Live events and signals."""
        at = self.store.snapshot()
        return tables.live_events(self.store.read("events", at), self.store.read("pruned", at))

    def work(self) -> DataFrame:
        """Outstanding work, each item's state in ``state``."""
        return tables.state_of(tables.current_work(self.store.read("work")))

    def _event(self, row) -> Event:
        name = row["event_name"]
        payload = json.loads(row["payload_json"])
        _validate("event", self.model.events, name, payload)
        return Event(row["event_id"], row["ts_ms"], name, payload, row["causation_event_id"], row["dedupe_key"], False)

    def _page(self, after: int) -> list[Event]:
        with self._lock:  # behind any transaction of this ledger
            df = self.store.read("events")
        return [self._event(r) for r in stream.after(df, after, PAGE).collect()]

    def tail_events(self, last: int = 0, stop: threading.Event | None = None, poll_s: float = 0.5) -> Iterator[Item]:
        """The last ``last`` events, then those to come; one snapshot, so none falls between."""
        whole("last", last, 0)

        def start():
            with self._lock:
                df = self.store.read("events")
            top = stream.latest_id(df).first()[0]
            rows = stream.last(df.where(F.col("event_id") <= top), last).collect() if last else []
            return [self._event(r) for r in rows], top

        return self._stream(start, stop, poll_s)

    def resume_events(self, cursor: str, stop: threading.Event | None = None, poll_s: float = 0.5) -> Iterator[Item]:
        """The events after a cursor; a bad cursor is refused at once."""
        after = cursors.decode(cursor)
        return self._stream(lambda: ([], after), stop, poll_s)

    def _stream(self, start, stop, poll_s) -> Iterator[Item]:
        if self.closed:
            raise RuntimeError("the ledger is closed")

        def items():
            page, after = start()
            while True:
                for e in page:
                    after = max(after, e.event_id)
                    yield Item(e, cursors.encode(e.event_id))
                    if self.closed or (stop is not None and stop.is_set()):
                        return
                with self._appended:
                    seen = self._sequence
                page = self._page(after)
                if page:
                    continue
                with self._appended:  # an append between the read and here has moved the number
                    if self._sequence == seen and not self.closed and not (stop is not None and stop.is_set()):
                        self._appended.wait(poll_s)
                if self.closed or (stop is not None and stop.is_set()):
                    return

        return items()

    # -- signals

    def on_signal(self, name: str, observer: Callable[[Event], None]) -> Callable[[], None]:
        """Call ``observer`` with each new signal of this ledger; returns a function that ends it.

        Live only: no replay, errors are swallowed, one registration per function. Each observer has a thread of
        its own, so a slow one delays neither the writer nor the others, and sees the signals in order.
        """
        if name not in self.model.signals:
            raise KeyError(f"unknown signal: {name}")
        those = self._observers.setdefault(name, {})
        if id(observer) not in those:
            those[id(observer)] = (observer, ThreadPoolExecutor(1))
        return lambda: self._unobserve(name, id(observer))

    def _unobserve(self, name: str, key: int) -> None:
        _, pool = self._observers.get(name, {}).pop(key, (None, None))
        if pool is not None:
            pool.shutdown(wait=False, cancel_futures=True)

    def _notify(self, event: Event) -> None:
        for key, (observer, pool) in list(self._observers.get(event.name, {}).items()):

            def call(key=key, observer=observer):
                if key in self._observers.get(event.name, {}):  # not ended meanwhile
                    try:
                        observer(event)
                    except Exception:  # noqa: S110  an observer's failure is its own
                        pass

            try:
                future = pool.submit(call)
            except RuntimeError:  # ended between the list and here
                continue
            self._observing.add(future)
            future.add_done_callback(self._observing.discard)

    def observed(self, timeout_s: float | None = None) -> bool:
        """Wait until the observers have seen every signal so far; false if time runs out first."""
        return not wait(list(self._observing), timeout_s).not_done

    # -- workers

    def start_workers(self, scheduler, lease_ms: int = 1000, default_retry_ms: int = 1000, max_in_flight: int = 16):
        from tidemill.worker import Worker

        if self.closed:
            raise RuntimeError("the ledger is closed")
        if self.worker is not None:
            raise RuntimeError("workers are running")
        self.worker = Worker(self, scheduler, whole("lease_ms", lease_ms, 1), whole("default_retry_ms", default_retry_ms, 1), whole("max_in_flight", max_in_flight, 1))
        self.worker.start()
        return self.worker

    def close(self) -> None:
        """End streams, workers and observers; the store stays. Calling it again does nothing.

        Everything that failed while closing is reported together, after all of it was tried.
        """
        if self.closed:
            return
        self.closed = True
        with self._appended:
            self._appended.notify_all()
        failures: list[BaseException] = []
        try:
            if self.worker is not None:
                self.worker.close()
        except BaseExceptionGroup as group:
            failures += group.exceptions
        except Exception as error:
            failures.append(error)
        for name, those in list(self._observers.items()):
            for key in list(those):
                self._unobserve(name, key)
        if failures:
            raise BaseExceptionGroup("the ledger could not close its workers", failures)

    def __enter__(self) -> Ledger:
        return self

    def __exit__(self, *_) -> None:
        self.close()
