"""Operators against brute force, and the parts without Spark."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import cursor, retry
from tidemill.functions.schema import BOOLEAN, INTEGER, NULL, NUMBER, STRING, Array, Literal, Optional, fits, fits_column, obj, union
from tidemill.operators import append, signals, work
from tidemill.runtime import VirtualTime

SCHEMAS = [STRING, NUMBER, INTEGER, BOOLEAN, NULL, Literal("a"), Literal(1), Literal(True), Array(INTEGER), union(NULL, obj(x=STRING)), obj(a=INTEGER, b=Optional(STRING)), Array(obj(x=NUMBER))]
VALUES = ["5", 5, 1.5, True, None, "a", 1, [], [1, 2], [1, "2"], {"x": "y"}, {"a": 1}, {"a": 1, "b": "s", "c": 0}, {"a": 1, "b": 2}, {"a": "1"}, [{"x": 1}, {"x": 2.5}], [{"y": 1}], {}]


def test_columns_and_values_are_judged_alike(spark):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(VALUES)] + [(99, None), (98, "{bad")], "k int, p string")
    rows = df.select("k", *[fits_column(s, F.col("p")).alias(str(i)) for i, s in enumerate(SCHEMAS)]).collect()
    for r in rows:
        for i, s in enumerate(SCHEMAS):
            assert r[i + 1] == (fits(s, VALUES[r.k]) if r.k < 90 else False), (s, r.k)


def test_an_invalid_row_fails_the_batch(spark):
    df = spark.createDataFrame([("e", '{"k":1}'), ("f", "{}")], "event_name string, payload_json string")
    assert append.validated(df.where("event_name = 'e'"), {"e": obj(k=INTEGER)}).count() == 1
    with pytest.raises(Exception, match="unknown event_name: f"):
        append.validated(df, {"e": obj(k=INTEGER)}).collect()


@given(st.integers(0, 2**63 - 1))
@settings(max_examples=200, deadline=None)
def test_cursors_round_trip(k):
    assert cursor.decode(cursor.encode(k)) == k


@pytest.mark.parametrize("bad", ["bad-cursor", "v1:", "v1:!!!!!!", "", "v2:qqqqqq", cursor.encode(5)[:-1] + "q" * 3, None])
def test_bad_cursors(bad):
    with pytest.raises(cursor.CursorError):
        cursor.decode(bad)


def test_numbers_are_dense_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(append, "ROWS_PER_TASK", 50)
    df = spark.range(400).select((F.col("id") * 7 % 101).alias("k"), "id")
    got = append.numbered(df, "k", "id", first=5).orderBy("n").collect()
    assert [r.n for r in got] == list(range(5, 405))
    assert [(r.k, r.id) for r in got] == sorted((i * 7 % 101, i) for i in range(400))
    assert append.numbered(df.where("id < 0"), "k", "id").count() == 0


def test_numbers_over_very_many_ranges_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(append, "ROWS_PER_TASK", 1)
    for most in (append.BROADCAST_RANGES, 10):
        monkeypatch.setattr(append, "BROADCAST_RANGES", most)
        df = spark.range(1500).select((F.col("id") % 2).alias("k"), F.lit("x").alias("t"), "id")
        got = append.numbered(df, "k", "t").orderBy("n").collect()
        assert [r.n for r in got] == list(range(1, 1501)) and [r.k for r in got] == [0] * 750 + [1] * 750


def test_dedupe_with_null_keys_and_hot_keys(spark):
    rows = [(i, None if i % 5 == 0 else "hot" if i % 2 else f"k{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, dedupe_key string")
    first = {}
    for i, k in rows:
        first.setdefault(k, i)
    want = sorted(i for i, k in rows if k is None or first[k] == i)
    assert sorted(r.event_id for r in append.winners(df).collect()) == want
    for r in append.resolution(df).collect():
        k = rows[r.attempt_id][1]
        assert r.winner_event_id == (r.attempt_id if k is None else first[k]) and r.created == (r.attempt_id in want)


def test_signals_with_dead_work_stay(spark):
    s = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "event_id long, signal int")
    w = spark.createDataFrame([(1, 1, 1)], "source_event_id long, signal int, dead int")
    assert [r[0] for r in signals.finished(s, w).collect()] == [2]


def test_backoff_and_retries():
    assert [retry.backoff_ms(k) for k in range(1, 9)] == [2, 4, 8, 16, 32, 50, 50, 50]
    calls, slept = [], []

    def body():
        calls.append(1)
        if len(calls) < 4:
            raise retry.Conflict("taken")
        return "done"

    assert retry.with_retries(body, sleep=slept.append) == "done" and slept == [0.002, 0.004, 0.008]
    with pytest.raises(retry.Conflict):
        retry.with_retries(lambda: (_ for _ in ()).throw(retry.Conflict("x")), 2, sleep=lambda s: None)
    with pytest.raises(ValueError):
        retry.whole("n", True, 0)


def test_virtual_time_fires_in_order():
    t, seen = VirtualTime(100), []
    t.once(130, lambda: seen.append("b"))
    t.once(120, lambda: seen.append("a"))
    cancel = t.once(140, lambda: seen.append("never"))
    stop = t.every(25, lambda: seen.append(t.now_ms()))
    cancel()
    t.advance(60)
    stop()
    t.advance(100)
    assert seen == ["a", 125, "b", 150] and t.now_ms() == 260


def test_lease_rules(spark):
    from tidemill.operators.tables import WORK

    def item(k, lease, until, dead=0, signal=0):
        return (k, 1, "q", "{}", k, signal, 1, 10, lease, 0, until, dead, None, False)

    rows = spark.createDataFrame([item(1, "a", 99), item(2, "b", 100), item(3, None, None), item(4, "d", 50, signal=1)], WORK)
    assert [r.work_id for r in work.expired(rows, 100).orderBy("work_id").collect()] == [1, 4]  # strictly before now
    out = spark.createDataFrame(
        [(1, "a", "dead_letter", "e", None), (2, "x", "ack", None, None), (4, "d", "dead_letter", "e", None)],
        "work_id long, lease_id string, disposition string, error string, retry_at_ms long",
    )
    got = {r.work_id: (r.dead, r.gone, r.available_at_ms, r.last_error) for r in work.settled(rows, out, 1000, 7).collect()}
    assert got == {1: (1, False, 10, "e"), 4: (0, False, 1007, "e")}
    assert [r.work_id for r in work.claimable(rows, 10, 5).collect()] == [3]


def test_real_clock_and_scheduler():
    import threading

    from tidemill.runtime import SystemClock, ThreadScheduler

    clock, s, once, ticks = SystemClock(), ThreadScheduler(), threading.Event(), threading.Semaphore(0)
    s.once(clock.now_ms() + 20, once.set)
    never = threading.Event()
    s.once(clock.now_ms() + 60_000, never.set)()
    stop = s.every(10, ticks.release)
    assert once.wait(5) and ticks.acquire(timeout=5) and ticks.acquire(timeout=5)
    stop()
    assert not never.is_set()
