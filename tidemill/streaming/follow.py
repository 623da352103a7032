"""Change streams of a log as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.functions import cursor as cursors
from tidemill.operators import stream, tables
from tidemill.sources import events
from tidemill.sources.store import Store


def resumed(spark: SparkSession, path: str, cursor: str | None = None) -> DataFrame:
    """A streaming DataFrame of the events after a cursor (from the start without one)."""
    events.register(spark)
    reader = spark.readStream.format(events.NAME).option("path", path)
    if cursor is not None:
        cursors.decode(cursor)  # refuse a bad one before anything starts
        reader = reader.option("cursor", cursor)
    return reader.load()


def tail(spark: SparkSession, path: str, last: int) -> tuple[DataFrame, DataFrame]:
    """The last events as a batch, and the stream of those after them, from one snapshot."""
    store = Store(spark, path)
    log = store.read("events", store.snapshot())
    top = stream.latest_id(log).first()[0]
    return stream.last(log.where(F.col("event_id") <= top), last), resumed(spark, path, cursors.encode(top))


def for_each(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hand every micro-batch to ``sink`` in id order. At least once: use (source, batch id) as a dedupe key."""
    writer = df.writeStream.foreachBatch(lambda batch, k: sink(batch.orderBy("event_id"), k)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def signals_to(spark: SparkSession, path: str, name: str, observer: Callable, after: int = 0) -> int:
    """Call ``observer`` with the live signals after an id and return the last id seen; a poll for processes
    that don't write the log themselves. Best effort: errors are swallowed and nothing is replayed."""
    store = Store(spark, path)
    at = store.snapshot()
    live = tables.live_events(store.read("events", at), store.read("pruned", at))
    seen = after
    for row in live.where((F.col("signal") == 1) & (F.col("event_name") == name) & (F.col("event_id") > after)).orderBy("event_id").toLocalIterator():
        seen = row["event_id"]
        try:
            observer(row)
        except Exception:  # noqa: S112  an observer's failure is its own
            continue
    return seen
