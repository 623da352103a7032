"""The log as a Spark data source: ``format("tidemill_events")``, batch and streaming.

The stream's offset is ``{"after": id}``, the cursor's number: a version commits all ids below its
next one, so ids up to an offset never grow later. Only durable events show.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemill.functions import cursor as cursors
from tidemill.operators.tables import EVENTS
from tidemill.sources.manifests import Snapshot, newest

NAME = "tidemill_events"
#: Bytes of files that one task reads, about; small files share a task and a large folder's files have several.
BYTES_PER_TASK = 64 << 20


@dataclass
class Files(InputPartition):
    """Files of one log, and the ids wanted of them."""

    paths: tuple[str, ...]
    after: int
    upto: int

    def __init__(self, paths: tuple[str, ...], after: int, upto: int):
        self.paths, self.after, self.upto = paths, after, upto


def _store(path: str):
    from pyarrow import fs

    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def snapshot(path: str, at: Snapshot | None = None) -> Snapshot:
    """The newest version, from ``at`` on; read without Spark."""
    store, root = _store(path)

    def read(name: str) -> str | None:
        if store.get_file_info(f"{root}/commits/{name}").type.name != "File":
            return None
        with store.open_input_stream(f"{root}/commits/{name}") as f:
            return f.read().decode()

    return newest(read, at)


def dealt(path: str, at: Snapshot, after: int, upto: int) -> list[Files]:
    """Tasks over the files of those folders that can hold ids in (after, upto]."""
    from pyarrow import fs

    store, root = _store(path)
    tasks, paths, size = [], [], 0
    for folder in at.files.get("events", ()):
        if folder.last <= after or folder.first > upto:
            continue
        for info in store.get_file_info(fs.FileSelector(f"{root}/{folder.name}")):
            if not info.base_name.endswith(".parquet"):
                continue
            if paths and size + info.size > BYTES_PER_TASK:
                tasks.append(Files(tuple(paths), after, upto))
                paths, size = [], 0
            paths.append(info.path)
            size += info.size
    return [*tasks, Files(tuple(paths), after, upto)]


def _rows(path: str, part: Files):
    """Arrow batches of the files' durable events, ids in (after, upto]; the filter skips row groups."""
    import pyarrow.dataset as ds
    from pyspark.sql.pandas.types import to_arrow_schema

    if part.paths:
        field = ds.field
        wanted = (field("event_id") > part.after) & (field("event_id") <= part.upto) & ((field("signal") == 0) | field("signal").is_null())
        yield from ds.dataset(list(part.paths), schema=to_arrow_schema(EVENTS), filesystem=_store(path)[0], format="parquet").to_batches(columns=EVENTS.names, filter=wanted)


class _Batch(DataSourceReader):
    def __init__(self, path: str, after: int):
        self.path, self.after = path, after

    def partitions(self):
        at = snapshot(self.path)
        return dealt(self.path, at, self.after, at.next_event_id - 1)

    def read(self, part):
        yield from _rows(self.path, part)


class _Stream(DataSourceStreamReader):
    """The version that was read last is remembered, so a micro-batch reads only the manifests after it."""

    def __init__(self, path: str, after: int):
        self.path, self.after, self.at = path, after, None

    def initialOffset(self):  # noqa: N802
        return {"after": self.after}

    def latestOffset(self):  # noqa: N802
        self.at = snapshot(self.path, self.at)
        return {"after": max(self.after, self.at.next_event_id - 1)}

    def partitions(self, start, end):
        if start["after"] >= end["after"]:
            return [Files((), 0, 0)]
        self.at = snapshot(self.path, self.at)
        return dealt(self.path, self.at, start["after"], end["after"])

    def read(self, part):
        yield from _rows(self.path, part)


class LedgerEvents(DataSource):
    """Options: ``path``; ``cursor`` (resume after it) or ``after`` (an id, 0 by default)."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return EVENTS

    def _after(self) -> int:
        cursor = self.options.get("cursor")
        return cursors.decode(cursor) if cursor else int(self.options.get("after", 0))

    def reader(self, schema):
        return _Batch(self.options["path"], self._after())

    def streamReader(self, schema):  # noqa: N802
        return _Stream(self.options["path"], self._after())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LedgerEvents)
