"""Models: what a log holds (schemas), what its events lead to (handlers), and its projections (code)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from tidemill.functions.schema import Schema
from tidemill.operators.append import Route


@dataclass(frozen=True)
class Query:
    """A projection's read contract."""

    params: Schema
    result: Schema


@dataclass(frozen=True)
class Model:
    """Names and schemas; then handlers by name; then the projection code. Build with ``define``."""

    events: Mapping[str, Schema] = field(default_factory=dict)
    signals: Mapping[str, Schema] = field(default_factory=dict)
    queues: Mapping[str, Schema] = field(default_factory=dict)
    signal_queues: Mapping[str, Schema] = field(default_factory=dict)
    indexers: Mapping[str, Schema] = field(default_factory=dict)
    queries: Mapping[str, Query] = field(default_factory=dict)
    on_event: Mapping[str, Callable] = field(default_factory=dict)
    on_signal: Mapping[str, Callable] = field(default_factory=dict)
    on_queue: Mapping[str, Callable] = field(default_factory=dict)
    on_signal_queue: Mapping[str, Callable] = field(default_factory=dict)
    routes: tuple[Route, ...] = ()
    index_code: Mapping[str, Callable[[Any], None]] = field(default_factory=dict)
    query_code: Mapping[str, Callable[[Any], Any]] = field(default_factory=dict)

    def register(
        self,
        events: Mapping[str, Callable] | None = None,
        signals: Mapping[str, Callable] | None = None,
        queues: Mapping[str, Callable] | None = None,
        signal_queues: Mapping[str, Callable] | None = None,
        routes: tuple[Route, ...] = (),
    ) -> Model:
        """Attach at most one handler per name; each is optional. ``routes`` are handlers declared for batches."""
        given = (("event", events, self.events), ("signal", signals, self.signals), ("queue", queues, self.queues), ("signal queue", signal_queues, self.signal_queues))
        for kind, handlers, names in given:
            _known(kind, handlers, names)
        _known("event", dict.fromkeys(r.event_name for r in routes), {**self.events, **self.signals})
        _known("queue", dict.fromkeys(r.queue for r in routes), {**self.queues, **self.signal_queues})
        return replace(
            self, on_event=events or {}, on_signal=signals or {}, on_queue=queues or {}, on_signal_queue=signal_queues or {}, routes=tuple(routes)
        )

    def bind(self, indexers: Mapping[str, Callable] | None = None, queries: Mapping[str, Callable] | None = None) -> Model:
        """Attach the code of indexers and queries."""
        _known("indexer", indexers, self.indexers)
        _known("query", queries, self.queries)
        return replace(self, index_code=indexers or {}, query_code=queries or {})


def _known(kind: str, given: Mapping | None, names: Mapping) -> None:
    for name in given or {}:
        if name not in names:
            raise KeyError(f"unknown {kind}: {name}")


def define(events=None, signals=None, queues=None, signal_queues=None, indexers=None, queries=None) -> Model:
    """Collect schemas; maps that are left out are empty."""
    return Model(events or {}, signals or {}, queues or {}, signal_queues or {}, indexers or {}, queries or {})
