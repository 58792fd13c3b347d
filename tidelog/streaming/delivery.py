"""The delivery state machine of a stream.

Healthy: batches go to the sink in order.  A failed batch puts the stream in failover at the batch's first event; the
source goes on.  In failover every tick (or the retry timer) first delivers the checkpoint event, then replays in order
what the source passed on since, moves the checkpoint with every replayed batch, and turns healthy at the end; only then
the current batch is delivered, without what the replay has delivered.  While the retry fails, batches are withheld; events
reach the source in commit order, which is not key order, so a withheld batch may begin before the checkpoint, which
then moves back to it.  The checkpoint never is past an event that was not delivered; what lies between is delivered
again at worst.

Events pass through the driver one batch at a time: a stream is one ordered sink's.  Times without a zone are local ones,
as the rows of a query have them.
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime
from typing import Any, Protocol

from pyspark.sql import DataFrame

from ..operators import eventlog
from ..operators.maintenance import PERIOD
from . import metrics as m
from .sinks import Sink
from .state import Key, StateStore

log = logging.getLogger(__name__)
Event = dict[str, Any]


def key_of(e: Event) -> Key:
    return e["created_at"], e["id"]


def seconds(a: datetime, b: datetime) -> float:
    """From ``b`` to ``a``, whether or not they have a zone."""
    return a.timestamp() - b.timestamp()


class Log(Protocol):
    def find(self, key: Key) -> Event | None: ...

    def replay(self, start: Key, end: Key | None, inclusive: bool) -> Iterator[list[Event]]: ...


class TableLog:
    """A stream's part of the event table; read anew for each lookup, in batches."""

    def __init__(self, events: Callable[[], DataFrame], stream_id: int, max_size: int):
        self.events, self.stream_id, self.max_size = events, stream_id, max_size

    def find(self, key: Key) -> Event | None:
        row = eventlog.point_lookup(self.events(), key[1], key[0]).first()
        return row.asDict() if row else None

    def replay(self, start: Key, end: Key | None, inclusive: bool) -> Iterator[list[Event]]:
        rows = eventlog.replay_range(self.events(), self.stream_id, start, end, end_inclusive=inclusive)
        for part in eventlog.batches(rows, self.max_size):
            yield [r.asDict() for r in part]


class Delivery:
    def __init__(self, stream_id: int, sink: Sink, log_: Log, store: StateStore, metrics: m.Metrics | None = None, maintain: Callable[[datetime], None] | None = None, clock: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.id, self.sink, self.log, self.store, self.clock = stream_id, sink, log_, store, clock
        self.metrics, self.maintain = metrics or m.Metrics(), maintain
        self.state = store.load(stream_id, clock())
        self._lock = threading.RLock()
        self._cached: tuple[Key, Event] | None = None

    def _save(self) -> None:
        self.store.save(self.state, self.clock())
        self.metrics.gauge(m.ACTIVE, 0 if self.state.healthy else 1, stream_id=self.id)

    def _maintenance(self) -> None:
        if self.maintain is None or seconds(self.clock(), self.state.next_maintenance_at) < 0:
            return
        began = self.clock()
        try:
            self.maintain(began)
            self.metrics.count(m.RUNS, result="success", stream_id=self.id)
            self.metrics.observe(m.RUN_MS, seconds(self.clock(), began) * 1000, stream_id=self.id)
        except Exception:
            log.exception("maintenance failed")
            self.metrics.count(m.RUNS, result="failure", stream_id=self.id)
        while seconds(began, self.state.next_maintenance_at) >= 0:
            self.state.next_maintenance_at += PERIOD
        self._save()

    def _publish(self, events: list[Event]) -> bool:
        try:
            self.sink.publish(events)
            return True
        except Exception as e:
            log.warning("sink %s failed: %s", self.sink.name(), e)
            return False

    def _checkpoint_event(self) -> Event | None:
        key = self.state.checkpoint
        if self._cached and self._cached[0] == key:
            return self._cached[1]
        found = self.log.find(key)
        self._cached = (key, found) if found else None
        return found

    def _move(self, to: Event) -> None:
        self.state.checkpoint = key_of(to)
        self._cached = (self.state.checkpoint, to)
        self._save()

    def _recover(self, current: Key | None) -> set[str] | None:
        """Retry and replay; the ids that were delivered, or None if the sink still fails."""
        done: set[str] = set()
        first = self._checkpoint_event()
        if first is None:
            log.error("checkpoint %s is no longer in the log, resuming after it", self.state.checkpoint)
            self.metrics.count(m.EXPIRED, stream_id=self.id)
        elif not self._publish([first]):
            return None
        else:
            done.add(first["id"])
        end, inclusive = self.state.consumed, True
        if current is not None and (end is None or current > end):
            end, inclusive = current, False
        for part in self.log.replay(self.state.checkpoint, end, inclusive) if end is not None else ():
            if not self._publish(part):
                return None
            done.update(e["id"] for e in part)
            self.metrics.count(m.REPLAYED, len(part), stream_id=self.id)
            self._move(part[-1])
        if self.state.entered_at is not None:
            self.metrics.observe(m.FAILOVER_SECONDS, seconds(self.clock(), self.state.entered_at), stream_id=self.id)
        self.state.checkpoint = self.state.consumed = self.state.entered_at = self._cached = None
        self.metrics.count(m.RECOVERED, stream_id=self.id)
        self._save()
        return done

    def tick(self, events: Iterable[Event]) -> None:
        """Handles a batch in order; delivery failures become state, other errors propagate."""
        batch = sorted(events, key=key_of)
        with self._lock:
            self._maintenance()
            if not batch:
                return
            last = key_of(batch[-1])
            if not self.state.healthy:
                done = self._recover(key_of(batch[0]))
                if done is None:
                    self.state.consumed = max(self.state.consumed or last, last)
                    if key_of(batch[0]) < self.state.checkpoint:
                        self.state.checkpoint, self._cached = key_of(batch[0]), (key_of(batch[0]), batch[0])
                    self._save()
                    return
                batch = [e for e in batch if e["id"] not in done]
                if not batch:
                    return
            if self._publish(batch):
                self.metrics.count(m.EVENTS, len(batch), stream_id=self.id)
                self.metrics.gauge(m.LAG, seconds(self.clock(), last[0]) * 1000, stream_id=self.id)
                return
            self.state.checkpoint, self.state.consumed, self.state.entered_at = key_of(batch[0]), last, self.clock()
            self._cached = (self.state.checkpoint, batch[0])
            self.metrics.count(m.ENTERED, stream_id=self.id)
            self._save()

    def retry(self) -> bool:
        """The periodic retry without new data; whether the stream is healthy afterwards."""
        with self._lock:
            self._maintenance()
            return self.state.healthy or self._recover(None) is not None
