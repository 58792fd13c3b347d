"""Sinks: where batches of events go.  A publish either delivers the whole batch or raises."""

from __future__ import annotations

import json
import threading
import urllib.request
from collections.abc import Callable, Mapping
from typing import Any, Protocol


class SinkError(Exception):
    """A batch was not delivered."""


class Sink(Protocol):
    def name(self) -> str: ...

    def publish(self, events: list[dict[str, Any]]) -> None: ...


class MemorySink:
    """Keeps events; copies share what they keep."""

    def __init__(self, shared: tuple[list, threading.Lock] | None = None):
        self._events, self._lock = shared or ([], threading.Lock())

    def name(self) -> str:
        return "memory"

    def clone(self) -> MemorySink:
        return MemorySink((self._events, self._lock))

    def publish(self, events: list[dict[str, Any]]) -> None:
        with self._lock:
            self._events.extend(events)

    def events(self) -> list[dict[str, Any]]:
        with self._lock:
            return list(self._events)

    def clear(self) -> None:
        with self._lock:
            self._events.clear()


class FailableSink(MemorySink):
    """Fails on the given calls, counted from 0."""

    def __init__(self, *fail_on: int):
        super().__init__()
        self.fail_on, self.calls = set(fail_on), 0

    def name(self) -> str:
        return "failable"

    def publish(self, events: list[dict[str, Any]]) -> None:
        call, self.calls = self.calls, self.calls + 1
        if call in self.fail_on:
            raise SinkError(f"call {call} fails")
        super().publish(events)


class HttpSink:
    """Posts each event as JSON; the first answer that is not a success fails the batch."""

    def __init__(self, url: str, timeout: float = 10.0, send: Callable[[urllib.request.Request, float], int] | None = None):
        self.url, self.timeout, self.send = url, timeout, send or self._send

    @staticmethod
    def _send(request: urllib.request.Request, timeout: float) -> int:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status

    def name(self) -> str:
        return "http"

    def publish(self, events: list[dict[str, Any]]) -> None:
        for e in events:
            request = urllib.request.Request(self.url, json.dumps(e, default=str).encode(), {"Content-Type": "application/json"}, method="POST")
            try:
                status = self.send(request, self.timeout)
            except OSError as x:
                raise SinkError(str(x)) from x
            if not 200 <= status < 300:
                raise SinkError(f"status {status}")


REGISTRY: dict[str, Callable[..., Sink]] = {"memory": MemorySink, "http": HttpSink}


def register(kind: str, make: Callable[..., Sink]) -> None:
    REGISTRY[kind.lower()] = make


def make_sink(config: Mapping[str, Any]) -> Sink:
    kind = str(config["type"]).lower()
    if kind not in REGISTRY:
        raise ValueError(f"unknown sink type {kind!r}")
    return REGISTRY[kind](**{k: v for k, v in config.items() if k != "type"})
