"""Delivery metrics: counters, gauges and histograms by label, their text exposition, and an endpoint that serves it."""

from __future__ import annotations

import math
import threading
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql.streaming.listener import StreamingQueryListener

LAG, EVENTS = "stream_processing_lag_milliseconds", "stream_events_processed_total"
ACTIVE, ENTERED, RECOVERED, FAILOVER_SECONDS = "stream_failover_active", "stream_failover_entered_total", "stream_failover_recovered_total", "stream_failover_duration_seconds"
REPLAYED, EXPIRED = "stream_events_replayed_total", "stream_checkpoint_expired_total"
RUNS, RUN_MS = "maintenance_runs_total", "maintenance_duration_milliseconds"
QUERY_ROWS, QUERY_MS, QUERY_FAILURES = "stream_query_input_rows_total", "stream_query_batch_milliseconds", "stream_query_failures_total"
WIDTH = math.log(1.05)  # quantiles are right to 5 %


class Histogram:
    """Count and sum of all samples, and how many fall in each of a row of growing intervals: bounded for any number."""

    def __init__(self) -> None:
        self.n, self.total = 0, 0.0
        self.cells: dict[int, int] = defaultdict(int)

    def add(self, value: float) -> None:
        self.n += 1
        self.total += value
        self.cells[math.floor(math.log(value) / WIDTH) if value > 0 else -(1 << 30)] += 1

    def quantile(self, q: float) -> float:
        rank, seen = min(self.n - 1, int(q * self.n)), 0
        for cell in sorted(self.cells):
            seen += self.cells[cell]
            if seen > rank:
                return math.exp((cell + 0.5) * WIDTH) if cell > -(1 << 30) else 0.0
        return 0.0


class Metrics:
    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.counters: dict[tuple, float] = defaultdict(float)
        self.gauges: dict[tuple, float] = {}
        self.samples: dict[tuple, Histogram] = defaultdict(Histogram)

    @staticmethod
    def _key(name: str, labels: dict) -> tuple:
        return name, tuple(sorted((k, str(v)) for k, v in labels.items()))

    def count(self, name: str, by: float = 1, **labels) -> None:
        with self._lock:
            self.counters[self._key(name, labels)] += by

    def gauge(self, name: str, value: float, **labels) -> None:
        with self._lock:
            self.gauges[self._key(name, labels)] = value

    def observe(self, name: str, value: float, **labels) -> None:
        with self._lock:
            self.samples[self._key(name, labels)].add(value)

    def value(self, name: str, **labels) -> float:
        key = self._key(name, labels)
        return self.counters.get(key, self.gauges.get(key, 0))

    def exposition(self) -> str:
        def line(key: tuple, value: float, suffix: str = "", extra: tuple = ()) -> str:
            labels = ",".join(f'{k}="{v}"' for k, v in (*key[1], *extra))
            return f"{key[0]}{suffix}{{{labels}}} {value:.12g}"

        with self._lock:
            out = [line(k, v) for k, v in sorted([*self.counters.items(), *self.gauges.items()])]
            for k, h in sorted(self.samples.items()):
                out += [line(k, h.quantile(q), extra=(("quantile", q),)) for q in (0.5, 0.9, 0.99)]
                out += [line(k, h.total, "_sum"), line(k, h.n, "_count")]
        return "\n".join(out) + "\n"


def serve(metrics: Metrics, port: int = 9000, host: str = "") -> ThreadingHTTPServer:
    """Serves the exposition at every path until ``shutdown`` is called on the result; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            body = metrics.exposition().encode()
            self.send_response(200)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


class QueryProgress(StreamingQueryListener):
    """Notes the rows and times of streaming queries, and their failures; for ``spark.streams.addListener``."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.metrics.count(QUERY_ROWS, p.numInputRows, query=p.name or p.id)
        self.metrics.observe(QUERY_MS, p.batchDuration, query=p.name or p.id)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.metrics.count(QUERY_FAILURES, query=event.id)
