"""Structured Streaming wiring: capture to the log, delivery from the log, shutdown, and recovery of a lost position."""

from __future__ import annotations

import signal
import threading
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.keys import LSN_TYPE
from ..operators import eventlog
from ..operators.subscription import Registry
from ..plans.compiler import capture
from .delivery import Delivery
from .state import HadoopFiles, PositionLedger, StateStore

# Messages of sources that no longer have the position of a checkpoint, in lower case.
LOST = ("can no longer get changes from replication slot", "some data may have been lost", "offsets out of range", "offset out of range", "the offset log is missing", "file does not exist")


def position_lost(error: BaseException | str) -> bool:
    """Whether an error says that the source no longer has the stream's position."""
    text = str(error).lower()
    return any(x in text for x in LOST)


class Gate:
    """Lets batches run one at a time, and a stop in between two."""

    def __init__(self) -> None:
        self._lock, self.closed = threading.Lock(), False

    def __enter__(self) -> Gate:
        self._lock.acquire()
        return self

    def __exit__(self, *_: object) -> None:
        self._lock.release()

    def stop(self, query: StreamingQuery) -> None:
        """Stops a query after its current batch."""
        with self:
            self.closed = True
            query.stop()


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity of the run that a checkpoint belongs to: it goes with the checkpoint, as batch numbers do."""
    files = HadoopFiles(spark, f"{checkpoint.rstrip('/')}/capture")
    known = files.read("run.json")
    if known is None:
        known = uuid.uuid4().hex
        files.replace("run.json", known)
    return known


def start_capture(feed: DataFrame, registry: Registry, log_path: str, checkpoint: str, trigger: dict | None = None, ledger: PositionLedger | None = None, feed_name: str = "feed", gate: Gate | None = None) -> StreamingQuery:
    """Appends the events of a streaming change feed to the log; plans follow the registry from batch to batch.

    A batch that runs again gets the clock and the position of its first attempt and replaces what that wrote, so the log
    is the same however often it runs.  The ledger, by default beside the log, then confirms the batch's position: the
    feed's own, or, where the feed has none, a number that grows by one a batch.
    """
    spark = feed.sparkSession
    ledger = ledger or PositionLedger(f"{log_path.rstrip('/')}_ledger", spark)
    run, gate = run_id(spark, checkpoint), gate or Gate()

    def write(batch: DataFrame, number: int) -> None:
        with gate:
            registry.refresh()
            clock, position = ledger.open(feed_name, run, number, datetime.now(UTC))
            if "lsn" not in batch.columns:
                batch = batch.withColumn("lsn", F.lit(str(position)).cast(LSN_TYPE))
            eventlog.append(capture(batch, registry.all(), clock=F.lit(clock)), log_path, f"{run}-{number}")
            ledger.confirm(feed_name, batch.agg(F.max(F.col("lsn").cast(LSN_TYPE))).first()[0])

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def skip_history(feed: DataFrame, checkpoint: str) -> None:
    """Seeds a new checkpoint with all that the feed holds now, so that a capture or delivery from it sees new rows only."""
    feed.writeStream.foreachBatch(lambda batch, number: None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def start_delivery(events: DataFrame, delivery: Delivery, checkpoint: str, max_size: int = 1000, max_fill_ms: int = 1000, once: bool = False, gate: Gate | None = None) -> StreamingQuery:
    """Delivers a stream's events as they are logged, in batches of at most ``max_size`` at least every ``max_fill_ms``.

    A batch is what a trigger finds, cut at ``max_size``: it closes when it is full or when its trigger's time is over.
    """
    gate = gate or Gate()

    def deliver(batch: DataFrame, _: int) -> None:
        with gate:
            for part in eventlog.batches(eventlog.publication(batch, delivery.id), max_size):
                delivery.tick([r.asDict() for r in part])

    trigger = {"availableNow": True} if once else {"processingTime": f"{max_fill_ms} milliseconds"}
    return events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class RetryTimer:
    """Retries a stream in failover also while no new data arrives."""

    def __init__(self, delivery: Delivery, seconds: float = 5.0):
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, args=(delivery, seconds), daemon=True)

    def _run(self, delivery: Delivery, seconds: float) -> None:
        while not self._stop.wait(seconds):
            delivery.retry()

    def __enter__(self) -> RetryTimer:
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        self._thread.join()


def stop_on_signals(query: StreamingQuery, gate: Gate) -> None:
    """Stops a query after its current batch on SIGTERM and SIGINT; ``gate`` is the one the query was started with."""
    for s in (signal.SIGTERM, signal.SIGINT):
        signal.signal(s, lambda *_: threading.Thread(target=gate.stop, args=(query,)).start())


def recover_position(spark: SparkSession, events: DataFrame, store: StateStore, stream_id: int, confirmed_lsn: int | str | None, checkpoint: str, since: datetime | None = None, ledger: PositionLedger | None = None, feed_name: str = "feed", no_earlier: datetime | None = None) -> bool:
    """After a lost position: sets the failover checkpoint to the first event after the confirmed position, makes that
    durable, and only then deletes the source's checkpoint.  Whether there was such an event.

    Without a ``confirmed_lsn`` the ledger is asked; with no position there either, all of the stream's events count.
    """
    if confirmed_lsn is None and ledger is not None:
        confirmed_lsn = ledger.confirmed(feed_name)
    row = eventlog.first_after_lsn(events, stream_id, 0 if confirmed_lsn is None else confirmed_lsn, since, no_earlier).first()
    state = store.load(stream_id)
    if row is not None:
        key = (row["created_at"], row["id"])
        if state.checkpoint is None or key < state.checkpoint:
            state.checkpoint = key
        last = eventlog.last_key(events, stream_id, key)
        state.consumed = max(state.consumed or last, last)
        state.entered_at = state.entered_at or datetime.now(UTC)
        store.save(state)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return row is not None


def supervise(start: Callable[[], StreamingQuery], recover: Callable[[], object], most: int | None = None, retries: int = 5, pause: float = 1.0) -> None:
    """Runs a query, recovering and restarting it whenever its position is lost.

    Any other error is tried again ``retries`` times in a row, ``pause`` seconds apart, before it propagates; a run that
    lasts longer than all of these together starts the count anew.
    """
    restarts, tries = 0, 0
    while True:
        began = time.monotonic()
        try:
            start().awaitTermination()
            return
        except Exception as e:
            if position_lost(e):
                if most is not None and restarts >= most:
                    raise
                restarts += 1
                recover()
                continue
            if time.monotonic() - began > retries * pause:
                tries = 0
            if tries >= retries:
                raise
            tries += 1
            time.sleep(pause)


class Background:
    """A task of which one at most runs at a time: idle, running or completed."""

    def __init__(self) -> None:
        from concurrent.futures import Future, ThreadPoolExecutor

        self._pool, self._future = ThreadPoolExecutor(1), None
        self._kind = Future

    @property
    def status(self) -> str:
        return "idle" if self._future is None else "completed" if self._future.done() else "running"

    def try_start(self, task: Callable[[], object]) -> bool:
        if self._future is not None:
            return False
        self._future = self._pool.submit(task)
        return True

    def take_result(self) -> object:
        """The result of a completed task, which leaves the place idle; None while there is none."""
        if self.status != "completed":
            return None
        future, self._future = self._future, None
        return future.result()

    def wait(self) -> object:
        if self._future is None:
            return None
        future, self._future = self._future, None
        return future.result()
