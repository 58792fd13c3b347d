"""The durable event log: a table partitioned by day and by the batch that wrote it, ordered by (created_at, id)."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import event_key

SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("payload", T.StringType(), False),
        T.StructField("metadata", T.StringType()),
        T.StructField("stream_id", T.LongType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("lsn", T.DecimalType(20, 0)),
        T.StructField("event_date", T.DateType()),
    ]
)
REQUIRED = ("id", "created_at", "payload", "stream_id")
OPTIONAL = ("metadata", "lsn")
Key = tuple[datetime, str]


class EventNotFound(LookupError):
    """A point lookup found no event."""


def append(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Adds events, a few files for each day, clustered by stream and key.

    With a ``batch`` the events replace what that batch has written before, so writing it again changes nothing; other
    batches and days stay.
    """
    rows = events.select(SCHEMA.names).withColumn("batch", F.lit(batch or "direct"))
    rows = rows.hint("rebalance", "event_date", "stream_id").sortWithinPartitions("event_date", "stream_id", "created_at", "id")  # a large day or stream is split
    out = rows.write.partitionBy("event_date", "batch")
    if batch is None:
        out.mode("append").parquet(path)
    else:
        out.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).select(SCHEMA.names)


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCHEMA)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path).select(SCHEMA.names)


def publication(events: DataFrame, stream_id: int) -> DataFrame:
    """What a stream publishes: its own inserted events."""
    own = events.where(F.col("stream_id") == stream_id)
    return own.where(F.col("op") == "INSERT") if "op" in events.columns else own


def convert(rows: DataFrame) -> DataFrame:
    """Rows by column name to events: columns of a wrong type count as missing, others are ignored; a missing required
    value fails the batch."""
    kinds = {f.name: f.dataType.simpleString() for f in SCHEMA}
    have = {n: t for n, t in rows.dtypes}
    fits = lambda n: n in have and (have[n] == kinds[n] or (n == "created_at" and have[n] == "timestamp_ntz") or (n == "lsn" and have[n] in ("bigint", "decimal(20,0)")))
    cols = [(F.col(n) if fits(n) else F.lit(None)).cast(kinds[n]).alias(n) for n in (*REQUIRED, *OPTIONAL)]
    out = rows.select(*cols)
    for n in REQUIRED:
        out = out.withColumn(n, F.when(F.col(n).isNull(), F.raise_error(F.lit(f"Missing {n}"))).otherwise(F.col(n)))
    return out.withColumn("event_date", F.to_date("created_at")).select(SCHEMA.names)


def after(key: Key, inclusive: bool = False) -> Column:
    """(created_at, id) > key, expanded so that the time bound reaches the scan."""
    ts, id_ = F.lit(key[0]), F.lit(key[1])
    return (F.col("created_at") >= ts) & ((F.col("created_at") > ts) | (F.col("id") >= id_ if inclusive else F.col("id") > id_))


def before(key: Key, inclusive: bool = False) -> Column:
    ts, id_ = F.lit(key[0]), F.lit(key[1])
    return (F.col("created_at") <= ts) & ((F.col("created_at") < ts) | (F.col("id") <= id_ if inclusive else F.col("id") < id_))


def _days(events: DataFrame, low: datetime | None, high: datetime | None) -> DataFrame:
    if "event_date" not in events.columns:
        return events
    if low is not None:
        events = events.where(F.col("event_date") >= F.lit(low).cast("date"))
    if high is not None:
        events = events.where(F.col("event_date") <= F.lit(high).cast("date"))
    return events


def point_lookup(events: DataFrame, id_: str, created_at: datetime) -> DataFrame:
    """The event of an identifier; one day's partition is read."""
    return _days(events, created_at, created_at).where((F.col("created_at") == F.lit(created_at)) & (F.col("id") == id_))


def fetch(events: DataFrame, id_: str, created_at: datetime) -> Row:
    row = point_lookup(events, id_, created_at).first()
    if row is None:
        raise EventNotFound(f"{id_} at {created_at}")
    return row


def replay_range(events: DataFrame, stream_id: int, start: Key, end: Key | None, end_inclusive: bool = False, start_inclusive: bool = False) -> DataFrame:
    """A stream's events between two keys, by default both exclusive; in no order yet."""
    rows = _days(events, start[0], end[0] if end else None).where(F.col("stream_id") == stream_id).where(after(start, start_inclusive))
    return rows.where(before(end, end_inclusive)) if end else rows


def ordered(events: DataFrame) -> DataFrame:
    return events.orderBy("created_at", "id")


def first_after_lsn(events: DataFrame, stream_id: int, lsn: int | str, since: datetime | None = None, no_earlier: datetime | None = None) -> DataFrame:
    """The first event by (created_at, id) with a later position.

    Rows without a position are left out, or, with ``since``, taken by their time instead.  ``no_earlier``, a time before
    which all events are known to be confirmed (the retention's end, the ledger's clock), prunes the log's days.
    """
    later = F.col("lsn") > F.lit(str(lsn)).cast("decimal(20,0)")
    if since is not None:
        later = later | (F.col("lsn").isNull() & (F.col("created_at") > F.lit(since)))
    rows = _days(events, no_earlier, None)
    if no_earlier is not None:
        rows = rows.where(F.col("created_at") >= F.lit(no_earlier))
    return rows.where((F.col("stream_id") == stream_id) & later).orderBy("created_at", "id").limit(1)


def last_key(events: DataFrame, stream_id: int, start: Key) -> Key | None:
    """The largest key from ``start`` on; an aggregate, nothing is sorted."""
    row = replay_range(events, stream_id, start, None, start_inclusive=True).agg(F.max(event_key()).alias("k")).first()
    return (row["k"]["created_at"], row["k"]["id"]) if row and row["k"] else None


def confirmed_positions(events: DataFrame) -> DataFrame:
    """stream_id, lsn: the highest position of each stream's logged events; NULL where none has one."""
    return events.groupBy("stream_id").agg(F.max("lsn").alias("lsn"))


def batches(events: DataFrame, max_size: int) -> Iterator[list[Row]]:
    """The events in order in lists of at most ``max_size``; only a partition at a time is on the driver."""
    part: list[Row] = []
    for row in ordered(events).toLocalIterator():
        part.append(row)
        if len(part) == max_size:
            yield part
            part = []
    if part:
        yield part


def chunk_ids(events: DataFrame, max_size: int, by: str = "stream_id") -> DataFrame:
    """Events with ``chunk``, the number of their batch of ``max_size`` in the order of their stream and day.

    Events are ranked within a minute only; what the minutes before it hold comes from their counts, so a large stream's
    day is spread over many tasks.
    """
    day, minute = F.to_date("created_at"), F.date_trunc("minute", F.col("created_at"))
    rows = events.withColumn("_day", day).withColumn("_minute", minute)
    counts = rows.groupBy(by, "_day", "_minute").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by, "_day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)  # 1,440 rows at most
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n", "_day")
    rank = F.row_number().over(Window.partitionBy(by, "_minute").orderBy("created_at", "id"))
    ranked = rows.join(before, [by, "_minute"]).withColumn("chunk", F.ceil((rank + F.col("_before")) / F.lit(max_size)).cast("bigint"))
    return ranked.select(*events.columns, "chunk")


def first_and_last(events: DataFrame, *by: str) -> DataFrame:
    """First and last key, and count, of each group."""
    key = event_key()
    return events.groupBy(*by).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"))


def missed(events: DataFrame, delivered: DataFrame) -> DataFrame:
    """Events that were not delivered."""
    return events.join(delivered.select("id"), "id", "left_anti")


def distinct_deliveries(delivered: DataFrame) -> DataFrame:
    """At-least-once deliveries reduced to one row an event."""
    return delivered.groupBy("id").agg(F.count("*").alias("deliveries"), F.min("created_at").alias("created_at"))


def failover_window(events: DataFrame, stream_id: int, checkpoint: Key, consumed: Key, current_ids: list[str]) -> DataFrame:
    """What a recovery has to replay: after the checkpoint through the last consumed key, without the current batch."""
    rows = replay_range(events, stream_id, checkpoint, consumed, end_inclusive=True)
    return rows.where(~F.col("id").isin(current_ids)) if current_ids else rows


def resume(states: DataFrame, events: DataFrame) -> DataFrame:
    """Each stream's state with its checkpoint event, where that still exists; the states are one row a stream.

    The checkpoints' keys are read first: they bound the days that are scanned, and go into the filter.
    """
    keys = [(r[0], r[1]) for r in states.where("failover_checkpoint_id IS NOT NULL AND failover_checkpoint_ts IS NOT NULL").select("failover_checkpoint_id", "failover_checkpoint_ts").distinct().collect()]
    found = events.where("false")
    if keys:
        found = _days(events, min(t for _, t in keys), max(t for _, t in keys))
        if "event_date" in events.columns:
            found = found.where(F.col("event_date").isin([F.lit(t).cast("date") for _, t in keys]))
        found = found.where(F.col("created_at").isin([t for _, t in keys]) & F.col("id").isin([i for i, _ in keys]))
    e = found.select(F.col("id").alias("failover_checkpoint_id"), F.col("created_at").alias("failover_checkpoint_ts"), F.col("payload").alias("checkpoint_payload"))
    return states.join(e, ["failover_checkpoint_id", "failover_checkpoint_ts"], "left")
