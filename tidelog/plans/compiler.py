"""Subscriptions compiled to one plan: a scan of the change feed, an OR pre-filter, a fan-out, and event rows.

The change feed has the columns ``op, schema_name, table_name, new, old, txn_ts`` and, where the source knows them,
``lsn`` and ``change_id`` (a stable identity of the change).  The plan is narrow: nothing in it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import LSN_TYPE, uuid7
from ..functions.payload import expression, payload_members, to_payload
from ..operators.subscription import Subscription


def place(s: Subscription) -> Column:
    return (F.col("op") == s.operation) & (F.col("schema_name") == s.schema_name) & (F.col("table_name") == s.table_name)


def pre_filter(subscriptions: Iterable[Subscription]) -> Column:
    """A row may fire a subscription: for each captured place any of its clauses, or no clause where one has none."""
    by: dict[tuple, list[Subscription]] = {}
    for s in subscriptions:
        by.setdefault((s.schema_name, s.table_name, s.operation), []).append(s)
    terms = []
    for group in by.values():
        term = place(group[0])
        if all(s.condition for s in group):
            term = term & reduce(Column.__or__, [expression(f"({s.condition})") for s in group])
        terms.append(term)
    return reduce(Column.__or__, terms, F.lit(False))


def fires(s: Subscription) -> Column:
    return place(s) & expression(f"({s.condition})") if s.condition else place(s)


def matched(feed: DataFrame, subscriptions: Iterable[Subscription]) -> DataFrame:
    """The feed, a row for each subscription that a change fires: its columns, ``tg_name``, ``stream_id``, ``payload``."""
    subs = sorted(subscriptions, key=lambda s: (s.key, s.stream_id, s.schema_name, s.table_name, s.operation))
    if not subs:
        return feed.withColumn("_e", F.expr("cast(null as struct<tg_name:string,stream_id:bigint,payload:string,metadata:string>)")).where("false").select("*", "_e.*").drop("_e")
    made = []
    for s in subs:
        payload = to_payload(payload_members(s.key, s.operation, s.schema_name, s.table_name, s.column_names, s.payload_extensions, F.col("txn_ts")))
        made.append(F.when(fires(s), F.struct(F.lit(s.key).alias("tg_name"), F.lit(s.stream_id).cast("bigint").alias("stream_id"), payload.alias("payload"), F.lit(s.metadata).cast("string").alias("metadata"))))
    fan = F.filter(F.array(*made), lambda x: x.isNotNull())
    return feed.where(pre_filter(subs)).withColumn("_e", F.explode(fan)).select("*", "_e.*").drop("_e")


def capture(feed: DataFrame, subscriptions: Iterable[Subscription], clock: Column | None = None, with_metadata: bool = False) -> DataFrame:
    """Event rows (id, payload, metadata, stream_id, created_at, lsn, event_date) for a change feed.

    ``created_at`` is the capture clock, by default the statement's; identifiers are hashed from the change's identity
    where the feed has one, so that a retried task repeats them.
    """
    rows = matched(feed, subscriptions).withColumn("created_at", (clock if clock is not None else F.current_timestamp()).cast("timestamp"))
    seed = F.concat_ws("|", F.col("change_id").cast("string"), "tg_name", F.col("stream_id").cast("string")) if "change_id" in feed.columns else None
    lsn = F.col("lsn").cast(LSN_TYPE) if "lsn" in feed.columns else F.lit(None).cast(LSN_TYPE)
    return rows.select(
        uuid7(F.col("created_at"), seed).alias("id"), "payload", (F.col("metadata") if with_metadata else F.lit(None).cast("string")).alias("metadata"),
        "stream_id", "created_at", lsn.alias("lsn"), F.to_date("created_at").alias("event_date"),
    )


def validate(feed: DataFrame, subscriptions: Iterable[Subscription]) -> None:
    """Analyses every clause and expression against the feed's schema; raises for the first that does not fit."""
    for s in subscriptions:
        matched(feed, [s]).schema  # noqa: B018  analysis is eager
