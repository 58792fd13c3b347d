"""Subscriptions: declaration, validation, and the diff that brings a stored set to a desired one."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payload import Extension

OPERATIONS = ("INSERT", "UPDATE", "DELETE")
KEY = ("stream_id", "key", "schema_name", "table_name", "operation")
BODY = ("when_clause", "column_names", "payload_extensions", "metadata")
SCHEMA = "stream_id bigint, key string, schema_name string, table_name string, operation string, when_clause string, column_names array<string>, payload_extensions array<struct<json_path:string,expression:string>>, metadata string"


@dataclass(frozen=True)
class Subscription:
    key: str
    stream_id: int
    operation: str
    table_name: str
    schema_name: str = "public"
    when_clause: str | None = None
    column_names: tuple[str, ...] = ()
    payload_extensions: tuple[Extension, ...] = ()
    metadata: str | None = None

    def __post_init__(self) -> None:
        if self.operation not in OPERATIONS:
            raise ValueError(f"unknown operation {self.operation!r}")
        if self.stream_id is None:
            raise ValueError("stream_id must not be null")
        if not self.key or not self.table_name or not self.schema_name:
            raise ValueError("key, schema and table must not be empty")
        for x in self.payload_extensions:
            if not x.json_path or any(not p for p in x.json_path.split(".")):
                raise ValueError(f"bad extension path {x.json_path!r}")

    @property
    def identity(self) -> tuple:
        return tuple(getattr(self, k) for k in KEY)

    @property
    def condition(self) -> str | None:
        """The clause, or None where an absent or empty one means every row."""
        return self.when_clause or None


class Registry:
    """The current subscriptions; a changed fingerprint tells that plans must be compiled anew."""

    def __init__(self, subscriptions: Iterable[Subscription] = ()):
        self._by: dict[tuple, Subscription] = {}
        self.set(subscriptions)

    def set(self, subscriptions: Iterable[Subscription]) -> None:
        by: dict[tuple, Subscription] = {}
        for s in subscriptions:
            if s.identity in by:
                raise ValueError(f"duplicate subscription {s.identity}")
            by[s.identity] = s
        self._by = by

    def add(self, s: Subscription) -> None:
        self.set([*self._by.values(), s])

    def remove(self, key: str, stream_id: int | None = None) -> int:
        gone = [k for k, s in self._by.items() if s.key == key and stream_id in (None, s.stream_id)]
        for k in gone:
            del self._by[k]
        return len(gone)

    def all(self) -> list[Subscription]:
        return sorted(self._by.values(), key=lambda s: (s.stream_id, s.key, s.schema_name, s.table_name, s.operation))

    def refresh(self) -> bool:
        """Takes over what has changed where the set is stored, and tells whether anything has."""
        return False

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps([asdict(s) for s in self.all()], sort_keys=True).encode()).hexdigest()


def as_frame(spark: SparkSession, subscriptions: Iterable[Subscription]) -> DataFrame:
    rows = [(s.stream_id, s.key, s.schema_name, s.table_name, s.operation, s.when_clause, list(s.column_names), [(x.json_path, x.expression) for x in s.payload_extensions], s.metadata) for s in subscriptions]
    return spark.createDataFrame(rows, SCHEMA)


def from_rows(rows: Iterable) -> list[Subscription]:
    return [
        Subscription(r["key"], r["stream_id"], r["operation"], r["table_name"], r["schema_name"], r["when_clause"], tuple(r["column_names"] or ()), tuple(Extension(x["json_path"], x["expression"]) for x in r["payload_extensions"] or ()), r["metadata"])
        for r in rows
    ]


class StoredRegistry(Registry):
    """Subscriptions that are kept as a table: every change writes the next version, and readers take the newest whole one.

    Writers are one at a time; two that write the same version at once make the later one fail.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.version = spark, path.rstrip("/"), 0
        self._root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        super().__init__()
        self.refresh()

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        jvm = self.spark.sparkContext._jvm
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self._fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def table(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v={self.version}")

    def refresh(self) -> bool:
        newest = max(self._versions(), default=0)
        if newest == self.version:
            return False
        self.version = newest
        super().set(from_rows(self.table().collect()))
        return True

    def set_subscriptions(self, stream_id: int, desired: Iterable[Subscription]) -> dict[str, int]:
        """Makes ``desired`` the set of one stream: inserts, updates what differs, deletes the rest; how many of each."""
        self.refresh()
        desired = list(desired)
        Registry([s for s in self.all() if s.stream_id != stream_id] + desired)  # duplicates and a wrong stream fail before anything is written
        if any(s.stream_id != stream_id for s in desired):
            raise ValueError(f"not all of stream {stream_id}")
        now, want = self.table().where(F.col("stream_id") == stream_id), as_frame(self.spark, desired)
        done = {r["action"]: r["count"] for r in sync_plan(now, want).groupBy("action").count().collect()}
        if set(done) - {"noop"}:
            apply_sync(self.table(), want, stream_id).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/v={self.version + 1}")
            self.refresh()
        return done


def sync_plan(current: DataFrame, desired: DataFrame, key: Iterable[str] = KEY, body: Iterable[str] = BODY) -> DataFrame:
    """What brings ``current`` to ``desired``: the key columns and ``action`` (insert, update, delete, noop)."""
    key, body = list(key), list(body)
    a = current.select(*key, F.struct(*body).alias("_was"), F.lit(True).alias("_a"))
    b = desired.select(*key, F.struct(*body).alias("_is"), F.lit(True).alias("_b"))
    action = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(~F.col("_was").eqNullSafe(F.col("_is")), "update").otherwise("noop")
    return a.join(b, key, "full_outer").select(*key, action.alias("action"))


def apply_sync(current: DataFrame, desired: DataFrame, stream_id: int) -> DataFrame:
    """The subscriptions after the set of one stream is replaced; other streams keep theirs."""
    return current.where(F.col("stream_id") != stream_id).unionByName(desired.where(F.col("stream_id") == stream_id))
