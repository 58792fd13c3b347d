"""Small durable state of the driver: a stream's status and its confirmed position, a file each, replaced atomically.

Files lie in a local or mounted folder, or, given a session, under any path that Hadoop's file systems reach.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import SparkSession

Key = tuple[datetime, str]


class Files(Protocol):
    def read(self, name: str) -> str | None: ...

    def replace(self, name: str, text: str) -> None: ...

    def names(self) -> list[str]: ...


class LocalFiles:
    def __init__(self, directory: str | Path):
        self.directory = Path(directory)
        self.directory.mkdir(parents=True, exist_ok=True)

    def read(self, name: str) -> str | None:
        p = self.directory / name
        return p.read_text() if p.exists() else None

    def replace(self, name: str, text: str) -> None:
        fd, tmp = tempfile.mkstemp(dir=self.directory, prefix=".state-")
        with os.fdopen(fd, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, self.directory / name)

    def names(self) -> list[str]:
        return sorted(p.name for p in self.directory.glob("*.json"))


class HadoopFiles:
    """Files under a path of the cluster's storage; a replacement is one rename over the old file."""

    def __init__(self, spark: SparkSession, directory: str):
        self.jvm, self.directory = spark.sparkContext._jvm, directory.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self._path("").getFileSystem(self.conf)
        self.fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.directory}/{name}" if name else self.directory)

    def read(self, name: str) -> str | None:
        p = self._path(name)
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        tmp = self._path(f".state-{uuid.uuid4().hex}")
        out = self.fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        target = self._path(name)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(tmp, target, how)

    def names(self) -> list[str]:
        return sorted(n for s in self.fs.listStatus(self._path("")) if (n := s.getPath().getName()).endswith(".json"))


def files_in(directory: str | Path, spark: SparkSession | None = None) -> Files:
    return LocalFiles(directory) if spark is None else HadoopFiles(spark, str(directory))


@dataclass
class StreamState:
    """Healthy without a checkpoint; in failover with the key of the first event that is not delivered.

    ``consumed``: the largest key that the source has passed on while in failover.
    """

    id: int
    next_maintenance_at: datetime
    checkpoint: Key | None = None
    consumed: Key | None = None
    entered_at: datetime | None = None
    created_at: datetime | None = None
    updated_at: datetime | None = None

    @property
    def healthy(self) -> bool:
        return self.checkpoint is None


def _out(x):
    return x.isoformat() if isinstance(x, datetime) else [_out(y) for y in x] if isinstance(x, tuple | list) else x


def _in(name: str, x):
    if x is None or name == "id":
        return x
    return (datetime.fromisoformat(x[0]), x[1]) if isinstance(x, list) else datetime.fromisoformat(x)


class StateStore:
    """The status of every stream."""

    def __init__(self, directory: str | Path, spark: SparkSession | None = None):
        self.files = files_in(directory, spark)

    @staticmethod
    def name(stream_id: int) -> str:
        return f"stream-{stream_id}.json"

    def load(self, stream_id: int, now: datetime | None = None) -> StreamState:
        """The stored state, or a new healthy one."""
        text = self.files.read(self.name(stream_id))
        if text is not None:
            return StreamState(**{k: _in(k, v) for k, v in json.loads(text).items()})
        now = now or datetime.now(UTC)
        state = StreamState(stream_id, next_maintenance_at=now, created_at=now)
        self.save(state, now)
        return state

    def save(self, state: StreamState, now: datetime | None = None) -> None:
        state.updated_at = now or datetime.now(UTC)
        self.files.replace(self.name(state.id), json.dumps({k: _out(v) for k, v in asdict(state).items()}))

    def rows(self) -> list[StreamState]:
        return [self.load(int(n.removesuffix(".json").split("-")[1])) for n in self.files.names() if n.startswith("stream-")]


class PositionLedger:
    """The position through which each feed's changes are committed to the log, and what its last batch was.

    A batch is opened before it is written, with the clock and the position that it gets, so that a batch that runs again
    repeats both; it is confirmed once the log has it.  The confirmed position only grows.
    """

    def __init__(self, directory: str | Path, spark: SparkSession | None = None):
        self.files = files_in(directory, spark)

    @staticmethod
    def name(feed: str) -> str:
        return f"position-{feed}.json"

    def _load(self, feed: str) -> dict[str, Any]:
        text = self.files.read(self.name(feed))
        return json.loads(text) if text else {"confirmed": None, "run": None, "batch": None, "clock": None, "position": None}

    def open(self, feed: str, run: str, batch: int, now: datetime) -> tuple[datetime, int]:
        """The clock and the position of a batch of a run; those of the first attempt where it was opened before."""
        was = self._load(feed)
        if (was["run"], was["batch"]) != (run, batch):
            was |= {"run": run, "batch": batch, "clock": now.isoformat(), "position": max(was["confirmed"] or 0, was["position"] or 0) + 1}
            self.files.replace(self.name(feed), json.dumps(was))
        return datetime.fromisoformat(was["clock"]), was["position"]

    def confirm(self, feed: str, lsn: int | None) -> None:
        was = self._load(feed)
        if lsn is not None and int(lsn) > (was["confirmed"] or 0):
            self.files.replace(self.name(feed), json.dumps(was | {"confirmed": int(lsn)}))

    def confirmed(self, feed: str) -> int | None:
        """The highest committed position; None before the first."""
        return self._load(feed)["confirmed"]
