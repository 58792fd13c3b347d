"""Configuration: a base file, an environment's file, then environment variables, each over the one before."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

PREFIX, NESTING, FILES = "APP_", "__", ("yaml", "yml", "json")
DIRECTORY, ENVIRONMENT, LOG_LEVEL = "APP_CONFIG_DIR", "APP_ENVIRONMENT", "APP_LOG"
ENVIRONMENTS = ("prod", "staging", "dev")


class ConfigError(Exception):
    """Any failure to load the configuration."""


class MissingDirectory(ConfigError):
    pass


class MissingBaseFile(ConfigError):
    pass


class UnknownEnvironment(ConfigError):
    pass


class UnreadableFile(ConfigError):
    pass


class BadFormat(ConfigError):
    pass


class BadVariable(ConfigError):
    pass


class BadShape(ConfigError):
    pass


@dataclass(frozen=True)
class Connection:
    host: str
    port: int
    name: str
    username: str
    password: str | None = None
    tls: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Batch:
    max_size: int = 1000
    max_fill_ms: int = 1000


@dataclass(frozen=True)
class Stream:
    id: int
    pg_connection: Connection
    batch: Batch = Batch()

    def redacted(self) -> Stream:
        """The same without the password, for logs."""
        return replace(self, pg_connection=replace(self.pg_connection, password=None))


@dataclass(frozen=True)
class Pipeline:
    stream: Stream
    sink: Mapping[str, Any] = field(default_factory=lambda: {"type": "memory"})


def set_log_levels(env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Sets logger levels from a filter such as ``info,tidelog.streaming=debug``; by default info for all."""
    levels = {"": "INFO"}
    for part in (env if env is not None else os.environ).get(LOG_LEVEL, "").split(","):
        name, _, level = part.strip().rpartition("=")
        if level:
            levels[name] = level.upper()
    for name, level in levels.items():
        if level not in ("TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "OFF"):
            raise BadVariable(f"{LOG_LEVEL}: {level}")
        logging.getLogger(name or None).setLevel({"TRACE": "DEBUG", "OFF": "CRITICAL"}.get(level, level))
    return levels


def environment(env: Mapping[str, str] | None = None) -> str:
    name = (env if env is not None else os.environ).get(ENVIRONMENT, "prod").lower()
    if name not in ENVIRONMENTS:
        raise UnknownEnvironment(name)
    return name


def _read(path: Path) -> dict[str, Any]:
    try:
        text = path.read_text()
    except OSError as e:
        raise UnreadableFile(str(path)) from e
    try:
        if path.suffix == ".json":
            return json.loads(text) or {}
        try:
            import yaml
        except ImportError:
            return _simple_yaml(text)
        return yaml.safe_load(text) or {}
    except BadFormat:
        raise
    except Exception as e:
        raise BadFormat(f"{path}: {e}") from e


def parsed(text: str) -> Any:
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "~", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text.strip().strip("\"'")


def _simple_yaml(text: str) -> dict[str, Any]:
    """Nested mappings of plain values, for installations without a YAML library."""
    root: dict[str, Any] = {}
    stack: list[tuple[int, dict[str, Any]]] = [(-1, root)]
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        name, colon, value = line.strip().partition(":")
        if not colon:
            raise BadFormat(line)
        depth = len(line) - len(line.lstrip())
        while stack[-1][0] >= depth:
            stack.pop()
        value = value.split(" #")[0].strip()
        if value:
            stack[-1][1][name] = parsed(value)
        else:
            stack[-1][1][name] = {}
            stack.append((depth, stack[-1][1][name]))
    return root


def merged(low: dict[str, Any], high: Mapping[str, Any]) -> dict[str, Any]:
    out = dict(low)
    for k, v in high.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
    return out


def find(directory: Path, kind: str) -> Path | None:
    return next((p for x in FILES if (p := directory / f"{kind}.{x}").is_file()), None)


def load_raw(env: Mapping[str, str] | None = None, lists: frozenset[str] = frozenset()) -> dict[str, Any]:
    """The merged settings; names in ``lists`` (dotted) are split at commas."""
    env = os.environ if env is None else env
    directory = Path(env.get(DIRECTORY) or Path.cwd() / "configuration")
    if not directory.is_dir():
        raise MissingDirectory(str(directory))
    base = find(directory, "base")
    if base is None:
        raise MissingBaseFile(str(directory))
    out = _read(base)
    own = find(directory, environment(env))
    if own is not None:
        out = merged(out, _read(own))
    for name, text in sorted(env.items()):
        if not name.startswith(PREFIX) or name in (DIRECTORY, ENVIRONMENT, LOG_LEVEL):
            continue
        path = name[len(PREFIX) :].lower().split(NESTING)
        if not all(path):
            raise BadVariable(name)
        value: Any = [parsed(x) for x in text.split(",")] if ".".join(path) in lists else parsed(text)
        for part in reversed(path):
            value = {part: value}
        out = merged(out, value)
    return out


def load(env: Mapping[str, str] | None = None) -> Pipeline:
    raw = load_raw(env)
    try:
        s = raw["stream"]
        c = s["pg_connection"]
        connection = Connection(str(c["host"]), int(c["port"]), str(c["name"]), str(c["username"]), None if c.get("password") is None else str(c["password"]), c.get("tls") or {})
        batch = Batch(**{k: int(v) for k, v in (s.get("batch") or {}).items()})
        sink = raw.get("sink") or {"type": "memory"}
        if "type" not in sink:
            raise KeyError("sink.type")
        return Pipeline(Stream(int(s["id"]), connection, batch), sink)
    except (KeyError, TypeError, ValueError) as e:
        raise BadShape(str(e)) from e
