"""Payload construction: column projection, computed extensions and the shallow merge, all settled at plan time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .keys import epoch_ms

JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


_SETTING = re.compile(r"\bcurrent_setting\(\s*'([^']+)'\s*(?:,\s*(true)\s*)?\)", re.I)


@dataclass(frozen=True)
class Extension:
    json_path: str
    expression: str


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def expression(text: str) -> Column:
    """A user's expression.  ``current_setting('name')`` becomes the session's value when the plan is made; an unknown name
    is an error, or NULL with ``current_setting('name', true)``."""

    def value(m: re.Match) -> str:
        got = SparkSession.active().conf.get(m[1], None)
        if got is None and not m[2]:
            raise LookupError(f"unknown setting {m[1]}")
        return "cast(null as string)" if got is None else "'" + got.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return F.expr(_SETTING.sub(value, text))


def empty_object() -> Column:
    return F.expr("cast(map() as map<string,string>)")


def build_extensions(extensions: Iterable[Extension] | None) -> dict[str, Column]:
    """Top-level keys and values of the computed part of a payload.

    Items go in the order of their paths and are grouped by first segment.  A path of one segment gives a plain value
    and rules out its group's other items; longer paths make nested objects, which merge shallowly: of two items with
    the same second segment the later one stays whole.
    """
    groups: dict[str, list[tuple[list[str], Column]]] = {}
    for x in sorted(extensions or (), key=lambda x: x.json_path):
        first, *rest = x.json_path.split(".")
        groups.setdefault(first, []).append((rest, expression(x.expression)))
    out: dict[str, Column] = {}
    for key in sorted(groups):
        plain = next((value for rest, value in groups[key] if not rest), None)
        if plain is not None:
            out[key] = plain
            continue
        members: dict[str, Column] = {}
        for rest, value in groups[key]:
            for name in reversed(rest[1:]):
                value = F.struct(value.alias(name))
            members[rest[0]] = value
        out[key] = F.struct(*[v.alias(k) for k, v in members.items()])
    return out


def image(side: str, columns: Sequence[str]) -> Column:
    """The subscribed columns of a row image; no columns make an empty object."""
    if not columns:
        return empty_object()
    return F.struct(*[F.col(f"{side}.{quoted(c)}").alias(c) for c in columns])


def payload_members(key: str, operation: str, schema: str, table: str, columns: Sequence[str], extensions: Iterable[Extension] | None, txn_ts: Column) -> dict[str, Column]:
    """All top-level members of a payload: name, images, trigger context, then extensions, which override."""
    none = F.lit(None).cast("string")
    members = {
        "tg_name": F.lit(key),
        "new": none if operation == "DELETE" else image("new", columns),
        "old": none if operation == "INSERT" else image("old", columns),
        "tg_op": F.lit(operation),
        "tg_table_name": F.lit(table),
        "tg_table_schema": F.lit(schema),
        "timestamp": epoch_ms(txn_ts),
    }
    return members | build_extensions(extensions)


def to_payload(members: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]), JSON)
