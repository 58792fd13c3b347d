"""Positions, identifiers, times and names, as Column expressions or plain helpers."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

LSN_TYPE = "decimal(20,0)"


def lsn_to_decimal(text: Column) -> Column:
    """A log position ``X/Y`` (hex halves) as an unsigned 64-bit number; NULL for text of another form."""
    ok = text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$")
    half = lambda i: F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast(LSN_TYPE)
    return F.when(ok, (half(1) * F.lit(1 << 32).cast("decimal(11,0)") + half(2)).cast(LSN_TYPE))


def lsn_to_text(lsn: Column) -> Column:
    """The inverse of ``lsn_to_decimal``."""
    high = F.floor(lsn / F.lit(1 << 32).cast("decimal(11,0)")).cast(LSN_TYPE)
    low = (lsn - high * F.lit(1 << 32).cast("decimal(11,0)")).cast(LSN_TYPE)
    return F.concat_ws("/", F.hex(high.cast("bigint")), F.hex(low.cast("bigint")))


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp, rounded half away from zero as a numeric-to-integer cast rounds."""
    return F.round(F.unix_micros(ts.cast("timestamp")).cast("decimal(20,0)") / 1000, 0).cast("bigint")


def uuid7(ts: Column, seed: Column | None = None) -> Column:
    """A time-ordered UUID (version 7): 48 bits of floored epoch milliseconds, then random bits.

    With ``seed`` the random bits are its hash, so that a retried task makes the same identifiers.
    """
    ms = F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("bigint")
    time = F.lower(F.lpad(F.hex(ms), 12, "0"))
    bits = F.md5(seed.cast("string")) if seed is not None else F.replace(F.uuid(), F.lit("-"), F.lit(""))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substr(bits, F.lit(16), F.lit(1)), 16, 10).cast("int") % 4 + 1)
    part = lambda x, a, n: F.substr(x, F.lit(a), F.lit(n))
    return F.concat_ws("-", part(time, 1, 8), part(time, 9, 4), F.concat(F.lit("7"), part(bits, 13, 3)), F.concat(variant, part(bits, 17, 3)), part(bits, 20, 12))


def event_key(created_at: str = "created_at", id_: str = "id") -> Column:
    """The total order of the event log."""
    return F.struct(F.col(created_at).alias("created_at"), F.col(id_).alias("id"))


def slot_name(stream_id: int) -> str:
    return f"tidelog_stream_{stream_id}"


def publication_name(stream_id: int) -> str:
    return f"tidelog_publication_{stream_id}"


def partition_name(base: str, day: date) -> str:
    return f"{base}_{day:%Y%m%d}"


def partition_date(name: str) -> date:
    """The day of a partition name ``base_YYYYMMDD``; ValueError for other names."""
    base, _, digits = name.rpartition("_")
    if not base or not re.fullmatch(r"\d{8}", digits):
        raise ValueError(f"not a daily partition: {name}")
    return datetime.strptime(digits, "%Y%m%d").date()


def partition_bounds(day: date) -> tuple[str, str]:
    """The half-open range of a daily partition."""
    return day.isoformat(), (day + timedelta(days=1)).isoformat()


def partition_bounds_columns(day: Column) -> tuple[Column, Column]:
    """``partition_bounds`` of each day."""
    return F.date_format(day, "yyyy-MM-dd"), F.date_format(F.date_add(day, 1), "yyyy-MM-dd")


def partition_date_column(name: Column) -> Column:
    """The day of each partition name, NULL for names of another form."""
    return F.when(name.rlike("^.+_[0-9]{8}$"), F.try_to_date(F.substring_index(name, "_", -1), "yyyyMMdd"))


def partition_name_column(base: str, day: Column) -> Column:
    return F.concat(F.lit(f"{base}_"), F.date_format(day, "yyyyMMdd"))
