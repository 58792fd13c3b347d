"""Daily partitions: which to create, which to drop, and doing so."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import partition_date, partition_date_column, partition_name, partition_name_column

RETENTION_DAYS, DAYS_AHEAD, PERIOD = 7, 7, timedelta(hours=24)
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Plan:
    drop: list[str]
    create: list[str]


def plan(existing: list[str], now: datetime, base: str = "events", days_ahead: int = DAYS_AHEAD, retention: int = RETENTION_DAYS) -> Plan:
    """Names to drop (days before ``now - retention``) and to create (today and the days ahead that are missing).

    Names of another form are left alone, with a warning.
    """
    days: dict[date, str] = {}
    for name in existing:
        try:
            days[partition_date(name)] = name
        except ValueError:
            log.warning("partition %s has no date, left alone", name)
    today = now.date()
    drop = [days[d] for d in sorted(days) if d < today - timedelta(days=retention)]
    create = [partition_name(base, d) for k in range(days_ahead) if (d := today + timedelta(days=k)) not in days]
    return Plan(drop, create)


def existing_partitions(events: DataFrame, base: str = "events") -> DataFrame:
    """name, date of the days that the log has, by name."""
    days = events.select(F.to_date("created_at" if "event_date" not in events.columns else "event_date").alias("date")).distinct()
    return days.select(partition_name_column(base, F.col("date")).alias("name"), "date").orderBy("name")


def to_drop(partitions: DataFrame, now: datetime, retention: int = RETENTION_DAYS) -> DataFrame:
    day = partition_date_column(F.col("name"))
    return partitions.select("name", day.alias("date")).where(F.col("date") < F.date_sub(F.lit(now).cast("date"), retention))


def to_create(partitions: DataFrame, now: datetime, base: str = "events", days_ahead: int = DAYS_AHEAD) -> DataFrame:
    today = F.lit(now).cast("date")
    days = partitions.sparkSession.range(1).select(F.explode(F.sequence(today, F.date_add(today, days_ahead - 1))).alias("date"))
    missing = days.join(partitions.select(partition_date_column(F.col("name")).alias("date")), "date", "left_anti")
    return missing.select(partition_name_column(base, F.col("date")).alias("name"), "date")


def list_days(spark: SparkSession, path: str) -> list[date]:
    """The days of a log on storage, from its directory names."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(date.fromisoformat(n.split("=", 1)[1]) for n in names if n.startswith("event_date=") and len(n) == 21)


def listed_partitions(spark: SparkSession, path: str, base: str = "events") -> DataFrame:
    """name, date of the days of a log on storage, by name; its directories are listed, no event is read."""
    return spark.createDataFrame([(partition_name(base, d), d) for d in list_days(spark, path)], "name string, date date")


def run(spark: SparkSession, path: str, now: datetime, base: str = "events") -> Plan:
    """Drops the expired days of a log; days ahead need no creation, as a write makes its directory."""
    made = plan([partition_name(base, d) for d in list_days(spark, path)], now, base)
    jvm = spark.sparkContext._jvm
    for name in made.drop:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/event_date={partition_date(name).isoformat()}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return made


MIGRATIONS = {
    1: "CREATE TABLE IF NOT EXISTS {name} (id STRING NOT NULL, payload STRING NOT NULL, metadata STRING, stream_id BIGINT NOT NULL, created_at TIMESTAMP NOT NULL, event_date DATE, batch STRING) USING parquet PARTITIONED BY (event_date, batch) LOCATION '{path}'",
    2: "ALTER TABLE {name} ADD COLUMNS (lsn DECIMAL(20,0))",
}


def migrate(spark: SparkSession, path: str, name: str = "events") -> list[int]:
    """Brings the log's table in the catalogue up to the newest schema; the steps that were done, in order, once each."""
    done = int(dict(r[:2] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()).get("schema_step", 0)) if spark.catalog.tableExists(name) else 0
    steps = [k for k in sorted(MIGRATIONS) if k > done]
    for k in steps:
        spark.sql(MIGRATIONS[k].format(name=name, path=path))
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('schema_step' = '{k}')")
    return steps


def table_id(spark: SparkSession, name: str = "events") -> str:
    """The qualified name of a table of the catalogue; LookupError where there is none."""
    if not spark.catalog.tableExists(name):
        raise LookupError(f"no table {name}")
    t = spark.catalog.getTable(name)
    return ".".join([t.catalog or "spark_catalog", *(t.namespace or []), t.name])


def find_table(classes: DataFrame, namespaces: DataFrame, schema: str, name: str) -> DataFrame:
    """table_id of a table among catalogue rows: classes (table_id, name, namespace_id), namespaces (namespace_id, name)."""
    spaces = namespaces.where(F.col("name") == schema).select("namespace_id")
    return classes.where(F.col("name") == name).join(F.broadcast(spaces), "namespace_id").select("table_id")
