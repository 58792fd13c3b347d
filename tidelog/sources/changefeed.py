"""Change feeds: rows with the images before and after, from inserted rows, snapshots, messages or files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.payload import quoted


def _row(df: DataFrame, alias: str) -> Column:
    return F.struct(*[F.col(quoted(c)).alias(c) for c in df.columns]).alias(alias)


def row_identity(df: DataFrame) -> Column:
    """A hash that tells even equal rows apart and is the same when a task or a batch runs again.

    Rows of Parquet files have their file and their place in it; others, where they are no stream, their place among the
    rows of their task; what remains is the row itself.
    """
    row = F.struct(*[F.col(quoted(c)) for c in df.columns])
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
        return F.xxhash64("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return F.xxhash64(row) if df.isStreaming else F.xxhash64(row, F.monotonically_increasing_id())


def inserts_from(df: DataFrame, table: str, schema: str = "public", txn_ts: Column | None = None, change_id: Column | None = None) -> DataFrame:
    """Every row as an INSERT; without a ``change_id`` it is the row's identity."""
    row = _row(df, "new")
    return df.select(
        F.lit("INSERT").alias("op"), F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), row, F.lit(None).cast(T.StructType(df.schema.fields)).alias("old"),
        (txn_ts if txn_ts is not None else F.current_timestamp()).cast("timestamp").alias("txn_ts"), (change_id if change_id is not None else row_identity(df)).alias("change_id"),
    )


def snapshot_diff(before: DataFrame, after: DataFrame, key: Sequence[str], table: str, schema: str = "public", txn_ts: Column | None = None) -> DataFrame:
    """The changes between two snapshots with a primary key, as INSERT, UPDATE and DELETE; one full outer join.

    An update that changes nothing leaves no trace in snapshots and makes no row.
    """
    key = list(key)
    old = before.select(*[F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(key)], _row(before, "old"))
    new = after.select(*[F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(key)], _row(after, "new"))
    names = [f"_k{i}" for i in range(len(key))]
    op = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").when(~F.col("old").eqNullSafe(F.col("new")), "UPDATE")
    rows = old.join(new, names, "full_outer").withColumn("op", op).where("op IS NOT NULL")
    return rows.select(
        "op", F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), "new", "old",
        (txn_ts if txn_ts is not None else F.current_timestamp()).cast("timestamp").alias("txn_ts"), F.xxhash64("op", *names, "old", "new").alias("change_id"),
    )


def insert_messages(messages: DataFrame) -> DataFrame:
    """Only the inserts of a stream of change messages; begin, commit, update, delete, relation, truncate and others go."""
    return messages.where(F.upper("op") == "INSERT")


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType | str, latest: bool = True) -> DataFrame:
    """A streaming change feed from JSON messages of a topic, from its end on or from its start; each has its position.

    Needs Spark's Kafka package on the cluster.
    """
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest" if latest else "earliest").load()
    return rows.select(F.from_json(F.col("value").cast("string"), schema).alias("m"), F.xxhash64("topic", "partition", "offset").alias("change_id")).select("m.*", "change_id")


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, max_files: int | None = None) -> DataFrame:
    """A streaming change feed from Parquet files; ``streaming.runner.skip_history`` seeds a new checkpoint so that the
    files that are there already do not count."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
