"""Helpers shared by the corpus operators: shared tables, Arrow batches, text arrays and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_scopes: list[list[DataFrame]] = []
MASK64 = (1 << 64) - 1
ONE_TASK = 1 << 20  # so many edges of a graph a task can hold


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where driver and executors are one process may it be unset; a temporary folder takes its place there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes ``path`` when the driver's JVM ends, however the Python process ends."""
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, every finished execution frees its shuffle files at once; a lost executor meanwhile is recovered as ever."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes ``df`` once to the shared folder and reads it back, so lost executors lose nothing.

    The table goes with ``drop_stored``, at the end of a ``released`` block around it, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    for scope in _scopes[-1:]:
        scope.append(out)
    return out


def drop_stored(df: DataFrame) -> None:
    """Frees a table made by ``stored`` that nothing reads any more."""
    delete_path(df.sparkSession, df._stored_path)


@contextmanager
def released() -> Iterator[None]:
    """Frees at its end all tables that were ``stored`` inside; what is built from them must have been written by then."""
    scope: list[DataFrame] = []
    _scopes.append(scope)
    try:
        yield
    finally:
        _scopes.remove(scope)
        for df in scope:
            drop_stored(df)


def loose(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` (with long keys) without what Spark knows of its partitioning.

    A join with an aggregate on the same keys would reuse the aggregate's partitioning, and then a hot key of the other
    side stays in one task; with both sides dealt for the join, adaptive execution can split that key.
    """
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("bigint")) for k in keys})


def tokenizer(spark: SparkSession, name: str) -> str:
    """The path of a vocabulary file; the setting ``spark.tidelog.tokenizers`` names a folder that all executors have."""
    return f"{spark.conf.get('spark.tidelog.tokenizers', '/opt/tokenizers').rstrip('/')}/{name}"


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the rows of an Arrow batch, as texts may be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df`` with its batches mapped by ``fn``.  On what ``map_batches`` returned, both functions run in one Python worker:
    a step of its own would give every task one more worker, which Spark keeps and hands to later tasks in turn, so that
    each one's tables fill an executor's memory.
    """
    small_batches(df.sparkSession)
    source, first = vars(df).get("_mapped", (df, None))
    both = (lambda batches: fn(first(batches))) if first else fn
    out = source.mapInArrow(both, schema)
    out._mapped = source, both
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """word -> 64-bit hash, remembered; forgotten as a whole beyond ``limit`` words so that memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 0)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the runs of ``size`` words, in order; fewer words make one run, none make none."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        out = (out + words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix64(out)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def local_components(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the edges (a, b); ``labels`` continues an earlier result."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(nxt := labels[labels], labels):
            labels = nxt
    return labels


def triangle_blocks(members: DataFrame, group: str, item: str, count: str, shard: int) -> DataFrame:
    """Deals groups of any size to tasks so that every two members of a group meet, with at most ``2 * shard`` rows in a block.

    ``members`` has a row for each member with its group's size in ``count``.  A group is salted into
    ``ceil(count / shard)`` shards and each pair of shards is a block; a group of one shard is one block.
    Adds ``block`` (long, hashed from group and shard pair), ``side`` (0: the first shard, 1: the second).
    """
    n = F.ceil(F.col(count) / F.lit(shard)).cast("int")
    own = F.pmod(F.xxhash64(F.col(item), F.lit(7)), n).cast("int")
    other = F.when(n == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1))
    out = members.withColumn("_own", own).withColumn("_other", F.explode(other))
    lo, hi = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(F.col("_own") == lo, 0).otherwise(1).cast("int")
    return out.withColumn("block", F.xxhash64(F.col(group), lo, hi)).withColumn("side", side).withColumn("_diagonal", lo == hi).drop("_own", "_other")


def blocks_in_order(batches: Iterator[pa.RecordBatch], key: str = "block", rows: int = 20_000) -> Iterator[pa.Table]:
    """Joins the sorted batches of a partition to tables that hold whole blocks only; a table ends at a block's end once it has ``rows`` rows."""
    kept: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.concat_tables(kept).combine_chunks()
        keys = table[key].to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if cut:
            yield table.slice(0, cut)
        kept, size = [table.slice(cut)], len(table) - cut
    if size:
        yield pa.concat_tables(kept).combine_chunks()


def forests(edges: DataFrame, rows: int = 1 << 18, roots: bool = False) -> DataFrame:
    """Fewer edges (a, b) that connect the same nodes: of each run of a partition's rows a star forest, ``b`` the smallest node.

    A run goes on while its forest stays small, so edges between the same nodes again and again become one.  ``roots``
    adds the edge from each smallest node to itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size = 0
        forest = np.zeros((2, 0), np.int64)

        def grown() -> np.ndarray:
            edge = np.concatenate([forest, *kept], axis=1)
            nodes, at = np.unique(edge, return_inverse=True)
            a, b = at.reshape(edge.shape)
            labels = local_components(len(nodes), a, b)
            held = np.flatnonzero((labels != np.arange(len(nodes))) | roots)
            return np.stack([nodes[held], nodes[labels[held]]])

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in forest], ["a", "b"])

        for batch in batches:
            batch = batch.filter(pc.not_equal(batch.column("a"), batch.column("b")))
            kept.append(np.stack([batch.column(k).to_numpy() for k in ("a", "b")]))
            size += batch.num_rows
            if size >= rows:
                forest, kept = grown(), []
                size = forest.shape[1]
                if 2 * size > rows:
                    yield out()
                    forest, size = forest[:, :0], 0
        forest = grown()
        yield out()

    return map_batches(edges, run, "a long, b long")


def components(edges: DataFrame, bound: int = ONE_TASK) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as rows (node, root), root the smallest node; isolated nodes have no row.

    Every task first reduces the edges that it has to forests.  What ``bound`` edges or fewer are left is solved in one
    task, whose memory that bounds.  While there are more, large-star and small-star steps alternate over tables in the
    shared folder until nothing changes.  Every step pre-aggregates on a node before the shuffle and joins in a way that
    adaptive execution can split, so a node with very many edges need not meet in one task.
    """

    def norm(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges, stored, with their count and a sum of their hashes, which the write itself observes."""
        seen = Observation()
        out = stored(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")))
        return out, (seen.get["n"], seen.get["h"])

    now, seen = kept(forests(edges))
    if seen[0] > bound:
        first = now
        now, seen = kept(norm(first))
        drop_stored(first)
    while seen[0] > bound:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(loose(least, "a"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(loose(low, "a"), "a").select("b", "m").toDF("a", "b").unionByName(low.toDF("a", "b"))
        nxt, at = kept(norm(small))
        drop_stored(now)
        now = nxt
        if at == seen:
            break
        seen = at
    else:
        done = stored(forests(now.coalesce(1), bound + 1, roots=True))
        drop_stored(now)
        return done.toDF("node", "root")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
