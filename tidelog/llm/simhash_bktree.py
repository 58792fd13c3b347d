"""SimHash near-duplicates found with sharded BK-trees.

Fingerprints follow the contract: ASCII lower-casing, words between ASCII white space, runs of three words,
XXH64 with seed 42 of each run, and a bit for each position that is set in over half of the hashes.

Two fingerprints within 3 of 64 bits agree in at least one of four 16-bit blocks, and then in at least one of four
12-bit blocks of the rest, so each distinct fingerprint goes under 16 keys of 28 exact bits and only equal keys meet.
Under each key the fingerprints are dealt to shards of bounded size; a BK-tree is built for each shard (children keyed
by their integer distance to the parent) and queried by its own and by the other shards of that key, following only
edges within the radius.  Tasks return a spanning forest of the links that they find, never all pairs.

Defined cases: a null text counts as empty (fingerprint zero); a null doc_id keeps its row, its component is the
smallest known doc_id (null where none is known); repeated rows are kept, one result row each; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks_in_order, components, local_components, loose, map_batches, partitions, stored, triangle_blocks

RADIUS = 3
SHARD = 4096


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= 3:
        hashes = [digest(line, 42)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        hashes = [digest(line[a:b], 42) for a, b in zip([0, *ends[:-3]], (e - 1 for e in ends[2:]), strict=True)]
    total, n = np.zeros(64, np.int64), len(hashes)
    data = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    for k in range(0, n, 4096):
        bits = np.unpackbits(data[k : k + 4096], axis=1)
        total += np.ones(len(bits), np.float32).dot(bits.astype(np.float32)).astype(np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str] | None = None, name: str = "fp") -> DataFrame:
    """doc_id (or the columns in ``keep``) with the fingerprint as a signed long in the column ``name``."""
    keep = keep or ["doc_id"]
    src = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(fp)], [*keep, name])

    return map_batches(src, run, T.StructType([*src.select(*keep).schema.fields, T.StructField(name, T.LongType())]))


class BKForest:
    """A BK-tree for each group, built for all groups level by level: ``child[node, distance]`` or -1."""

    def __init__(self, groups: np.ndarray, fps: np.ndarray):
        self.fps = fps
        self.groups, first = np.unique(groups, return_index=True)
        self.roots = first
        self.child = np.full((len(fps), 65), -1, np.int32)
        at = first[np.searchsorted(self.groups, groups)]
        left = np.flatnonzero(at != np.arange(len(fps)))
        at = at[left]
        while len(left):
            d = np.bitwise_count(fps[left] ^ fps[at])
            code = at.astype(np.int64) * 65 + d
            uniq, where, inv = np.unique(code, return_index=True, return_inverse=True)
            self.child.reshape(-1)[uniq] = left[where]
            at = left[where][inv]
            more = at != left
            left, at = left[more], at[more]

    def links(self, groups: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) within the radius, following only edges whose distance is within the radius of the query's."""
        steps = np.arange(-radius, radius + 1)
        for k in range(0, len(fps), 512):
            q = np.arange(k, min(k + 512, len(fps)))
            slot = np.searchsorted(self.groups, groups[q])
            slot[slot == len(self.groups)] = 0
            hit = self.groups[slot] == groups[q]
            q, node = q[hit], self.roots[slot[hit]]
            while len(q):
                d = np.bitwise_count(fps[q] ^ self.fps[node]).astype(np.int64)
                near = d <= radius
                yield q[near], node[near]
                at = d[:, None] + steps
                ok = (at >= 1) & (at <= 64)
                nxt = np.where(ok, self.child[node[:, None], np.where(ok, at, 0)], -1)
                r, c = np.nonzero(nxt >= 0)
                q, node = q[r], nxt[r, c]


def block_links(block: np.ndarray, side: np.ndarray, diagonal: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (fp, fp of its root) of the links inside the blocks of a batch; rows are sorted by block."""
    tree = np.flatnonzero(side == 0)
    query = np.flatnonzero(diagonal | (side == 1))
    forest = BKForest(block[tree], fp[tree])
    labels = np.arange(len(fp))
    for q, node in forest.links(block[query], fp[query], radius):
        labels = local_components(len(fp), query[q], tree[node], labels)
    moved = np.flatnonzero(labels != np.arange(len(fp)))
    return fp[moved], fp[labels[moved]]


def keyed(fps: DataFrame) -> DataFrame:
    """Each fingerprint under its 16 keys: block i, sub-block j of the other 48 bits, and their 28 bits."""
    fp, keys = F.col("fp"), []
    part = lambda i: F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
    for i in range(4):
        others = [part(k) for k in range(4) if k != i]
        rest = F.shiftleft(others[2], 32).bitwiseOR(F.shiftleft(others[1], 16)).bitwiseOR(others[0])
        for j in range(4):
            sub = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((i * 4 + j) << 28).bitwiseOR(F.shiftleft(part(i), 12)).bitwiseOR(sub))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def links(fps: DataFrame, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within the radius of each other, as spanning forests."""
    rows = keyed(fps)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = triangle_blocks(rows.join(loose(sizes, "key"), "key"), "key", "fp", "n", shard)
    blocks = blocks.select("block", "side", F.col("_diagonal").alias("diagonal"), "fp").repartition(partitions(fps.sparkSession), "block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks_in_order(batches):
            a, b = block_links(t["block"].to_numpy(), t["side"].to_numpy(), t["diagonal"].to_numpy(zero_copy_only=False), t["fp"].to_numpy().view(np.uint64))
            pairs = np.unique(np.stack([a.view(np.int64), b.view(np.int64)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return map_batches(blocks, run, "a long, b long")


def grouped(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """doc_id, fp, component_id and root (the component's smallest fingerprint) of every row of ``docs``.

    Components are labelled over distinct fingerprints; rows then join by their fingerprint, which adaptive execution
    can split where one fingerprint has many rows.
    """
    fps = stored(fingerprints(docs))
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(first.select("fp"), shard)).select(F.col("node").alias("fp"), "root")
    by_fp = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = by_fp.select("fp", "root").join(loose(best, "root"), "root")
    return fps.join(loose(labels, "fp"), "fp").select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row of ``docs``."""
    return grouped(docs, shard).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id.

    Of repeated rows of that doc_id one stays for each component that it is the smallest of.  Where a component has no known doc_id, one of its rows stays for each
    smallest fingerprint.  Only rows whose doc_id occurs more than once are sorted to choose among them.
    """
    own, u = docs.columns, "_"
    while any(c.startswith(u) for c in own):
        u += "_"
    n, fp, at, rank, row_fp, root, least = (f"{u}{x}" for x in ("n", "fp", "id", "rank", "row_fp", "root", "least"))
    near = stored(grouped(docs))
    first = near.where(F.col("doc_id") == F.col("component_id"))
    times = near.groupBy("doc_id").agg(F.count("*").alias(n), F.max(F.col("doc_id") == F.col("component_id")).alias(least)).where(F.col(least))
    single = docs.join(times.where(F.col(n) == 1).select("doc_id"), "doc_id", "left_semi")
    several = times.where(F.col(n) > 1).select("doc_id")
    pick = lambda df, key: df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(row_fp, F.xxhash64("text")))).where(F.col(rank) == 1).select(*own)
    kept = first.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias(at), F.col("fp").alias(fp), F.col("root").alias(root)).distinct()
    again = fingerprints(docs.join(several, "doc_id", "left_semi"), own, row_fp)
    again = again.join(kept, (F.col("doc_id") == F.col(at)) & (F.col(row_fp) == F.col(fp)))
    unknown = near.where("component_id IS NULL").select(F.col("fp").alias(fp)).distinct()
    nulls = fingerprints(docs.where("doc_id IS NULL"), own, row_fp).join(unknown, F.col(row_fp) == F.col(fp), "left_semi")
    return single.select(*own).unionByName(pick(again, ["doc_id", root])).unionByName(pick(nulls, [row_fp]))
