"""Substring dedup: passages that repeat across documents, found by paragraph MinHash banding.

What is found: passages of at least ``LEAST`` words that two different texts share, exactly or with a Jaccard similarity
of their five-word shingles of ``JACCARD`` or more, and whole texts of so many words that several documents have.

Paragraphs.  A paragraph is a line; each of at least ``LEAST`` words gets a MinHash signature of its five-word shingles,
cut into ``BANDS`` bands of ``ROWS`` values.  Two sets of similarity s collide with probability 1 - (1 - s**ROWS)**BANDS:
with 20 bands of 5 values that is 0.9996 at 0.8 and 0.47 at 0.5.  Equal paragraphs are first collapsed to one digest.
Colliding digests are joined through their band key (each with the smallest digest of the key, not all pairs).  In every
component of collisions each paragraph is compared, by exact Jaccard similarity, with ``HUBS`` members that a hash picks;
only paragraphs that are not linked to the component's main cluster by that are compared with all others, in blocks of
bounded size, so a group of near copies takes time in proportion to its size.  Verified links are clustered by components.

Passages inside paragraphs, or over several.  Windows of ``WINDOW`` words that start at content-defined anchors (a word
pair whose hash is the smallest within ``REACH`` words on either side) are hashed.  Every text that shares a window with
others is paired with two of them, those with the smallest and the largest number of the window; a pair's shared windows
are grown word by word in both texts to maximal runs, runs with small gaps between them are chained, and a chain is a
passage where it is long enough and its similarity, counted from its runs, reaches ``JACCARD``.

A text's number is a hash of it, so equal texts are one; results come back to documents at the end.

Defined cases: a null text counts as empty and has no passage; every different text of a null or repeated doc_id is a
document of its own; repeated rows count once; passages under ``LEAST`` words are never removed; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, blocks_in_order, codepoints, components, drop_stored, local_components, loose, map_batches, mix64, partitions, shingle_hashes, stored

LEAST, WINDOW, REACH, RUN, GAP, BLOCK = 50, 14, 4, 5, 25, 128
BANDS, ROWS, JACCARD, HUBS = 20, 5, 0.8, 4
PASSES = 2  # the bands move in so many turns, each freeing its shuffle files, to bound the disk
SHARD, PIECE = 512, 1 << 17
PARAGRAPH, SEED, WHOLE = 0, 1, 2  # kinds of units

_rng = np.random.default_rng(20240601)
_MUL = (_rng.integers(1, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint64).astype(np.uint32)[:, None]
_SPACE = np.array([chr(i).isspace() for i in range(0x3001)])


class Words:
    """The words of several texts at once: hashes, spans (code points of their own text), line and text number of each."""

    def __init__(self, texts: list[str], known: WordHash):
        joined = "\n".join(texts)
        low = joined.lower()
        self.hashes = known.of(low.split() if len(low) == len(joined) else [x.lower() for x in joined.split()])
        cp = codepoints(joined)
        space = _SPACE[np.minimum(cp, 0x3000)] & (cp <= 0x3000)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        size = np.array([len(t) + 1 for t in texts], np.int64)
        begin = np.cumsum(size) - size
        self.text = np.searchsorted(begin, starts, "right") - 1
        self.line = np.searchsorted(np.flatnonzero(cp == 10), starts)
        self.starts, self.ends = starts - begin[self.text], ends - begin[self.text]
        self.stop = np.searchsorted(self.text, np.arange(len(texts)), "right")  # the end of each text's words


def pieces(*columns: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, list]]:
    """Runs of rows (number of the first, texts) with about PIECE code points or one long row each; of several columns
    the rows' texts are tuples."""
    part, size, first = [], 0, 0
    for i, row in enumerate(zip(*columns, strict=True)):
        texts = tuple(t.as_py() or "" for t in row)
        part.append(texts if len(columns) > 1 else texts[0])
        size += sum(map(len, texts))
        if size >= PIECE:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def band_hashes(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash bands [paragraph, band] of the paragraphs whose shingles begin at ``starts``."""
    if not len(starts):
        return np.zeros((0, BANDS), np.int64)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(_MUL), len(starts)), np.uint32)
    for k in range(0, len(_MUL), 10):
        x = h * _MUL[k : k + 10] + _ADD[k : k + 10]
        x ^= x >> np.uint32(15)
        least[k : k + 10] = np.minimum.reduceat(x, starts, axis=1)
    out = np.zeros((BANDS, len(starts)), np.uint64)
    for r in range(ROWS):
        out = mix64(out * np.uint64(31) + least[r::ROWS])
    return (mix64(out + np.arange(BANDS, dtype=np.uint64)[:, None])).T.view(np.int64)


def paragraphs(w: Words, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, end, digest and first shingle of each paragraph of at least ``least`` words, and all their shingles."""
    first = np.flatnonzero(np.diff(w.line, prepend=-1))
    last = np.append(first[1:], len(w.line))[: len(first)]
    long = last - first >= max(5, least)
    first, last = first[long], last[long]
    none = np.zeros(0, np.int64)
    if not len(first):
        return first, last, none, none, np.zeros(0, np.uint64)
    size = last - first - 4
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    every = shingle_hashes(w.hashes)[np.repeat(first, size) + place]
    digest = np.add.reduceat(mix64(every + place.astype(np.uint64)), at).view(np.int64)
    return first, last, digest, at, every


def windows(w: Words, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each anchored window of WINDOW words, of the texts of at least ``least`` words."""
    n = len(w.hashes)
    if n < max(WINDOW, least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair = mix64(w.hashes[:-1] * np.uint64(3) + w.hashes[1:])
    same = np.flatnonzero(w.text[:-1] == w.text[1:])
    spot = same + REACH * (w.text[same] + 1)  # REACH empty places part the texts
    padded = np.full(n + REACH * (len(w.stop) + 2), np.iinfo(np.uint64).max, np.uint64)
    padded[spot] = pair[same]
    low = padded[: len(padded) - 2 * REACH].copy()
    for k in range(1, 2 * REACH + 1):
        np.minimum(low, padded[k : len(low) + k], out=low)
    at = same[low[spot - REACH] == pair[same]]
    size = np.diff(w.stop, prepend=0)
    at = at[(at + WINDOW <= w.stop[w.text[at]]) & (size[w.text[at]] >= least)]
    powers = np.cumprod(np.full(WINDOW, 0x9E3779B97F4A7C15, np.uint64))
    mixed, total = mix64(w.hashes), np.zeros(len(at), np.uint64)
    for k in range(WINDOW):
        total += mixed[at + k] * powers[k]
    return at, mix64(total).view(np.int64)


def number() -> Column:
    """The number of a text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def units(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """tid (the text's number), start, length (code points; 0 for windows), kind, digest, bands of every unit.

    Texts of ``least`` or more words have a unit WHOLE from their first to their last word.  Bands are null for all but
    paragraphs, and where the task gave an equal paragraph's bands before.
    """
    fields = pa.schema([("tid", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("kind", pa.int8()), ("digest", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, given = WordHash(), set()
        for b in batches:
            for begin, texts in pieces(b.column("text")):
                w = Words(texts, known)
                first, last, digest, own, every = paragraphs(w, least)
                at, hashes = windows(w, least)
                stop = w.stop
                head = np.append(0, stop[:-1])
                whole = np.flatnonzero(stop - head >= max(1, least))
                text = np.concatenate([w.text[first], w.text[at], whole])
                start = np.concatenate([w.starts[first], w.starts[at], w.starts[head[whole]]])
                end = np.concatenate([w.ends[last - 1], w.starts[at], w.ends[stop[whole] - 1]])
                kind = np.repeat(np.array([PARAGRAPH, SEED, WHOLE], np.int8), [len(first), len(at), len(whole)])
                if len(given) > known.limit:
                    given.clear()
                fresh = np.array([not (d in given or given.add(d)) for d in digest.tolist()], bool)
                size = np.diff(np.append(own, len(every)))
                bands = band_hashes(every[np.repeat(fresh, size)], np.cumsum(size[fresh]) - size[fresh])
                holds = np.append(fresh, np.zeros(len(at) + len(whole), bool))
                offsets = pa.array((np.cumsum(np.append(0, holds)) * BANDS).astype(np.int32), mask=np.append(~holds, False))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("tid").take(pa.array(begin + text)),
                        pa.array(start.astype(np.int32)),
                        pa.array((end - start).astype(np.int32)),
                        pa.array(kind),
                        pa.array(np.concatenate([digest, hashes, np.zeros(len(whole), np.int64)])),
                        pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1))),
                    ],
                    schema=fields,
                )

    return map_batches(docs.select(number().alias("tid"), "text"), run, "tid long, start int, length int, kind byte, digest long, bands array<long>")


def shingles_of(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """digest and distinct shingle hashes of every paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for b in batches:
            for _, part in pieces(b.column("text")):
                _, _, digest, at, every = paragraphs(Words(part, known), least)
                sets = [np.unique(x).view(np.int64) for x in np.split(every, at[1:])] if len(at) else []
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(digest), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], ["digest", "shingles"])

    return map_batches(texts.select("text"), run, "digest long, shingles array<long>")


def jaccard_links(sets: list[np.ndarray], side: np.ndarray, diagonal: bool, least: float = JACCARD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a block whose exact Jaccard similarity is at least ``least``, each index with those before it."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    a, b = [], []
    for i, s in enumerate(sets):
        lo, hi = np.searchsorted(every, s), np.searchsorted(every, s, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero(common >= least * (sizes + sizes[i] - common) - 1e-9)
        near = near[near < i]
        if not diagonal:
            near = near[side[near] != side[i]]
        a.append(np.full(len(near), i))
        b.append(near)
    return np.concatenate(a), np.concatenate(b)


def against_hubs(members: DataFrame) -> DataFrame:
    """digest, root, hub, mask, near: which of its component's hubs each member (digest, root, shingles) is linked with.

    ``near`` are the hubs' digests, ``mask`` a bit for each; ``hub`` marks the hubs themselves.
    """
    picks = members.groupBy("root").agg(F.array_distinct(F.array(*[F.min_by("digest", F.xxhash64("digest", F.lit(k))) for k in range(HUBS)])).alias("hubs"))
    chosen = picks.select("root", F.explode("hubs").alias("digest"))
    sets = members.select("digest", "shingles").join(loose(chosen, "root", "digest"), "digest")
    hubs = sets.groupBy("root").agg(F.collect_list(F.struct("digest", "shingles")).alias("hubs"))  # HUBS at most
    rows = members.join(loose(hubs, "root"), "root")
    hits = f"""transform(hubs, h -> transform(array(size(array_intersect(shingles, h.shingles))), i ->
        if(i >= {JACCARD}D * (size(shingles) + size(h.shingles) - i) - 1e-9D, h.digest, null))[0])"""
    rows = rows.select("digest", "root", F.exists("hubs", lambda h: h["digest"] == F.col("digest")).alias("hub"), F.expr(hits).alias("hits"))
    mask = "aggregate(transform(hits, (x, k) -> if(x is null, 0, shiftleft(1, k))), 0, (a, x) -> a | x)"
    return rows.select("digest", "root", "hub", F.expr(mask).alias("mask"), F.filter("hits", lambda x: x.isNotNull()).alias("near"))


def apart(seen: DataFrame) -> DataFrame:
    """root, reach, few, many: of components where members remain to be compared with each other.

    ``reach`` marks the hubs of the main cluster: those that the hub with most links is connected with through members.
    ``few`` members are linked to none of these, ``many`` are no hubs.  What is a hub has been compared with everything.
    """
    each = [F.col("mask").bitwiseAND(F.lit(1 << k)) != 0 for k in range(HUBS)]
    per = seen.groupBy("root").agg(*(F.count_if(e).alias(f"c{k}") for k, e in enumerate(each)), *(F.bit_or(F.when(e, F.col("mask")).otherwise(0)).alias(f"m{k}") for k, e in enumerate(each)))
    most = F.greatest(*(F.struct(F.col(f"c{k}").alias("c"), F.lit(1 << k).alias("bit"), F.lit(k).alias("k")) for k in range(HUBS)))
    masks = "array(" + ", ".join(f"m{k}" for k in range(HUBS)) + ")"
    step = f"aggregate(transform({masks}, (m, k) -> if(acc & shiftleft(1, k) <> 0, m, 0)), acc, (a, x) -> a | x)"
    main = per.select("root", most["bit"].alias("bit"), *(f"m{k}" for k in range(HUBS))).select("root", F.expr(f"aggregate(sequence(1, {HUBS}), bit, (acc, i) -> {step})").alias("reach"))
    cells = seen.where("NOT hub").groupBy("root", "mask").agg(F.count("*").alias("n"))  # a few a component, counted before they meet
    rows = cells.join(loose(main, "root"), "root")
    counts = rows.groupBy("root", "reach").agg(F.sum(F.when(F.col("mask").bitwiseAND(F.col("reach")) == 0, F.col("n")).otherwise(0)).alias("few"), F.sum("n").alias("many"))
    return counts.where("few > 0 AND many > 1")


def remaining_links(members: DataFrame, seen: DataFrame, left: DataFrame, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) that link members outside their component's main cluster with any others, from exact comparison.

    The ``few`` are dealt to shards and so are the ``many``; each two shards meet in a block.
    """
    rows = seen.where("NOT hub").select("digest", "root", "mask").join(loose(left, "root"), "root")
    shards = {c: F.ceil(F.col(c) / F.lit(shard)).cast("int") for c in ("few", "many")}
    own = {c: F.pmod(F.xxhash64("digest", F.lit(7)), n).cast("int") for c, n in shards.items()}
    span = lambda n: F.sequence(F.lit(0), n - 1)
    outside = rows.where(F.col("mask").bitwiseAND(F.col("reach")) == 0)
    a = outside.select("digest", "root", F.lit(0).alias("side"), own["few"].alias("i"), F.explode(span(shards["many"])).alias("j"))
    b = rows.select("digest", "root", F.lit(1).alias("side"), F.explode(span(shards["few"])).alias("i"), own["many"].alias("j"))
    blocks = a.unionByName(b).select(F.xxhash64("root", "i", "j").alias("block"), "side", "digest").join(members.select("digest", "shingles"), "digest")
    blocks = blocks.select("block", "side", "digest", "shingles").repartition(partitions(members.sparkSession), "block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks_in_order(batches, rows=2000):
            block, digest, side = t["block"].to_numpy(), t["digest"].to_numpy(), t["side"].to_numpy()
            lists = t["shingles"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            cut = np.append(np.flatnonzero(np.diff(block, prepend=block[0] + 1)), len(block))
            out_a, out_b = [], []
            for k, e in zip(cut[:-1], cut[1:], strict=True):
                x, y = jaccard_links([values[offsets[i] : offsets[i + 1]] for i in range(k, e)], side[k:e], False)
                labels = local_components(e - k, x, y)
                moved = np.flatnonzero(labels != np.arange(e - k))
                out_a.append(digest[k:e][moved])
                out_b.append(digest[k:e][labels[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return map_batches(blocks, run, "a long, b long")


def verified_links(members: DataFrame, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between members (digest, root, shingles; stored) that connect all that are linked within a component."""
    seen = stored(against_hubs(members))
    left = stored(apart(seen))
    to_hubs = seen.select(F.col("digest").alias("a"), F.explode("near").alias("b")).where("a <> b")
    return to_hubs.unionByName(remaining_links(members, seen, left, shard))


def collisions(every: DataFrame) -> list[DataFrame]:
    """Edges (a, b) from each digest to the smallest one of each of its band keys: a stored table for every turn of bands."""
    found, width = [], BANDS // PASSES
    for k in range(PASSES):
        some = F.slice("bands", k * width + 1, width)
        paras = every.where("bands IS NOT NULL").select("digest", some.alias("bands")).groupBy("digest").agg(F.first("bands").alias("bands"))
        keys = paras.select("digest", F.explode("bands").alias("key"))
        met = keys.groupBy("key").agg(F.min("digest").alias("b"))  # a key of one digest joins with itself only
        found.append(stored(keys.join(loose(met, "key"), "key").where("digest <> b").select(F.col("digest").alias("a"), "b")))
    return found


def seed_pairs(every: DataFrame) -> DataFrame:
    """d, h, seeds: texts that share windows, each with the first and the last text of a window (by number), and where.

    A seed is the window's start in d and in h, 32 bits each.
    """
    seeds = every.where(F.col("kind") == SEED).select("digest", "tid", "start")
    place = F.struct("tid", "start")
    ends = seeds.groupBy("digest").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo.tid <> hi.tid")
    ends = ends.select("digest", F.col("lo.tid").alias("lt"), F.col("lo.start").alias("ls"), F.col("hi.tid").alias("ht"), F.col("hi.start").alias("hs"))
    rows = seeds.join(loose(ends, "digest"), "digest")
    pair = lambda d, ds, h, hs: F.struct(d.alias("d"), h.alias("h"), F.shiftleft(ds.cast("long"), 32).bitwiseOR(hs.cast("long")).alias("seed"))
    c = F.col
    first = F.when(c("tid") != c("lt"), pair(c("tid"), c("start"), c("lt"), c("ls")))
    last = F.when((c("tid") != c("ht")) & (c("tid") != c("lt")), pair(c("ht"), c("hs"), c("tid"), c("start")))
    pairs = rows.select(F.explode(F.filter(F.array(first, last), lambda x: x.isNotNull())).alias("p")).select("p.*")
    return pairs.groupBy("d", "h").agg(F.collect_set("seed").alias("seeds"))  # as many as a text has windows, at most


def equal_runs(a: np.ndarray, b: np.ndarray, d: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, start and end in ``a`` of the stretches of equal words from a block before each block to one after it;
    and the blocks (diagonal * 2**32 + block) beyond these where most words still agree."""
    at = block[:, None] * BLOCK + np.arange(-BLOCK, 2 * BLOCK)
    to = at - d[:, None]
    inside = (at >= 0) & (at < len(a)) & (to >= 0) & (to < len(b))
    same = np.zeros((len(d), 3 * BLOCK + 2), np.int8)
    same[:, 1:-1] = inside & (a[np.clip(at, 0, len(a) - 1)] == b[np.clip(to, 0, len(b) - 1)])
    edge = np.diff(same, axis=1)
    row, s = np.nonzero(edge == 1)
    e = np.nonzero(edge == -1)[1]
    left, right = same[:, 1:33].sum(axis=1) > 16, same[:, -33:-1].sum(axis=1) > 16
    more = np.concatenate([(d * (1 << 32) + block - 1)[left & (block > 0)], (d * (1 << 32) + block + 1)[right & ((block + 1) * BLOCK < len(a))]])
    return d[row], (block[row] - 1) * BLOCK + s, (block[row] - 1) * BLOCK + e, more


def runs_of(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, diagonal) in ``a`` of the maximal runs of RUN or more equal words on the diagonals of the seeds, in the
    seeds' blocks, those beside them, and on as far as most words agree."""
    code = seen = np.unique((pa_ - pb) * (1 << 32) + pa_ // BLOCK)
    parts = []
    while len(code):
        parts += [equal_runs(a, b, c >> 32, c & 0xFFFFFFFF) for c in np.split(code, range(2048, len(code), 2048))]
        code = np.setdiff1d(np.concatenate([p[3] for p in parts]), seen)
        seen = np.union1d(seen, code)
    if not parts:
        return []
    d, s, e = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort([s, d])
    d, s, e = d[order], s[order], e[order]
    wide = len(a) + 1
    far = np.maximum.accumulate(e + (d - d[0]) * wide) if len(d) else e
    head = np.flatnonzero(np.append(True, s[1:] + (d[1:] - d[0]) * wide > far[:-1])) if len(d) else np.zeros(0, np.int64)
    d, s, e = d[head], s[head], np.maximum.reduceat(e, head) if len(head) else e
    for k in np.flatnonzero((s > np.maximum(0, d)) & (a[s - 1] == b[np.maximum(s - 1 - d, 0)])).tolist():
        low = max(0, int(d[k]))
        while s[k] > low:  # a run that goes on beyond the blocks
            t = max(low, int(s[k]) - 1024)
            other = np.flatnonzero(a[t : s[k]] != b[t - d[k] : s[k] - d[k]])
            s[k] = t + int(other[-1]) + 1 if len(other) else t
            if len(other):
                break
    high = np.minimum(len(a), len(b) + d)
    for k in np.flatnonzero((e < high) & (a[np.minimum(e, len(a) - 1)] == b[np.clip(e - d, 0, len(b) - 1)])).tolist():
        while e[k] < high[k]:
            t = min(int(high[k]), int(e[k]) + 1024)
            other = np.flatnonzero(a[e[k] : t] != b[e[k] - d[k] : t - d[k]])
            e[k] = e[k] + int(other[0]) if len(other) else t
            if len(other):
                break
    long = e - s >= RUN
    return sorted(zip(s[long].tolist(), e[long].tolist(), d[long].tolist(), strict=True))


def passages_of(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """(start, end) in ``a`` and in ``b`` of the passages that two texts' words share around the seeds."""
    chains: list[list[tuple[int, int, int, int]]] = []
    for s, e, d in runs_of(a, b, pa_, pb):
        if chains:
            _, la, _, lb = chains[-1][-1]
            over = max(0, la - s, lb - (s - d)) if s - la <= GAP and -GAP <= s - d - lb <= GAP else 0
            if e - s - over >= RUN and s + over - la <= GAP and 0 <= s + over - d - lb <= GAP:
                chains[-1].append((s + over, e, s + over - d, e - d))
                continue
            if e <= la and s >= chains[-1][0][0]:  # inside what is chained already
                if e - s < least:
                    continue
        chains.append([(s, e, s - d, e - d)])
    out = []
    for chain in chains:
        if len(chain) == 1 or sum(x[1] - x[0] for x in chain) < JACCARD * least:  # a passage has more words in common
            out += [x for x in chain if x[1] - x[0] >= least]
            continue
        sa, ea, sb, eb = np.array(chain).T
        common = np.append(0, np.cumsum(ea - sa - (RUN - 1)))
        i = 0
        while i < len(chain):
            la, lb, both = ea[i:] - sa[i], eb[i:] - sb[i], common[i + 1 :] - common[i]
            like = both / (la + lb - 2 * (RUN - 1) - both)
            good = np.flatnonzero((like >= JACCARD - 1e-9) & (np.minimum(la, lb) >= least))
            if len(good):
                j = i + int(good[-1])
                out.append((int(sa[i]), int(ea[j]), int(sb[i]), int(eb[j])))
                i = j
            i += 1
    return out


def shared_passages(pairs: DataFrame, texts: DataFrame, least: int = LEAST) -> DataFrame:
    """d, h, start and end in d, from and to in h (code points) of every passage that a pair of texts (tid, text) shares."""
    rows = pairs.join(texts.select(F.col("tid").alias("d"), F.col("text").alias("dt")), "d")
    rows = rows.join(texts.select(F.col("tid").alias("h"), F.col("text").alias("ht")), "h").select("d", "h", "seeds", "dt", "ht")
    names = ["d", "h", "start", "end", "from", "to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for b in batches:
            d, h = b.column("d").to_pylist(), b.column("h").to_pylist()
            for begin, part in pieces(b.column("dt"), b.column("ht")):
                every: dict[int, str] = {}  # the texts of some pairs; those of one h come together
                for k, (x, y) in enumerate(part, begin):
                    every[d[k]], every[h[k]] = x, y
                w = Words(list(every.values()), known)
                place = dict(zip(every, zip([0, *w.stop[:-1].tolist()], w.stop.tolist(), strict=True), strict=True))
                out: list[tuple] = []
                for k in range(begin, begin + len(part)):
                    (a, z), (f, t) = place[d[k]], place[h[k]]
                    seeds = b.column("seeds")[k].values.to_numpy()
                    at = np.searchsorted(w.starts[a:z], seeds >> 32), np.searchsorted(w.starts[f:t], seeds & 0xFFFFFFFF)
                    out += [(d[k], h[k], w.starts[a + i], w.ends[a + j - 1], w.starts[f + m], w.ends[f + n - 1]) for i, j, m, n in passages_of(w.hashes[a:z], w.hashes[f:t], *at, least)]
                cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.int32()) for k, c in enumerate(cols)], names)

    return map_batches(rows, run, "d long, h long, start int, end int, from int, to int")


def repeated_passages(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What different texts share: passages (tid, start, end, keep) and links (a, b) between the texts' numbers; and the
    span of each whole text (tid, start, end).

    ``keep`` is true in the text with the smallest number of those that share a passage; elsewhere it can be removed.
    """
    every = stored(units(docs, least))
    found = collisions(every)
    collided = components(reduce(DataFrame.unionByName, found)).select(F.col("node").alias("digest"), "root")
    collided = stored(collided)
    for edges in found:
        drop_stored(edges)
    paras = every.where(F.col("kind") == PARAGRAPH).select("digest", "tid", "start", "length")
    holders = stored(paras.join(loose(collided.select("digest"), "digest"), "digest", "left_semi").groupBy("digest").agg(F.min("tid").alias("tid")))
    pairs = stored(seed_pairs(every))
    wanted = holders.select("tid").union(pairs.select("d")).union(pairs.select("h")).distinct()
    texts = docs.where("text IS NOT NULL").select(number().alias("tid"), "text").groupBy("tid").agg(F.first("text").alias("text"))
    texts = stored(texts.join(loose(wanted, "tid"), "tid", "left_semi"))
    sets = shingles_of(texts.join(loose(holders.select("tid").distinct(), "tid"), "tid", "left_semi"), least).groupBy("digest").agg(F.first("shingles").alias("shingles"))
    members = stored(collided.join(loose(sets, "digest"), "digest"))
    linked = stored(components(verified_links(members)).select(F.col("node").alias("digest"), "root"))
    drop_stored(members)
    grown = stored(shared_passages(pairs, texts, least))
    drop_stored(texts)
    drop_stored(pairs)

    ends = paras.groupBy("digest").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi"))
    known = stored(ends.join(loose(linked, "digest"), "digest", "left").where("lo < hi OR root IS NOT NULL").select("digest", "lo", "hi", F.coalesce("root", "digest").alias("cluster")))
    spread = known.groupBy("cluster").agg(F.min("lo").alias("first"), F.max("hi").alias("hi")).where("first < hi").select("cluster", "first")
    of = known.select("digest", "cluster").join(loose(spread, "cluster"), "cluster").select("digest", "first")
    lines = stored(paras.join(loose(of, "digest"), "digest").select("tid", "start", (F.col("start") + F.col("length")).alias("end"), "first"))
    passages = lines.select("tid", "start", "end", (F.col("tid") == F.col("first")).alias("keep"))
    passages = passages.unionByName(grown.select(F.col("d").alias("tid"), "start", "end", F.lit(False).alias("keep")))
    passages = passages.unionByName(grown.select(F.col("h").alias("tid"), F.col("from").alias("start"), F.col("to").alias("end"), F.lit(True).alias("keep")))
    links = lines.where("tid <> first").select(F.col("tid").alias("a"), F.col("first").alias("b")).unionByName(grown.select(F.col("d").alias("a"), F.col("h").alias("b"))).distinct()
    whole = every.where(F.col("kind") == WHOLE).select("tid", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    return passages, links, whole


def merged(spans: DataFrame) -> DataFrame:
    """tid, spans (start:end, comma-joined, in order), chars: the unions of each text's spans (tid, start, end)."""
    rows = spans.groupBy("tid", "start").agg(F.max("end").alias("end"))  # at most one for each place of a text
    w = Window.partitionBy("tid").orderBy("start")
    rows = rows.withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("n", F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(w))
    rows = rows.groupBy("tid", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    rows = rows.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"), F.sum((F.col("end") - F.col("start")).cast("long")).alias("chars"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.select("tid", text.alias("spans"), "chars")


def by_document(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """A row for each document (different text of a doc_id) that shares passages with others.

    ``class_id`` is the smallest known doc_id that is reachable over shared passages, itself included; ``spans`` and
    ``removed`` are start:end pairs (code points) of all repeated and of the removable passages.  Of documents with equal
    texts the one with the smallest doc_id keeps what its text keeps, and from the others the whole text can go.
    """
    passages, links, whole = repeated_passages(docs, least)
    passages = stored(passages.distinct())
    owners = docs.where("text IS NOT NULL").select("doc_id", number().alias("tid")).distinct()
    owners = stored(owners)
    counts = owners.groupBy("tid").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    copies = stored(counts.where("n > 1").join(loose(whole, "tid"), "tid"))  # texts of several documents
    every = merged(passages.select("tid", "start", "end").unionByName(copies.select("tid", "start", "end")))
    cut = merged(passages.where("NOT keep").select("tid", "start", "end")).select("tid", F.col("spans").alias("cut"), F.col("chars").alias("cut_chars"))
    roots = components(links).select(F.col("node").alias("tid"), "root")
    text = every.join(cut, "tid", "left").join(roots, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    text = text.join(counts.select("tid", "least"), "tid").join(copies.select("tid", F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string")).alias("copy"), (F.col("end") - F.col("start")).cast("long").alias("copy_chars")), "tid", "left")
    text = stored(text)
    classes = text.groupBy("root").agg(F.min("least").alias("class_id"))
    text = text.join(loose(classes, "root"), "root").drop("root")
    rows = owners.join(loose(text, "tid"), "tid")
    other = F.col("copy").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("least"))
    return rows.select(
        "doc_id", "class_id", "spans", F.when(other, F.col("copy")).otherwise(F.coalesce("cut", F.lit(""))).alias("removed"),
        F.col("chars").alias("repeated_chars"), F.when(other, F.col("copy_chars")).otherwise(F.coalesce("cut_chars", F.lit(0))).cast("long").alias("removed_chars"),
    )
