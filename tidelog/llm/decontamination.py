"""Benchmark decontamination: BM25 over an inverted index of test items, searched with block-max WAND.

The test items are the indexed documents and every passage of every training text is a query.  Items fall into classes by
length, each item over a ``SPREAD``-th of the longest of its class; a class has windows a little longer than its longest
item (``PASSAGE`` words at least), a quarter of a window apart, over the whole text, so that some window holds nearly all
of any item.  An item's impacts are its BM25 weights divided by its own total, so a passage that holds
all of an item's words scores 1 and one threshold serves items of any length.  All items at or above ``THRESHOLD`` are
retrieved: the sum of the terms' largest impacts rules out most passages at once, the sums of their largest impacts in
each block of items rule out most blocks of the others, and the blocks that remain go through the cursors of the
block-max WAND search.  Items that share their commonest word are kept together, which makes the blocks' bounds tight.
Every passage that retrieves an item is verified, the best score first, until one passes, in the words around it: the overlap of its question (all sentences but the
last) and of its answer (the last sentence), in runs of five words, must reach ``OVERLAP``.

Bound: an index shard has about ``SHARD_ITEMS`` items and ``SHARD_CHARS`` characters at most and is broadcast; more items
make more shards, dealt in turn, and each is searched with one more pass over the texts.

Defined cases: null texts and null or wordless items match nothing; items that repeat are each reported; a null doc_id
keeps its rows; an empty benchmark finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, stored

PASSAGE, THRESHOLD, OVERLAP, RUN, SPREAD = 32, 0.6, 0.8, 5, 4
BLOCK, SHARD_ITEMS, SHARD_CHARS, K1, B = 4, 20_000, 16_000_000, 1.2, 0.75
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of all sentences but the last, and of the last; of a single sentence, its last quarter is the answer."""
    parts = [w for s in re.split(r"(?<=[.!?])\s+", text or "") if (w := words_of(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    only = parts[0] if parts else []
    cut = len(only) - len(only) // 4
    return only[:cut], only[cut:]


def overlap(part: list[str], text: list[str], run: int = RUN) -> float:
    """The share of the runs of words in ``part`` that ``text`` has too; 1 for an empty part."""
    n = min(run, len(part))
    if not n:
        return 1.0
    have = {tuple(text[i : i + n]) for i in range(len(text) - n + 1)}
    runs = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)]
    return sum(r in have for r in runs) / len(runs)


@dataclass
class Index:
    """Postings of normalised BM25 impacts in item order, with the largest impact of each term and of its blocks."""

    item_ids: list[int | None]
    parts: list[tuple[list[str], list[str]]]
    terms: dict[str, int]
    postings: list[tuple[np.ndarray, np.ndarray]]
    most: np.ndarray
    block_at: np.ndarray
    block_no: np.ndarray
    block_most: np.ndarray
    classes: list[tuple[int, int, int]]  # first item, end and longest item of each length class

    @staticmethod
    def build(items: list[tuple[int | None, str | None]]) -> Index:
        items = [(i, t) for i, t in items if words_of(t)]
        df: dict[str, int] = {}
        for _, t in items:
            for w in set(words_of(t)):
                df[w] = df.get(w, 0) + 1
        tops: list[int] = []
        for size in sorted({len(words_of(t)) for _, t in items}, reverse=True):
            if not tops or size * SPREAD <= tops[-1]:
                tops.append(size)
        kind = lambda bag: sum(len(bag) * SPREAD <= x for x in tops)
        items.sort(key=lambda x: (kind(bag := words_of(x[1])), max(set(bag), key=lambda w: (df[w], w))))
        bags, n = [words_of(t) for _, t in items], len(items)
        kinds = np.array([kind(b) for b in bags], np.int64)
        classes = [(int(np.searchsorted(kinds, k)), int(np.searchsorted(kinds, k, "right")), x) for k, x in enumerate(tops)]
        terms = {w: k for k, w in enumerate(df)}
        idf = {w: float(np.log(1 + (n - d + 0.5) / (d + 0.5))) for w, d in df.items()}
        mean = sum(map(len, bags)) / max(n, 1)
        lists: list[list[tuple[int, float]]] = [[] for _ in terms]
        for i, bag in enumerate(bags):
            own: dict[str, int] = {}
            for w in bag:
                own[w] = own.get(w, 0) + 1
            weight = {w: idf[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(bag) / mean)) for w, c in own.items()}
            total = sum(weight.values())
            for w, x in weight.items():
                lists[terms[w]].append((i, x / total))
        postings, at, no, most = [], [0], [], []
        for p in lists:
            ids, x = np.array([i for i, _ in p], np.int64), np.array([x for _, x in p])
            postings.append((ids, x))
            first = np.flatnonzero(np.diff(ids // BLOCK, prepend=-1))
            no.append(ids[first] // BLOCK)
            most.append(np.maximum.reduceat(x, first))
            at.append(at[-1] + len(first))
        flat = lambda xs, t: np.concatenate([*xs, np.zeros(0, t)]).astype(t)
        top = np.array([x.max() for x in most])
        return Index([i for i, _ in items], [question_and_answer(t) for _, t in items], terms, postings, top, np.array(at), flat(no, np.int64), flat(most, np.float64), classes)

    def bounds(self, window: np.ndarray, query: np.ndarray, windows: int) -> np.ndarray:
        """The upper bound [window, block] for the distinct terms of each window."""
        n = self.block_at[query + 1] - self.block_at[query]
        ends = np.cumsum(n)
        at = np.repeat(self.block_at[query] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        blocks = max(1, -(-len(self.item_ids) // BLOCK))
        return np.bincount(np.repeat(window, n) * blocks + self.block_no[at], self.block_most[at], windows * blocks).reshape(windows, blocks)

    def search(self, query: np.ndarray, theta: float = THRESHOLD, bound: np.ndarray | None = None) -> list[tuple[int, float]]:
        """All (item, score) with a score of at least ``theta`` for the distinct terms of a query: block-max WAND."""
        if bound is None:
            bound = self.bounds(np.zeros(len(query), np.int64), query, 1)[0]
        end, found, eps = len(self.item_ids), [], 1e-9
        live = np.flatnonzero(bound >= theta - eps)
        if not len(live):
            return found
        cursors = [[-1, 0, int(t)] for t in query]

        def move(c: list[int], to: int) -> None:
            ids = self.postings[c[2]][0]
            c[1] = int(np.searchsorted(ids, to))
            c[0] = int(ids[c[1]]) if c[1] < len(ids) else end

        def skip(to: int) -> int:
            """The first item from ``to`` on whose block may reach the threshold."""
            k = int(np.searchsorted(live, to // BLOCK))
            return end if k == len(live) else max(to, int(live[k]) * BLOCK)

        for c in cursors:
            move(c, skip(0))
        while True:
            cursors = sorted((c for c in cursors if c[0] < end), key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += self.most[c[2]]
                if total >= theta - eps:
                    pivot = k
                    break
            if pivot < 0:
                return found
            doc = cursors[pivot][0]
            to = skip(doc)
            if to > doc:
                for c in cursors[: pivot + 1]:
                    move(c, to)
            elif cursors[0][0] == doc:
                here = [c for c in cursors if c[0] == doc]
                score = sum(float(self.postings[c[2]][1][c[1]]) for c in here)
                if score >= theta - eps:
                    found.append((doc, score))
                for c in here:
                    move(c, doc + 1)
            else:
                for c in cursors[:pivot]:
                    if c[0] < doc:
                        move(c, doc)

    def matches(self, text: str | None, theta: float = THRESHOLD) -> list[tuple[int, float, float, float]]:
        """Verified (item, best score, question overlap, answer overlap) of a whole text."""
        words = words_of(text)
        tids = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(tids >= 0)
        if not len(at):
            return []
        out = []
        for first, end, longest in self.classes:
            wide = -(-max(PASSAGE, longest + longest // 8) // 4) * 4
            for item, hits in sorted(self.hits(tids, at, wide, first, end, theta).items()):
                hits.sort(key=lambda h: (-h[0], h[1]))
                for _, start in hits:
                    near = words[max(0, start - wide) : start + 2 * wide]
                    q, a = (overlap(p, near) for p in self.parts[item])
                    if q >= OVERLAP and a >= OVERLAP or overlap([w for p in self.parts[item] for w in p], near) >= OVERLAP:
                        out.append((item, hits[0][0], q, a))
                        break
        return out

    def hits(self, tids: np.ndarray, at: np.ndarray, wide: int, first: int, end: int, theta: float) -> dict[int, list[tuple[float, int]]]:
        """(score, start) of every window that retrieves an item from ``first`` to before ``end``."""
        t, step = tids[at], wide // 4
        starts = np.arange(0, max(1, len(tids) - wide + step), step)
        lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + wide)
        run = np.concatenate([[0.0], np.cumsum(self.most[t])])
        found: dict[int, list[tuple[float, int]]] = {}
        live = np.flatnonzero(run[hi] - run[lo] >= theta - 1e-6)
        for j in range(0, len(live), 128):
            part = live[j : j + 128]
            n = hi[part] - lo[part]
            ends = np.cumsum(n)
            here = t[np.repeat(lo[part] - (ends - n), n) + np.arange(ends[-1])]
            key = np.sort(np.repeat(np.arange(len(part)) * len(self.terms), n) + here)
            key = key[np.flatnonzero(np.diff(key, prepend=-1))]
            window, query = np.divmod(key, len(self.terms))
            bound = self.bounds(window, query, len(part))
            bound[:, : first // BLOCK] = 0
            bound[:, -(-end // BLOCK) :] = 0
            for w in np.flatnonzero(bound.max(axis=1) >= theta - 1e-9).tolist():
                for item, score in self.search(query[window == w], theta, bound[w]):
                    if first <= item < end:
                        found.setdefault(item, []).append((score, int(starts[part[w]])))
        return found


def shards(benchmark: DataFrame) -> list[Index]:
    """The index of all test items, in shards of bounded size."""
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL")
    items, chars = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    n = max(1, -(-items // SHARD_ITEMS), -(-(chars or 0) // SHARD_CHARS))
    build = lambda part: Index.build(sorted(((r[0], r[1]) for r in part.collect()), key=repr))
    if n == 1:
        return [build(rows)]
    dealt = stored(rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(n))))
    return [build(dealt.where(F.col("part") == k)) for k in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified match."""
    kind = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    names = [c.split()[0] for c in kind.split(", ")]

    def with_index(index: Index) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, sent.value.item_ids[k], *rest) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True) for k, *rest in sent.value.matches(t.as_py())]
                cols = zip(*rows, strict=True) if rows else ([] for _ in names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(cols)], names)

        return map_batches(docs.select("doc_id", "text"), run, kind)

    return reduce(DataFrame.unionByName, map(with_index, shards(benchmark)))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, unchanged."""
    for index in shards(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not sent.value.matches(t.as_py()) for t in b.column("text")], pa.bool_()))

        docs = map_batches(docs, run, T.StructType(docs.schema.fields))
    return docs
