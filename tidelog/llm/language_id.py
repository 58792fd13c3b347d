"""Language identification with interpolated Kneser-Ney character models.

Text is lower-cased letter by letter, runs of other characters become one space, and a character is kept as 16 bits, so
a 4-gram is a 64-bit key.  4-gram counts of all labelled documents are summed on the cluster; the lower orders follow
from them as continuation counts.  Each order is one sorted array of keys with a matrix of log probabilities, one column
for each language, in which the interpolation is already worked out; looking a character up is a binary search.
The language with the lowest cross-entropy a character wins.

Rejection is calibrated on one in ``HELD_BACK`` labelled texts, picked by a hash of the text: models of all the other
texts score them, and the ``QUANTILE`` of their cross-entropies times ``SLACK``, for each predicted language, is its
threshold.  (The models that predict learn from all labelled texts, so no language is lost to calibration.)  A text whose
best cross-entropy is above its language's threshold is rejected, and so is a text without letters (``und``).

All counts are kept.  Where the matrices would pass ``SHARD_CELLS`` numbers, they are built and searched in shards by a
4-gram's third character: the higher orders of a character's probability and their continuation counts all lie in one
shard, the first order is counted over all of them.  Texts are scored with each shard in turn and the sums added.
Bound: a shard has at least all 4-grams of one third character.

Defined cases: null, empty and letterless texts get ``und``, score 0 and are rejected; documents without a label or
text teach nothing; without any labelled document everything is ``und``; a null doc_id is not held out and is not
learned from; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, stored

ORDER, SHARD_CELLS, DISCOUNT = 4, 8_000_000, 0.75
HELD_BACK, QUANTILE, SLACK = 16, 0.999, 1.5
PIECE = 1 << 20
_U = np.uint64
_tables: list[np.ndarray] = []


def letters() -> np.ndarray:
    """code point -> its lower-case letter in 16 bits, or a space."""
    if not _tables:
        out = np.full(0x110000, 32, np.uint16)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                n = ord(low) if len(low) == 1 else i
                out[i] = n if n < 0xE000 else 0xE000 + n % 6400
        _tables.append(out)
    return _tables[0]


def codes(text: str) -> np.ndarray:
    return letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def kept(cp: np.ndarray) -> np.ndarray:
    """Which characters stay: of a run of spaces the first."""
    keep = np.ones(len(cp), bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
    return keep


def context_of(text: str, at: int) -> int:
    """From where on the text before ``at`` has all the characters that a 4-gram at ``at`` can need."""
    start, step = at, 64
    while start and kept(codes(text[start:at])).sum() <= ORDER:
        start, step = max(0, start - step), 4 * step
    return start


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of (text number, 4-gram key of each kept character); characters before a text count as spaces.

    Long texts go in pieces; a piece has the characters before it as context, which count and score with their own piece.
    """

    def cut(part: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray]:
        cp = codes("\n".join(["", *(t for _, t, _ in part)]))
        size = np.array([len(t) + 1 for _, t, _ in part])
        own = np.repeat([i for i, _, _ in part], size)
        old = np.arange(len(cp)) - np.repeat(np.cumsum(size) - size, size) <= np.repeat([n for _, _, n in part], size)
        keep = kept(cp)
        cp, own, old = cp[keep], own[keep], old[keep]
        key, n = cp.astype(_U), len(cp)
        for k in range(1, ORDER):
            before = np.full(n, 32, _U)
            if n > k:
                before[k:] = np.where(own[k:] == own[:-k], cp[:-k], 32)
            key |= before << _U(16 * k)
        return own[~old], key[~old]

    part, size = [], 0
    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t)), PIECE):
            start = context_of(t, k)
            part.append((i, t[start : k + PIECE], k - start))
            size += len(part[-1][1])
            if size >= PIECE:
                yield cut(part)
                part, size = [], 0
    if part:
        yield cut(part)


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, key, n, back: how often each 4-gram occurs in the texts of each language, and in those held back of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, back), parts in held.items():
                k, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(k), np.int32))), pa.array(k.view(np.int64)), pa.array(n), pa.array(n * back)], ["lang", "key", "n", "back"])
            held.clear()

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([p[0] for p in parts])
            uniq, inv = np.unique(keys, return_inverse=True)
            return uniq, np.bincount(inv, np.concatenate([p[1] for p in parts]), len(uniq)).astype(np.int64)

        for b in batches:
            by: dict[tuple[str, bool], list[str]] = {}
            for lang, back, text in zip(b.column("lang").to_pylist(), b.column("back").to_pylist(), b.column("text"), strict=True):
                by.setdefault((lang, back), []).append(text.as_py())
            for group, texts in by.items():
                for _, key in grams(texts):
                    key = np.sort(key)
                    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                    held.setdefault(group, []).append((key[at], np.diff(np.append(at, len(key)))))
                if len(held.get(group, [])) > 16:
                    held[group] = [merged(held[group])]
            if sum(len(p[0]) for parts in held.values() for p in parts) > 3_000_000:
                yield from flush()
        yield from flush()

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", held_back().alias("back"))
    part = map_batches(rows, run, "lang string, key long, n long, back long")
    return part.groupBy("lang", "key").agg(F.sum("n").alias("n"), F.sum("back").alias("back"))


def held_back() -> F.Column:
    """Whether a labelled text serves to calibrate the thresholds."""
    return F.pmod(F.xxhash64(F.lit(11), F.col("text")), F.lit(HELD_BACK)) == 0


@dataclass
class Models:
    """Interpolated Kneser-Ney models of all languages: for each order sorted keys and log probabilities, and the log
    weights that contexts give to the next lower order."""

    langs: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    base: np.ndarray
    thresholds: np.ndarray
    range: tuple[int, int] = (0, 1 << 16)  # the third characters of the 4-grams it scores

    def score(self, key: np.ndarray) -> np.ndarray:
        """Log probability [character, language] of the last character of each 4-gram."""
        out = np.empty((len(key), len(self.langs)), np.float32)
        left, carry = np.arange(len(key)), None
        for n in range(ORDER, 0, -1):
            part = key[left] & _U((1 << (16 * n)) - 1)
            at, hit = find(self.keys[n - 1], part)
            value = self.logp[n - 1][at[hit]]
            out[left[hit]] = value if carry is None else value + carry[hit]
            left, part = left[~hit], part[~hit]
            carry = np.zeros((len(left), len(self.langs)), np.float32) if carry is None else carry[~hit]
            if not len(left):
                return out
            if n > 1:
                at, hit = find(self.contexts[n - 1], part >> _U(16))
                carry = carry + np.where(hit[:, None], self.weights[n - 1][at], 0)
        out[left] = carry + self.base
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed negative log probabilities [text, language], and the number of characters that are letters."""
        total, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for own, key in grams(texts):
            if self.range != (0, 1 << 16):
                third = (key >> _U(16)) & _U(0xFFFF)
                here = (third >= self.range[0]) & (third < self.range[1])
                own, key = own[here], key[here]
            if not len(own):
                continue
            at = np.flatnonzero(np.diff(own, prepend=-1))
            total[own[at]] -= np.add.reduceat(self.score(key), at, axis=0, dtype=np.float64)
            size[own[at]] += np.add.reduceat(((key & _U(0xFFFF)) != 32).astype(np.int64), at)
        return total, size


@dataclass
class Shards:
    """Models of too many 4-grams for one: a broadcast model for each range of third characters."""

    langs: list[str]
    parts: list[Broadcast]
    thresholds: np.ndarray


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]], first: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> Models:
    """Models from the 4-gram counts (keys, counts) of each language; those of a shard also need the first order's
    continuation counts over all shards."""
    langs = sorted(counts)
    sums: list[list] = []
    for lang in langs:
        keys, n = counts[lang]
        orders = []
        for k in range(ORDER, 0, -1):
            orders.append((keys, n.astype(np.float64)))
            keys, n = np.unique(keys & _U((1 << (16 * (k - 1))) - 1), return_counts=True)  # continuation counts
        if first is not None:
            orders[-1] = (first[lang][0], first[lang][1].astype(np.float64))
        sums.append(orders[::-1])
    union = [np.unique(np.concatenate([s[k][0] for s in sums])) for k in range(ORDER)]
    above = [np.unique(u >> _U(16)) for u in union]
    size = len(union[0]) + 1
    logp = [np.zeros((len(u), len(langs))) for u in union]
    weights = [np.zeros((len(c), len(langs))) for c in above]
    base = np.full(len(langs), -np.log(size))
    for j, s in enumerate(sums):
        for k in range(ORDER):
            keys, n = s[k]
            ctx = keys >> _U(16)
            at = np.searchsorted(above[k], ctx)
            total = np.bincount(at, n, len(above[k]))
            kinds = np.bincount(at, minlength=len(above[k]))
            lam = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            own = np.zeros(len(union[k]))
            own[np.searchsorted(union[k], keys)] = n - DISCOUNT
            ctx_all = np.searchsorted(above[k], union[k] >> _U(16))
            if k:
                lower = np.searchsorted(union[k - 1], union[k] & _U((1 << (16 * k)) - 1))
                below = np.exp(logp[k - 1][lower, j])
            else:
                below = 1.0 / size
            logp[k][:, j] = np.log(own / np.maximum(total[ctx_all], 1) + lam[ctx_all] * below)
            weights[k][:, j] = np.log(lam)
    if ORDER and len(langs):
        base = base + weights[0][0] if len(weights[0]) else base
    return Models(langs, union, [x.astype(np.float32) for x in logp], above, [x.astype(np.float32) for x in weights], base.astype(np.float32), np.full(len(langs), np.inf))


def by_language(got: pa.Table, langs: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The sorted keys and counts of each language of a table (lang, key, n)."""
    out = {}
    for lang in langs:
        own = got.filter(pc.equal(got["lang"], lang))
        key = own["key"].to_numpy().view(_U)
        order = np.argsort(key)
        out[lang] = (key[order], own["n"].to_numpy()[order])
    return out


def learned(table: DataFrame) -> Models | Shards | None:
    """The models of 4-gram counts (lang, key, n, third), without thresholds."""
    rows = {r["lang"]: r["n"] for r in table.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(rows)
    if not langs:
        return None
    if sum(rows.values()) * len(langs) <= SHARD_CELLS:
        return kneser_ney(by_language(table.select("lang", "key", "n").toArrow(), langs))
    sizes = {r["third"]: r["n"] for r in table.select("third", "key").distinct().groupBy("third").agg(F.count("*").alias("n")).collect()}
    ends, size = [0], 0
    for c in sorted(sizes):
        if size and (size + sizes[c]) * len(langs) > SHARD_CELLS:
            ends.append(c)
            size = 0
        size += sizes[c]
    ends.append(1 << 16)
    pairs = table.select("lang", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pair")).distinct()
    first = by_language(pairs.groupBy("lang", F.col("pair").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(F.count("*").alias("n")).toArrow(), langs)
    parts = []
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        got = table.where((F.col("third") >= lo) & (F.col("third") < hi)).select("lang", "key", "n").toArrow()
        models = kneser_ney(by_language(got, langs), first)
        models.range = (lo, hi)
        parts.append(table.sparkSession.sparkContext.broadcast(models))
    return Shards(langs, parts, np.full(len(langs), np.inf))


def train(docs: DataFrame) -> Models | Shards | None:
    """Models from all rows of ``docs`` (text, lang); None where nothing is labelled."""
    third = F.shiftright("key", 16).bitwiseAND(F.lit(0xFFFF)).cast("int")
    table = stored(count_grams(docs).withColumn("third", third).sortWithinPartitions("third"))
    models = learned(table.drop("back"))
    if models is None:
        return None
    judges = learned(table.withColumn("n", F.col("n") - F.col("back")).where("n > 0").drop("back"))
    sample = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(held_back()).select(F.lit(None).cast("long").alias("doc_id"), "text")
    seen = scored(sample, judges).where("lang_pred <> 'und'").groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", QUANTILE, 10_000).alias("x")).collect()
    top = {r["lang_pred"]: SLACK * r["x"] for r in seen}
    models.thresholds = np.array([top.get(x, max(top.values(), default=np.inf)) for x in models.langs])
    return models


def decide(models: Models | None, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy a character and rejection of each text."""
    n = len(texts)
    if models is None:
        return ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
    return verdict(models.langs, models.thresholds, *models.entropies(texts))


def verdict(langs: list[str], thresholds: np.ndarray, total: np.ndarray, size: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    each = total / np.maximum(size, 1)[:, None]
    best = each.argmin(axis=1)
    score = 1 / np.exp(-(total - total.min(axis=1, keepdims=True)) / 4).sum(axis=1)
    low = each[np.arange(len(size)), best]
    empty = size == 0
    rejected = empty | (low > thresholds[best])
    return ["und" if e else langs[k] for e, k in zip(empty, best, strict=True)], np.where(empty, 0, score), np.where(empty, 0, low), rejected


FOUND = "lang_pred string, score double, cross_entropy double, rejected boolean"


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, stored, with a number for each row, and that column's name."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id())), name


def in_turn(docs: DataFrame, row: str, models: Shards) -> DataFrame:
    """The row's number and verdict of every row: the sums of all shards, each searched by tasks of its own."""
    names = [f"t{k}" for k in range(len(models.langs))]

    def with_part(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                total, size = sent.value.entropies([t.as_py() or "" for t in b.column("text")])
                yield pa.RecordBatch.from_arrays([b.column(row), pa.array(size), *map(pa.array, total.T.copy())], [row, "size", *names])

        return map_batches(docs.select(row, "text"), run, ", ".join([f"{row} long, size long", *(f"{x} double" for x in names)]))

    sums = reduce(DataFrame.unionByName, map(with_part, models.parts)).groupBy(row).agg(*(F.sum(x).alias(x) for x in ["size", *names]))
    langs, thresholds = models.langs, models.thresholds

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = np.stack([b.column(x).to_numpy() for x in names], 1)
            lang, score, low, rejected = verdict(langs, thresholds, total, b.column("size").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(row), pa.array(lang, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], [row, "lang_pred", "score", "cross_entropy", "rejected"])

    return map_batches(sums, judge, f"{row} long, {FOUND}")


def scored(docs: DataFrame, models: Models | Shards | None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected of every row."""
    if isinstance(models, Shards):
        rows, row = numbered(docs.select("doc_id", "text"))
        return rows.select("doc_id", row).join(in_turn(rows, row, models), row).drop(row)
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, low, rejected = decide(sent.value, [t.as_py() or "" for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id long, {FOUND}")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the labelled documents that are not held out, predicts all: doc_id, held_out, lang_pred, score, cross_entropy, rejected."""
    models = train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    return scored(docs, models).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, unchanged; learns from all their labels.  Without any label all rows stay."""
    models = train(docs)
    if models is None:
        return docs
    if isinstance(models, Shards):
        rows, row = numbered(docs)
        return rows.join(in_turn(rows, row, models).where("rejected").select(row), row, "left_anti").select(*docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rejected = decide(sent.value, [t.as_py() or "" for t in b.column("text")])[3]
            yield b.filter(pa.array(~rejected))

    return map_batches(docs, run, T.StructType(docs.schema.fields))
