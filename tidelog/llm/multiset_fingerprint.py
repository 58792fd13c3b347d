"""Document fingerprints: a homomorphic multiset hash, in DataFrame and SQL expressions only.

A document is the multiset of its paragraphs (lines that are not empty).  Every paragraph hashes to a wide vector, and a
fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo powers of two; so it does not depend on their
order, and a paragraph is inserted or deleted by adding or subtracting its vector.  The vector has

* 16 lanes modulo 2**32, the words of the paragraph's SHA-256, bare and with a line end: two documents with equal lanes are equal as multisets;
* a count of the paragraph's sentences, and 120 lanes that each add one bit of every sentence's MD5, all modulo 2**30,
  which no text of Spark (under 2**31 bytes) can have as sentences.  Counted against half the sentences these lanes are a random-sign sketch of the
  multiset of sentences, and the cosine of two sketches estimates how alike two documents are.

Two 30-bit lanes share a long, with a guard bit above each, so that adding and masking one long adds two lanes.  The
fingerprint's text is the lanes in hex.

Defined cases: a null text counts as empty; the empty multiset is all zeros and is fully like itself only; rows are in
the order of doc_id (nulls first) and, where it is equal, of the text's MD5; repeated rows keep their number; the next
document of the last row is the first row, of a single row itself; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

WORDS, SUMS, LANE = 16, 60, 31
ONES = 1 | 1 << LANE
ONE = (1 << (LANE - 1)) - 1
KEEP = ONES * ONE
HASH = 1 << 60  # a text's place among the rows of its doc_id is one of so many


def parts(text: str) -> str:
    """SQL for a fingerprint as a struct: w (32-bit lanes), n (sentences), s (packed lanes)."""
    words = ", ".join(f"(acc[{i}] + cast(conv(substr(h, {8 * i + 1}, 8), 16, 10) as bigint)) & 4294967295L" for i in range(WORDS))
    w = f"aggregate(transform(filter(split({text}, '\\n', -1), p -> p <> ''), p -> concat(sha2(p, 256), sha2(concat(p, '\\n'), 256))), array_repeat(0L, {WORDS}), (acc, h) -> array({words}))"
    half = SUMS // 2
    sums = ", ".join(f"(acc[{j}] + (shiftright(h.{'a' if j < half else 'b'}, {j % half}) & {ONES}L)) & {KEEP}L" for j in range(SUMS))
    units = f"transform(filter(split({text}, '[.!?] |\\n', -1), u -> u <> ''), u -> md5(u))"
    spread = lambda x: f"transform(array(cast(conv({x}, 16, 10) as bigint)), x -> (x & {(1 << half) - 1}L) | shiftleft(shiftright(x, {half}), {LANE}))[0]"  # noqa: E731  60 bits, 30 to a lane
    longs = f"transform({units}, m -> named_struct('a', {spread('substr(m, 1, 15)')}, 'b', {spread('substr(m, 17, 15)')}))"
    s = f"aggregate({longs}, array_repeat(0L, {SUMS}), (acc, h) -> array({sums}))"
    return f"named_struct('w', {w}, 'n', cast(size({units}) as bigint), 's', {s})"


def combined(a: str, b: str, sign: int = 1) -> str:
    """SQL for the fingerprint of the union (sign 1) or difference (sign -1) of two multisets, from their fingerprints."""
    lane = {1: f"(x + y) & {KEEP}L", -1: f"(x + {KEEP + ONES}L - y) & {KEEP}L"}[sign]
    op = "+" if sign > 0 else "-"
    return f"named_struct('w', zip_with({a}.w, {b}.w, (x, y) -> (x {op} y) & 4294967295L), 'n', ({a}.n {op} {b}.n) & {ONE}L, 's', zip_with({a}.s, {b}.s, (x, y) -> {lane}))"


def as_text(fp: str) -> str:
    return f"concat(array_join(transform({fp}.w, x -> lower(lpad(hex(x), 8, '0'))), ''), lower(lpad(hex({fp}.n), 8, '0')), array_join(transform({fp}.s, x -> lower(lpad(hex(x), 16, '0'))), ''))"


def likeness(a: str, b: str) -> str:
    """SQL for the likeness of two fingerprints, 0 to 1: 1 where all lanes are equal, or else the cosine of the sketches."""

    def lanes(f: str) -> str:
        return f"transform(flatten(transform({f}.s, x -> array(x & {ONE}L, shiftright(x, {LANE}) & {ONE}L))), x -> 2 * x - {f}.n)"

    def dot(x: str, y: str) -> str:
        return f"cast(aggregate(zip_with({lanes(x)}, {lanes(y)}, (p, q) -> p * q), 0L, (t, p) -> t + p) as double)"

    return f"case when {a}.w = {b}.w then 1.0D when {a}.n = 0 or {b}.n = 0 then 0.0D else least(1.0D, greatest(0.0D, round(coalesce({dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0.0D), 0.0D), 6))) end"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).select("doc_id", F.expr(parts("_text")).alias("_f"))
    return rows.select("doc_id", F.expr(as_text("_f")).alias("fingerprint"))


def literal(numbers: list[int]) -> str:
    """SQL for an array of any number of longs that is folded to a constant."""
    return f"cast(split('{','.join(map(str, numbers))}', ',', -1) as array<bigint>)" if numbers else "cast(array() as array<bigint>)"


class Buckets:
    """Consecutive ranges of (doc_id, hash of text), nulls first, that hold about as many rows each.

    ``marks`` are quantiles of doc_id.  A doc_id that is several quantiles, and the null, holds as many buckets' rows; its
    rows are dealt to buckets of their own by ranges of their hash.
    """

    def __init__(self, marks: list[int], nulls: int):
        self.ids = sorted(set(marks))
        times = [marks.count(x) for x in self.ids] if len(self.ids) < len(marks) else [1] * len(marks)
        self.slices = [n if n > 1 else 0 for n in times]
        self.nulls = max(1, nulls)
        # buckets: the nulls' slices, what is below the first mark, then for each mark its slices and the rest above it
        self.first = [*accumulate((n + 1 for n in self.slices), initial=self.nulls + 1)][:-1]

    def column(self) -> Column:
        """The number of the bucket of a row with ``doc_id`` and ``h``; marks are found in two short searches."""
        wide = max(1, isqrt(len(self.ids)))
        coarse = f"size(filter({literal(self.ids[::wide])}, b -> b <= doc_id))"
        fine = f"size(filter(slice({literal(self.ids)}, 1 + {wide} * (c - 1), {wide}), b -> b <= doc_id))"
        mark = f"transform(array({coarse}), c -> if(c = 0, 0, {wide} * (c - 1) + {fine}))[0]"
        of = lambda xs: f"element_at({literal(xs)}, i)"
        part = lambda n: f"greatest(0L, least({n} - 1, cast(floor(h / {float(HASH)}D * {n}) as bigint)))"
        slices = of(self.slices) if any(self.slices) else "0L"
        place = f"{of(self.first)} + if({of(self.ids)} = doc_id, {part(slices)}, {slices})" if any(self.slices) else of(self.first)
        known = f"transform(array({mark}), i -> if(i = 0, {self.nulls}L, {place}))[0]" if self.ids else f"{self.nulls}L"
        return F.expr(f"cast(if(doc_id is null, {part(f'{self.nulls}L')}, {known}) as bigint)")


def with_next(rows: DataFrame, value: Column, buckets: int | None = None) -> DataFrame:
    """``rows`` (doc_id, text, ...) with ``next``: ``value`` of the row that follows in the order of doc_id and text's hash.

    Rows are dealt to buckets of consecutive rows, several for each shuffle partition, and only sorted inside them; the
    first rows of a bucket are copied to the end of the bucket before it (those of the first to the last), so that every
    row's follower is at hand.
    """
    n = buckets or 4 * partitions(rows.sparkSession)
    rows = rows.withColumn("h", F.expr("cast(conv(substr(md5(text), 1, 15), 16, 10) as bigint)"))
    got = rows.agg(F.percentile_approx("doc_id", [(i + 1) / (n + 1) for i in range(n)], 10 * n), F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    dealt = Buckets(got[0] or [], round(n * got[1] / max(1, got[2])))
    rows = rows.withColumn("b", dealt.column())
    firsts = sorted(((r["b"], r["f"]["doc_id"], r["f"]["h"]) for r in rows.groupBy("b").agg(F.min(F.struct("doc_id", "h")).alias("f")).collect()), key=lambda r: r[0])
    # by bucket: the id and hash of its first row, and the bucket before it
    size = max((b for b, _, _ in firsts), default=0) + 1
    ids, hashes, before = [0] * size, [-1] * size, [0] * size
    for k, (b, i, h) in enumerate(firsts):
        ids[b], hashes[b], before[b] = i or 0, h, firsts[k - 1][0]
    at = lambda xs: f"element_at({literal(xs)}, cast(b + 1 as int))"
    ghost = f"if({at(hashes)} = h and (doc_id is null or {at(ids)} = doc_id), {at(before)}, null)"
    places = f"filter(array(named_struct('b', b, 'g', 0), if(({ghost}) is null, null, named_struct('b', {ghost}, 'g', 1))), x -> x is not null)"
    spread = rows.withColumn("_p", F.explode(F.expr(places))).drop("b")
    w = Window.partitionBy("_p.b").orderBy("_p.g", F.col("doc_id").asc_nulls_first(), "h")
    return spread.withColumn("next", F.lead(value).over(w)).where("_p.g = 0").drop("_p", "h")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text replaces the last half of a text's code points by the first as many of the next row's text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("f", F.expr(parts("text")))
    rows = with_next(rows, F.struct("text", F.struct("f.w", "f.n", "f.s").alias("f")))
    rows = rows.withColumn("n", F.length("text").cast("bigint"))
    rows = rows.withColumn("edited", F.expr("concat(substr(text, 1, cast(n - n div 2 as int)), substr(next.text, 1, cast(n div 2 as int)))"))
    rows = rows.select("doc_id", "n", "f", F.col("next.f").alias("g"), "edited")
    rows = rows.withColumn("e", F.expr(parts("edited")))
    return rows.select(
        "doc_id", F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.expr(as_text("f")).alias("fingerprint"), F.expr(as_text("e")).alias("edited_fingerprint"), F.expr(likeness("f", "e")).alias("near_edited"), F.expr(likeness("f", "g")).alias("near_next")
    )

