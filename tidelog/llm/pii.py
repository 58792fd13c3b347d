"""Personal data in texts: regular expressions propose spans, checksums confirm them, context words adjust the score.

In DataFrame and SQL expressions only.  A pattern's matches and the pieces that it splits the text into give the
positions (code points) of its matches.  Kinds, in the order of their listing:

* ``email``, ``ip`` (four parts of at most 255), ``card`` (14 to 19 digits that pass the Luhn test) and ``phone``
  (10 to 15 digits): the base spans, leftmost and non-overlapping per kind; a failing match is dropped, with no retry;
* ``iban``: two capitals, two digits and 11 to 30 more, together or in fours, whose number is 1 modulo 97;
* ``ssn``: nine digits as 3-2-4 without a checksum, so only with a context word nearby.

Score, in hundredths: 50 for the pattern, 30 for a checksum or a checked structure, 20 for a context word of the kind
within ``NEAR`` code points before the span; added kinds stay from ``LEAST`` on, base spans always.

The patterns are written so that matching is linear: possessive runs, and starts only where a run can start.

Defined cases: a null text counts as empty; a null doc_id keeps its row; repeated rows repeat; texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR, LEAST, CHUNK = 40, 70, 1000
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

# Patterns of the proposals.  A start inside a run of the local part can only succeed where the run's start does, or
# after an earlier match; digit runs likewise, and a card's run must be maximal.
PATTERNS = {
    "email": r"(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:[.][0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"[+][0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# What a text must contain for the pattern to be tried at all.
NEEDS = {"email": "instr(t, '@') > 0", "ip": "t rlike '[0-9][.][0-9]'", "card": "t rlike '[0-9](?:[ -]?[0-9]){13}'", "phone": "instr(t, '+') > 0", "iban": "t rlike '[A-Z]{2}[0-9]{2}'", "ssn": "t rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'"}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "tel|phone|call|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta|transfer",
    "ssn": "ssn|social security|tax id",
}
LUHN = """pmod(aggregate(transform(split(reverse(regexp_replace(m, '[ -]', '')), ''), (d, i) ->
    case when d = '' then 0 when i % 2 = 0 then cast(d as int) when cast(d as int) > 4 then 2 * cast(d as int) - 9 else 2 * cast(d as int) end), 0, (a, d) -> a + d), 10) = 0"""
MOD97 = """aggregate(split(concat(substr(regexp_replace(m, ' ', ''), 5), substr(m, 1, 4)), ''), 0, (a, d) ->
    case when d = '' then a when d >= 'A' then (a * 100 + ascii(d) - 55) % 97 else (a * 10 + cast(d as int)) % 97 end) = 1"""
CHECKS = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), x -> length(ltrim('0', x)) <= 3 and cast(concat('0', right(x, 3)) as int) <= 255)",
    "card": f"length(regexp_replace(m, '[ -]', '')) between 14 and 19 and {LUHN}",
    "phone": "length(regexp_replace(m, '[^0-9]', '')) between 10 and 15",
    "iban": f"length(regexp_replace(m, ' ', '')) between 15 and 34 and {MOD97}",
    "ssn": "true",
}
CHECKED = {"email": 0, "ip": 30, "card": 30, "phone": 0, "iban": 30, "ssn": 0}
SPAN = "array<struct<start:int,k:int,end:int,score:int>>"


def starts_of(found: str, pieces: str) -> str:
    """SQL for the start of each match, from the matches and the pieces between them.

    Prefix sums in two steps, over runs of about as many lengths as there are runs: n matches take n ** 1.5 steps, and no
    array grows by more than one element a run.
    """
    lengths = "zip_with(f, slice(p, 1, size(f)), (m, q) -> length(m) + length(q))"
    total = "aggregate(slice(b.l, {at}, {n}), 0, (a, y) -> a + y)"
    runs = f"aggregate(sequence(0, cast((size(b.l) - 1) div b.c as int)), array(0), (a, i) -> concat(a, array(element_at(a, -1) + {total.format(at='i * b.c + 1', n='b.c')})))"
    run = "cast(k div b.c as int)"
    before = f"transform(b.l, (x, k) -> o[{run}] + {total.format(at=f'{run} * b.c + 1', n='k % b.c')})"
    summed = f"transform(array(named_struct('l', {lengths}, 'c', cast(ceil(sqrt(size(f))) as int))), b -> transform(array({runs}), o -> {before})[0])[0]"
    return f"transform(array({found}), f -> transform(array({pieces}), p -> zip_with({summed}, slice(p, 1, size(f)), (s, q) -> s + length(q)))[0])[0]"


def spans_of(kind: str) -> str:
    """SQL for the confirmed spans of one kind in the text ``t``: start, kind number, end, score."""
    regex, k = PATTERNS[kind], KINDS.index(kind)
    found = f"regexp_extract_all(t, '{regex}', 0)"
    placed = f"zip_with({found}, {starts_of(found, f"split(t, '{regex}', -1)")}, (m, s) -> named_struct('m', m, 'start', s))"
    kept = f"filter({placed}, x -> transform(array(x.m), m -> {CHECKS[kind]})[0])"
    at = f"greatest(x.start - {NEAR}, 0)"  # the context begins there; it is taken from two chunks, as a place in a text is only found by counting
    near = f"substr(concat(c[{at} div {CHUNK}], coalesce(try_element_at(c, cast({at} div {CHUNK} + 2 as int)), '')), cast({at} % {CHUNK} + 1 as int), least(x.start, {NEAR}))"
    context = f"lower({near}) rlike '(^|[^a-z])({CONTEXT[kind]})'"
    scored = f"transform({kept}, x -> named_struct('start', x.start, 'k', {k}, 'end', x.start + length(x.m), 'score', {50 + CHECKED[kind]} + if({context}, 20, 0)))"
    scored = f"transform(array(regexp_extract_all(t, '(?s).{{1,{CHUNK}}}', 0)), c -> {scored})[0]"
    if k > 3:
        scored = f"filter({scored}, x -> x.score >= {LEAST})"
    return f"case when {NEEDS[kind]} and size({found}) > 0 then {scored} else cast(array() as {SPAN}) end"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: the spans (start, k: kind number, end, score) of all kinds, by start and kind."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    every = ", ".join(spans_of(k) for k in KINDS)
    return rows.select("doc_id", F.expr(f"array_sort(concat({every}))").alias("found"))


def joined(found: str) -> str:
    """SQL for kind:start:end of spans, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({found}, x -> concat(element_at(array({names}), x.k + 1), ':', x.start, ':', x.end)), ',')"


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (hundredths, in the order of spans)."""
    counts = [F.expr(f"cast(size(filter(found, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    base = joined("filter(found, x -> x.k < 4)")
    return scan(docs).select("doc_id", *counts, F.expr(f"sha2({base}, 256)").alias("base_sha256"), F.expr(joined("found")).alias("spans"), F.expr("array_join(transform(found, x -> cast(x.score as string)), ',')").alias("scores"))
