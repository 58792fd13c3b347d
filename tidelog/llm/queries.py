"""Queries over the corpus operators, with production parameters and over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, multiset_fingerprint, paragraph_minhash, pii, secrets, sentencepiece_sampling, simhash_bktree, toxicity, wrapper_induction


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every whole text: their piece ids, log probability, inclusion score, size and round trip."""
    return sentencepiece_sampling.encode(table(spark, sf_dir, "documents"))


def op2_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified test items in every whole text."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every whole text."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"] != "opaque")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), count("opaque"))


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash_bktree.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = wrapper_induction.extract(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that shares passages of 50 words or more with others: its class and its spans."""
    return paragraph_minhash.by_document(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentencepiece_sampling, op2_multiset_fingerprint, op3_decontamination, op4_pii, op5_language_id, op6_toxicity, op7_secrets, op8_simhash_bktree, op9_wrapper_induction, op10_paragraph_minhash, pipeline)
}


def _fingerprint_sql() -> str:
    """The fingerprint query from its definition, lane by lane."""
    w = " || ".join(f"format('{{:08x}}', (coalesce(list_sum(list_transform(p, lambda h: ('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)), 0) % 4294967296)::BIGINT)" for i in range(multiset_fingerprint.WORDS))
    s = " || ".join(f"format('{{:016x}}', (c[{60 * h + j + 1}] + (c[{60 * h + j + 31}] << 31))::BIGINT)" for h in (0, 1) for j in range(30))
    near = "case when {a}.w = {b}.w then 1.0 when {a}.n = 0 or {b}.n = 0 then 0.0 else least(1.0, greatest(0.0, round(coalesce({ab} / nullif(sqrt({aa}) * sqrt({bb}), 0), 0), 6))) end"
    dot = lambda x, y: f"list_sum(list_transform(range(1, 121), lambda i: (2 * {x}.c[i] - {x}.n) * (2 * {y}.c[i] - {y}.n)))::DOUBLE"
    like = lambda x, y: near.format(a=x, b=y, ab=dot(x, y), aa=dot(x, x), bb=dot(y, y))
    return f"""
    with d as (select doc_id, coalesce(text, '') as t, row_number() over (order by doc_id nulls first, md5(coalesce(text, ''))) as rn, count(*) over () as n from documents),
    e as (select a.doc_id, a.t, b.t as nt, substr(a.t, 1, (length(a.t) - length(a.t) // 2)::BIGINT) || substr(b.t, 1, (length(a.t) // 2)::BIGINT) as ed from d a join d b on b.rn = a.rn % a.n + 1),
    u as (select t, list_transform(list_filter(string_split(t, chr(10)), lambda x: x <> ''), lambda x: sha256(x) || sha256(x || chr(10))) as p,
        list_transform(list_filter(regexp_split_to_array(t, '[.!?] |\n'), lambda x: x <> ''), lambda x: md5(x)) as m from (select t from e union select ed from e)),
    b as (select t, p, len(m) as n, list_transform(m, lambda x: ('0x' || substr(x, 1, 15))::BIGINT) as a, list_transform(m, lambda x: ('0x' || substr(x, 17, 15))::BIGINT) as z from u),
    l as (select t, p, n, list_concat(list_transform(range(0, 60), lambda k: (coalesce(list_sum(list_transform(a, lambda x: (x >> k) & 1)), 0) % 1073741824)::BIGINT),
        list_transform(range(0, 60), lambda k: (coalesce(list_sum(list_transform(z, lambda x: (x >> k) & 1)), 0) % 1073741824)::BIGINT)) as c from b),
    f as (select t, n, c, {w} as w, format('{{:08x}}', n) || {s} as s from l)
    select e.doc_id, length(e.t)::BIGINT as n_chars, sha256(e.ed) as edited_sha256, x.w || x.s as fingerprint, y.w || y.s as edited_fingerprint, {like('x', 'y')} as near_edited, {like('x', 'z')} as near_next
    from e join f x on x.t = e.t join f y on y.t = e.ed join f z on z.t = e.nt"""


def _matches_sql(text: str, regex: str, drop: str = "") -> str:
    """The matches of a pattern as structs of start (code points) and m; ``drop``: what comes before a match inside it."""
    lengths = "list_sum(list_transform({x}, lambda y: length(y)))"
    start = f"coalesce({lengths.format(x='p[1:i]')}, 0) + coalesce({lengths.format(x='m[1:i-1]')}, 0)"
    one = f"{{'start': ({start})::BIGINT, 'm': m[i]}}"
    if drop:  # the pattern takes the characters beside a match with it
        one = f"{{'start': ({start} + length(regexp_extract(m[i], '^{drop}')))::BIGINT, 'm': regexp_replace(regexp_replace(m[i], '^{drop}', ''), '{drop}$', '')}}"
    return f"(select list_transform(range(1, len(m) + 1), lambda i: {one}) from (select regexp_extract_all({text}, '{regex}') as m, regexp_split_to_array({text}, '{regex}') as p))"


def _joined_sql(spans: str, kinds: tuple[str, ...]) -> str:
    return f"array_to_string(list_transform({spans}, lambda x: [{', '.join(repr(k) for k in kinds)}][x.k + 1] || ':' || x.start || ':' || x.stop), ',')"


def _pii_sql() -> str:
    """The personal data query from its definition: the contract's patterns, and those of the added kinds."""
    digits = "regexp_replace(x.m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: case when i % 2 = 1 then substr(reverse({digits}), i, 1)::INT when substr(reverse({digits}), i, 1)::INT > 4 then 2 * substr(reverse({digits}), i, 1)::INT - 9 else 2 * substr(reverse({digits}), i, 1)::INT end)) % 10 = 0"
    plain = "replace(x.m, ' ', '')"
    turned = f"(substr({plain}, 5) || substr({plain}, 1, 4))"
    mod97 = f"list_reduce(list_concat([0], list_transform(range(1, length({turned}) + 1), lambda i: case when substr({turned}, i, 1) >= 'A' then ascii(substr({turned}, i, 1)) - 55 else substr({turned}, i, 1)::INT end)), lambda a, c: (a * case when c > 9 then 100 else 10 end + c) % 97) = 1"
    edge, numeric = "[^A-Za-z0-9]", "[^0-9-]"
    kinds = {  # pattern, what may stand beside it, check
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "", "len(list_filter(string_split(x.m, '.'), lambda q: coalesce(try_cast(q as BIGINT) > 255, true))) = 0"),
        "card": ("[0-9](?:[ -]?[0-9]){13,}", "", f"length({digits}) between 14 and 19 and {luhn}"),
        "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "", f"length({digits}) between 10 and 15"),
        "iban": (f"(?:^|{edge})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?)(?:{edge}|$)", edge, f"length({plain}) between 15 and 34 and {mod97}"),
        "ssn": (f"(?:^|{numeric})[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?:{numeric}|$)", numeric, "true"),
    }
    lists = []
    for k, (name, (regex, drop, check)) in enumerate(kinds.items()):
        near = f"regexp_matches(lower(substr(t, greatest(x.start - {pii.NEAR}, 0) + 1, least(x.start, {pii.NEAR}))), '(^|[^a-z])({pii.CONTEXT[name]})')"
        made = f"list_transform(list_filter({_matches_sql('t', regex, drop)}, lambda x: {check}), lambda x: {{'start': x.start, 'k': {k}, 'stop': x.start + length(x.m), 'score': {50 + pii.CHECKED[name]} + case when {near} then 20 else 0 end}})"
        lists.append(made if k < 4 else f"list_filter({made}, lambda x: x.score >= {pii.LEAST})")
    counts = ", ".join(f"len(list_filter(f, lambda x: x.k = {k}))::BIGINT as n_{name}" for k, name in enumerate(list(kinds)[:4]))
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), s as (select doc_id, list_sort(list_concat({', '.join(lists)})) as f from d)
    select doc_id, {counts}, sha256({_joined_sql('list_filter(f, lambda x: x.k < 4)', pii.KINDS)}) as base_sha256, {_joined_sql('f', pii.KINDS)} as spans, array_to_string(list_transform(f, lambda x: x.score), ',') as scores from s"""


def _secrets_sql() -> str:
    """The secrets query from the contract's patterns.  Byte-pair encoding has no SQL: this holds for tables where the
    token-efficiency test adds no span, as it doesn't on the given ones; tests hold that against every run of the tables."""
    group = r"""(?i:password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)"""
    kinds = ((group, f"length(regexp_extract(x.m, '{group}', 1)) >= 6"), ("AKIA[A-Z0-9]+", "length(x.m) >= 20"), ("[0-9a-f]{24,}", "true"))
    lists = [f"list_transform(list_filter({_matches_sql('t', regex)}, lambda x: {check}), lambda x: {{'start': x.start, 'k': {k}, 'stop': x.start + length(x.m)}})" for k, (regex, check) in enumerate(kinds)]
    counts = ", ".join(f"len(list_filter(f, lambda x: x.k = {k}))::BIGINT as n_{name}" for k, name in enumerate(secrets.KINDS[:3]))
    spans = _joined_sql("f", secrets.KINDS)
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), s as (select doc_id, list_sort(list_concat({', '.join(lists)})) as f from d)
    select doc_id, {counts}, sha256({spans}) as base_sha256, {spans} as spans, 0::BIGINT as n_opaque from s"""


def _pages_sql() -> str:
    """The main text of pages whose article is one article element with simple markup, as in the given tables."""
    inner = "regexp_extract(coalesce(html, ''), '<article>(.*?)(?:</article>|$)', 1, 's')"
    blocks = f"regexp_replace(regexp_replace({inner}, '</?b>', '', 'g'), '</?(?:p|h1|br)>', ' ', 'g')"
    decoded = f"replace(replace(replace(replace({blocks}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    return f"select page_id, url, x as text, length(x)::BIGINT as n_chars from (select page_id, url, trim(regexp_replace({decoded}, '\\s+', ' ', 'g')) as x from pages)"


ORACLES: dict[str, str] = {"op2_multiset_fingerprint": _fingerprint_sql(), "op4_pii": _pii_sql(), "op7_secrets": _secrets_sql(), "op9_wrapper_induction": _pages_sql()}
