"""Secret scans: assignments, access keys and hex strings by pattern, other random strings by token efficiency.

Base spans (leftmost, non-overlapping per kind): ``assign`` ``(password|passwd|secret|token|api_?key)["']? *[:=] *["']?(value)``
with a value of 6 or more characters, letters of the names in either case; ``access`` ``AKIA`` and capitals or digits,
20 or more characters; ``hex`` runs of 24 or more lower-case hex digits.

The method adds spans of kind ``opaque``: runs of ``MIN_RUN`` or more characters of ``A-Z a-z 0-9 + / = _ -`` with
letters that are no known digest (hex of 32, 40, 56, 64, 96 or 128 digits), UUID or identifier of words, and need so many
tokens of a byte-level BPE vocabulary that a token covers fewer than ``CHARS_PER_TOKEN`` characters on average
(``LETTERS_PER_TOKEN`` in a single run of small letters, which counts as a word up to ``WORD`` letters).  Text that people
write is far above that.  Base spans are cut out of a run and what remains is tested; of a remainder that passes,
the stretches between its UUIDs and words, then their pieces between separators, are tested too.

Defined cases: a null text counts as empty; a null doc_id keeps its row; repeated rows repeat; long texts are scanned
whole, in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches, tokenizer

KINDS = ("assign", "access", "hex", "opaque")
MIN_RUN, CHARS_PER_TOKEN, LETTERS_PER_TOKEN, WORD = 20, 2.2, 1.9, 20
FILE = "byte_bpe_50k.tiktoken"
VOCABULARY = f"/opt/tokenizers/{FILE}"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_PART = rf"[A-Za-z]?[a-z]{{0,{WORD - 1}}}[0-9]{{0,4}}"
_WORDS = re.compile(f"{_PART}(?:[-_/=+]{_PART})*")
_LETTERS = re.compile(r"[A-Za-z][a-z]*")
_CAPITALS = re.compile(r"[A-Z]{0,15}(?:[-_/=+][A-Z]{0,15})*")
_PIECE = re.compile(r"[A-Za-z0-9]+")
_HEX_TABLE = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_RUN_TABLE = bytes(120 if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "+/_=-") else 32 for i in range(256))
_encodings: dict[str, object] = {}


def encoding(path: str):
    """The byte-level BPE of a ranks file, loaded once in a process."""
    if path not in _encodings:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("scan", pat_str=r"[^\s]+|\s+", mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def known(run: str) -> bool:
    """Whether a run has no letters, or is a digest, a UUID or an identifier of words."""
    if not any(c.isalpha() for c in run) or _DIGEST.fullmatch(run) and len(run) in (32, 40, 56, 64, 96, 128):
        return True
    return any(p.fullmatch(run) for p in (_UUID, _WORDS, _CAPITALS))


def opaque(run: str, path: str) -> bool:
    """Whether a run's characters per token betray a random string."""
    least = LETTERS_PER_TOKEN if _LETTERS.fullmatch(run) else CHARS_PER_TOKEN
    return not known(run) and len(run) / len(encoding(path).encode_ordinary(run)) < least


def stretches(run: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what lies between the UUIDs and words of a run, then of each piece of these between separators."""
    ends: list[tuple[int, int]] = []  # whole pieces to test, joined where no word lies between them
    barred = [m.span() for m in _UUID.finditer(run)]
    found = [m.span() for m in _PIECE.finditer(run)]
    k, joins = 0, False
    for a, b in found:
        while k < len(barred) and barred[k][1] <= a:
            k += 1
        if k < len(barred) and barred[k][0] < b or _WORDS.fullmatch(run, a, b) or _CAPITALS.fullmatch(run, a, b):
            joins = False
        elif joins:
            ends[-1] = (ends[-1][0], b)
        else:
            ends.append((a, b))
            joins = True
    for a, b in ends:
        yield a, b
        yield from (m.span() for m in _PIECE.finditer(run, a, b))


def hidden(text: str, start: int, end: int, path: str) -> list[tuple[int, int]]:
    """The opaque (start, end) of a run or of the remainder of one."""
    run = text[start:end]
    if len(run) < MIN_RUN or known(run):
        return []
    if opaque(run, path):
        return [(start, end)]
    out: list[tuple[int, int]] = []
    for a, b in stretches(run):
        if b - a >= MIN_RUN and not (out and start + a < out[-1][1]) and opaque(run[a:b], path):
            out.append((start + a, start + b))
    return out


def spans(text: str | None, path: str = VOCABULARY) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret in code points, by start and kind."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    low = text.lower() if text.isascii() else None
    if low is None or any(n in low for n in NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    data = text.encode("utf-8", "surrogatepass")
    if b"x" * 24 in data.translate(_HEX_TABLE):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if len(m[0]) >= 24]
    if b"x" * MIN_RUN in data.translate(_RUN_TABLE):
        base, k = sorted((a, b) for _, a, b in out), 0
        reach = 0  # the end of the base spans so far
        for m in _RUN.finditer(text):
            while k < len(base) and base[k][0] <= m.start():
                reach, k = max(reach, base[k][1]), k + 1
            at = max(m.start(), reach)
            while k < len(base) and base[k][0] < m.end():
                if base[k][0] > at:
                    out += [("opaque", *s) for s in hidden(text, at, base[k][0], path)]
                reach, k = max(reach, base[k][1]), k + 1
                at = max(at, reach)
            if at < m.end():
                out += [("opaque", *s) for s in hidden(text, at, m.end(), path)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str | None, mark: str = "[SECRET]", path: str = VOCABULARY) -> str | None:
    """The text with every secret, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    found = spans(text, path)
    if not found:
        return text
    for _, a, b in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``found``: an array of (kind, start, end) of every row."""
    path = path or tokenizer(docs.sparkSession, FILE)
    kind = "array<struct<kind:string,start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(t.as_py(), path)] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, item)], ["doc_id", "found"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id long, found {kind}")


def redacted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with the secrets in ``text`` masked and ``n_chars`` counted anew where a text changed."""
    names, path = docs.columns, path or tokenizer(docs.sparkSession, FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column("text").to_pylist()
            new = [redact(t, path=path) for t in old]
            at = names.index("text")
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            if "n_chars" in names:
                at = names.index("n_chars")
                n = [len(y) if y is not x else k for x, y, k in zip(old, new, b.column("n_chars").to_pylist(), strict=True)]
                b = b.set_column(at, b.schema.field(at), pa.array(n, b.schema.field(at).type))
            yield b

    return map_batches(docs, run, T.StructType(docs.schema.fields))
