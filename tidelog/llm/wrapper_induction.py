"""Main text of web pages by wrapper induction.

Learning, over all pages of each host and of each layout of it (pages with the same containers in the top three levels):
texts are aligned by the path of their element.  A text that is at its path on every page of the host, or of a layout, is
constant template text; what varies makes slots.  The deepest element that holds at least ``SHARE`` of the varying text
outside boilerplate regions is the content root of the host or layout.  Counts are pre-aggregated by (host, layout, path,
text), so neither pages, texts nor hosts are sampled or cut, and a hot host is spread by its texts.  ``induce`` is the same
for the pages of one layout in memory, aligned by simple tree matching.

Extraction, for every page: all text inside the host's content roots, and all other text that is not constant template text of
the host (so titles, leads or sections beside the root stay), without regions that are boilerplate by their element, role
or class (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments).  Character references are decoded, white space
inside a block becomes one space, blocks are trimmed and joined in page order by one space.

Class words count as a whole, or in compounds with words that say nothing; ``lists=False`` leaves them, and the names of
elements, out.

Defined cases: null html gives an empty text; null or odd urls share the host ''; broken markup is read leniently (open
elements end with their parents, an article ends open boilerplate regions, an unclosed script ends the page); repeated
pages repeat; hosts and layouts with one different page, or without varying text, have no template and no root.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

SHARE, BROADCAST, LAYOUT_LEVELS, DEPTH = 0.8, 500_000, 3, 256

# Element names and class words of the markup language and of common page furniture.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "button", "head", "title", "canvas", "audio", "video", "datalist"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "search"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "mfrac", "mi", "mn", "mo", "mrow", "msqrt", "msub", "msup", "mtext", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"ul", "ol", "dl", "table", "select", "menu", "article", "section", "div", "main", "body"}
MAIN = {"html", "body", "main", "article"}
CONTAINERS = MAIN | {"div", "section", "header", "footer", "nav", "aside", "form"}
NUMBERED = CONTAINERS | {"td", "th", "ul", "ol", "dl", "table"}
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "alert", "newsletter", "subscribe", "signup", "login", "search", "form", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "share", "sharing", "social", "related", "recommended", "pagination", "pager", "widget", "copyright", "skip", "toolbar"}
HEADS = {"header", "masthead", "topbar", "head"}
PLAIN = {"article", "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "container", "content", "desktop", "fixed", "global", "inner", "item", "items", "js", "left", "link", "links", "list", "local", "main", "mobile", "outer", "page", "panel", "post", "primary", "reader", "right", "row", "secondary", "section", "site", "slot", "sticky", "text", "thread", "top", "unit", "user", "wrap", "wrapper"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """``path`` has the keys down to the element; ``place`` also numbers containers among the like children of their parent."""

    __slots__ = ("tag", "key", "children", "texts", "silent", "path", "place", "seen")

    def __init__(self, tag: str, key: str, silent: bool, path: str, place: str):
        self.tag, self.key, self.silent, self.path, self.place = tag, key, silent, path, place
        self.children: list[Node] = []
        self.texts: list[str] = []
        self.seen: dict[str, int] | None = None  # containers among its children, by key


@lru_cache(maxsize=1 << 16)
def names(token: str, heads: bool) -> bool:
    """Whether a class or id is a word of page furniture (or of its ``heads``), or made of such words and of words that say
    nothing (``site-footer``, but not ``notice-period``)."""
    words = HEADS if heads else WORDS
    parts = [w for w in _SPLIT.split(_CAMEL.sub("-", token).lower()) if w]
    return not words.isdisjoint(parts) and all(p in WORDS or p in HEADS or p in PLAIN or p.isdigit() for p in parts)


def furniture(tag: str, attrs: str, inside: bool, lists: bool = True) -> tuple[str, bool]:
    """The key of an element (its name and first class word) and whether it is boilerplate; ``inside``: in an article.

    Without ``lists`` only what shows no text is boilerplate, and the wrapper alone decides about the rest.
    """
    bad = tag in SILENT or lists and (tag in FURNITURE or tag == "header" and not inside)
    first = ""
    if attrs and not attrs.isspace():
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                if not first and name == "class":
                    first = next((w for w in _SPLIT.split(value.lower()) if w), "")
                if lists and tag not in MAIN and any(names(t, False) or not inside and names(t, True) for t in value.split()):
                    bad = True
            elif name == "role":
                bad |= lists and value.lower() in ROLES and tag not in MAIN
            elif name == "hidden" or value.lower() == "true":
                bad = True
    return f"{tag}.{first}" if first else tag, bad


def parse(page: str | None, lists: bool = True) -> tuple[Node, list[tuple[Node, str]]]:
    """The DOM tree of a page, and its blocks in order: (element, text).  Paths end at the level ``DEPTH``."""
    root = Node("", "", False, "", "")
    stack, blocks, part = [root], [], []
    opened: dict[str, int] = {}  # how many elements of each name are open
    text = page or ""

    def close(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag] -= 1
        del stack[k:]

    def flush() -> None:
        if part:
            joined = " ".join(html_.unescape("".join(part)).split())
            part.clear()
            if joined:
                top = stack[-1]
                top.texts.append(joined)
                blocks.append((top, joined))

    at, end = 0, len(text)
    inside = 0
    while at < end:
        m = _TAG.search(text, at)
        if m is None:
            if not stack[-1].silent or stack[-1].tag not in RAW:
                part.append(text[at:])
            break
        if m.start() > at:
            part.append(text[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0) if opened.get(tag) else 0
            if tag not in INLINE:
                flush()
            if k and not (tag in INLINE and any(n.tag not in INLINE for n in stack[k:])):
                if stack[-1].silent != stack[k - 1].silent:
                    flush()
                inside -= sum(n.tag in ("article", "main") for n in stack[k:])
                close(k)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag not in INLINE:
            flush()
            if tag in ("article", "main"):
                k = next((k for k, n in enumerate(stack) if n.silent), 0) if stack[-1].silent else 0
                if k:
                    close(k)
            if tag == "p" or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag not in INLINE), 0)
                if stack[k].tag == "p":
                    close(k)
            elif tag in ENDS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ENDS[tag]:
                        close(k)
                        break
                    if stack[k].tag in LISTS:
                        break
        key, bad = furniture(tag, m[3] or m[6] or "", inside > 0, lists)
        up = stack[-1]
        if bad and not up.silent:
            flush()
        path, place = up.path, up.place
        if len(stack) <= DEPTH:
            nth = ""
            if tag in NUMBERED:
                if up.seen is None:
                    up.seen = {}
                up.seen[key] = up.seen.get(key, 0) + 1
                nth = f"[{up.seen[key]}]" if up.seen[key] > 1 else ""
            path, place = f"{path}/{key}", f"{place}/{key}{nth}"
        node = Node(tag, key, up.silent or bad, path, place)
        up.children.append(node)
        if (m[3] or m[6] or "").rstrip().endswith("/") and tag not in MAIN and tag in ("svg", "path", "iframe", "script"):
            continue
        if tag in RAW:
            ending = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = ending.end() if ending else end
            continue
        inside += tag in ("article", "main")
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(node)
    flush()
    return root, blocks


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]] | None = None) -> int:
    """Simple tree matching: the size of the largest order-preserving match of two trees; notes its pairs in ``pairs``."""
    if a.key != b.key:
        return 0
    m, n = len(a.children), len(b.children)
    best = np.zeros((m + 1, n + 1), np.int64)
    own = np.zeros((m, n), np.int64)
    for i in range(m):
        for j in range(n):
            if a.children[i].key == b.children[j].key:
                own[i, j] = match(a.children[i], b.children[j])
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + own[i, j])
    if pairs is not None:
        pairs.append((a, b))
        i, j = m, n
        while i and j:
            if own[i - 1, j - 1] and best[i, j] == best[i - 1, j - 1] + own[i - 1, j - 1]:
                match(a.children[i - 1], b.children[j - 1], pairs)
                i, j = i - 1, j - 1
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
    return int(best[m, n]) + 1


def constant(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\n{text}".encode("utf-8", "surrogatepass"), 0) - (1 << 63)


def every(node: Node) -> Iterator[Node]:
    """A node and all below it, in page order."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += n.children[::-1]


def layout(tree: Node) -> int:
    """A hash of the containers in a page's top levels, without their order and repetition."""
    paths, level = set(), [tree]
    for _ in range(LAYOUT_LEVELS):
        level = [c for n in level for c in n.children if c.tag in CONTAINERS]
        paths.update(c.path for c in level)
    return constant("layout", "\n".join(sorted(paths)))


def induce(pages: list[str], lists: bool = True) -> tuple[str, list[int]]:
    """The path of the content root ('' if none stands out) and the constant texts of pages of one layout."""
    trees = [parse(p, lists)[0] for p in pages]
    if len(trees) < 2:
        return "", []
    texts: dict[int, list[list[str]]] = {id(n): [n.texts] for n in every(trees[0])}
    for other in trees[1:]:
        pairs: list[tuple[Node, Node]] = []
        match(trees[0], other, pairs)
        for a, b in pairs:
            texts[id(a)].append(b.texts)
    constants = []
    weight: dict[str, int] = {}
    for n in every(trees[0]):
        seen = texts[id(n)]
        same = len(seen) == len(trees) and all(t == seen[0] for t in seen)
        if n.texts and same:
            constants += [constant(n.path, t) for t in n.texts]
        elif n.texts and not n.silent:
            size = sum(len(x) for t in seen for x in t)
            parts = n.place.split("/")
            for k in range(2, len(parts) + 1):
                path = "/".join(parts[:k])
                weight[path] = weight.get(path, 0) + size
    top = max(weight.values(), default=0)
    root = max((p for p, w in weight.items() if w >= SHARE * top and re.split(r"[.\[]", p.rpartition("/")[2])[0] not in INLINE | {"p"}), key=lambda p: p.count("/"), default="")
    return root, constants


def main_text(page: str | None, roots: str | Sequence[str] = "", constants: frozenset[int] = frozenset(), lists: bool = True) -> str:
    inside = tuple(f"{r}/" for r in ([roots] if isinstance(roots, str) else roots) if r)
    return " ".join(t for n, t in parse(page, lists)[1] if not n.silent and (f"{n.place}/".startswith(inside) or not constants or constant(n.path, t) not in constants))


def host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


def texts_seen(pages: DataFrame, lists: bool = True) -> DataFrame:
    """host, layout (null: all), item, path, n, size, several: on how many pages of the host or layout each text is at its
    path, its place (of several the first), its summed length, and whether on different pages.  Rows without a path count
    the pages."""
    rows = pages.where("html IS NOT NULL").select(host().alias("host"), F.xxhash64("html").alias("h"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for at, h, page in zip(b.column("host").to_pylist(), b.column("h").to_pylist(), b.column("html"), strict=True):
                tree, blocks = parse(page.as_py(), lists)
                sizes: dict[tuple[str, str], tuple[str, int]] = {}
                for n, text in blocks:
                    if not n.silent:
                        place, size = sizes.get((n.path, text), (n.place, 0))
                        sizes[n.path, text] = place, size + len(text)
                items = [(0, None, 0), *((constant(p, t), place, size) for (p, t), (place, size) in sizes.items())]
                for scope in (None, layout(tree)):
                    for item, path, size in items:
                        for col, x in zip(out, (at, scope, item, path, size, h), strict=True):
                            col.append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["host", "layout", "item", "path", "size", "h"])

    seen = map_batches(rows, run, "host string, layout long, item long, path string, size long, h long")
    return seen.groupBy("host", "layout", "item").agg(F.min("path").alias("path"), F.count("*").alias("n"), F.sum("size").alias("size"), (F.min("h") < F.max("h")).alias("several"))


def wrappers(pages: DataFrame, lists: bool = True) -> DataFrame:
    """host, roots, constants: what all pages of a host teach; hosts that teach nothing have no row."""
    seen = stored(texts_seen(pages, lists))
    key = ["host", "layout"]
    same = lambda a, b: (F.col(f"{a}.host") == F.col(f"{b}.host")) & F.col(f"{a}.layout").eqNullSafe(F.col(f"{b}.layout"))
    totals = seen.where("path IS NULL AND several").select(*key, F.col("n").alias("pages"))
    few = totals.count() <= BROADCAST
    near = F.broadcast if few else lambda df: df
    texts = seen.where("path IS NOT NULL").alias("s").join(near(totals).alias("t"), same("s", "t")).select("s.*", (F.col("n") == F.col("pages")).alias("fixed"))
    slots = texts.where("NOT fixed").select(*key).distinct()
    fixed = stored(texts.where("fixed").alias("f").join(near(slots).alias("t"), same("f", "t"), "left_semi").select("host", "item").distinct())
    known = F.broadcast(fixed) if fixed.count() <= BROADCAST else fixed
    varying = texts.where("NOT fixed").join(known, ["host", "item"], "left_anti")  # also of the host, what is fixed in a layout
    varying = stored(varying.groupBy(*key, "path").agg(F.sum("size").alias("size")))
    parts = F.split("path", "/")
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts))).otherwise(F.array().cast("array<int>"))
    weights = varying.select(*key, "size", F.explode(F.transform(depths, lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path")).groupBy(*key, "path").agg(F.sum("size").alias("w"))
    tops = varying.groupBy(*key).agg(F.sum("size").alias("top"))
    tag = F.regexp_extract("path", r"/([^/.\[]*)[^/]*$", 1)
    heavy = weights.alias("w").join(near(tops).alias("t"), same("w", "t")).where(F.col("w") >= F.lit(SHARE) * F.col("top")).where(~tag.isin(*INLINE, "p"))
    roots = heavy.groupBy("w.host", "w.layout").agg(F.max_by("path", F.size(parts)).alias("root")).groupBy("host").agg(F.collect_set("root").alias("roots"))
    return fixed.groupBy("host").agg(F.collect_list("item").alias("constants")).join(roots, "host", "full")


def extract(pages: DataFrame, lists: bool = True) -> DataFrame:
    """page_id, url, text of every page.  Without ``lists`` the names of elements and classes count for nothing, and only
    what the host's pages have in common and where they vary decides."""
    learned = stored(wrappers(pages, lists))
    base = pages.select("page_id", "url", "html", host().alias("_host"))
    out = "page_id long, url string, text string"
    size = learned.agg(F.sum(F.lit(1) + F.greatest(F.size("constants"), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST:  # hosts and constants; otherwise the pages are joined to them
        known = {r["host"]: (tuple(r["roots"] or ()), frozenset(r["constants"] or ())) for r in learned.collect()}
        sent = pages.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                text = [main_text(t.as_py(), *sent.value.get(h, ("", frozenset())), lists) for h, t in zip(b.column("_host").to_pylist(), b.column("html"), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

        return map_batches(base, run, out)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(t.as_py(), r or (), frozenset(c or ()), lists) for t, r, c in zip(b.column("html"), b.column("roots").to_pylist(), b.column("constants").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return map_batches(base.join(learned.withColumnRenamed("host", "_host"), "_host", "left"), joined, out)
