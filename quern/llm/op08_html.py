"""HTML extraction with wrappers learned per host.

A page becomes a stream of tags and texts.  Streams of one host are aligned one
after another into a union-free regular expression, the host's wrapper: a text
that differs between pages becomes a slot, a piece that some pages lack an
optional group, a piece that follows itself a repeated group [Crescenzi et al.,
"RoadRunner", 2001].  Wrappers of parts of a host align with each other in the
same way, so each task learns from the pages it reads, and only wrappers, not
pages, are brought together.

A text can be constant only if it is on 3 pages at least and on more than half of
its host's pages; pages with the same text count once, whatever their markup and
whichever tasks read them.  All other texts are slots.  Constant texts align and
repeat only with themselves, and a wrapper without slots has no constants.

The wrapper's slots, those in optional and repeated groups with them, choose the
host's main region: the innermost container with nine tenths of their characters.
A page's text is what this region holds, and the page's first-level headings,
without the constant texts.  Tags are the check: where a page has an article or main
element, only what lies in one counts; a region is not narrower than such an element;
and a region with less than half of what a page has is not the page's, and all
counts.  Constant texts that outweigh the rest of a page stay: copies of a page that
differ in a date are no template.
Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and
styles are recognised by element, role, class and id wherever they are, and left
out.  Character references are decoded once; white space within a block becomes
one space; blocks follow in page order, each on a line.  br is white space.

Wrappers are broadcast when their total size is below a limit, and joined by host
otherwise.  Null html gives an empty text; a null url has the empty host, a null
page_id stays null.  Repeated rows give repeated rows and count once; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'](?=[^>\"']*(?:>|\Z)))*)>?"
    r"|[^<]+|<",
    re.S,
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?|\Z", re.I) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no main text.
DROP = frozenset("script style template noscript head title nav menu header footer aside form button select option datalist input textarea label fieldset iframe object embed applet svg canvas audio video map dialog noembed noframes math".split()) - {"math", "object"}
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table caption tbody td tfoot th thead tr ul".split())
#: Parts of class and id values, and roles, that mark no main text.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|menu|submenu|breadcrumbs?|sidebar|side|aside|rail"
    r"|footer|foot|masthead|header|topbar|cookies?|consent|gdpr|notices?|alert|warning|disclaimer|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|social|share|sharing|follow"
    r"|related|recommend(?:ed|ations)?|comments?|comment-list|commentlist|replies|reply|respond|disqus|widgets?|toolbar|pagination|pager|copyright|skip|search|hidden)(?=$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements that an opening tag of the key ends.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
WIDEST = 24
#: Pages of different text that a constant text is on, at least.
LEAST = 3
#: Part of the slots' characters that the main region holds, at least, and elements that can be one.
SHARE = 0.9
HOLDERS = frozenset("html body main article section div center dl table tbody tr td ul ol".split())
BROADCAST_BYTES = 16 << 20


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): open and close tags with their attributes, and raw texts."""
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            s = m[0]
            if s.startswith("<![CDATA["):
                yield "raw", "", s[9:].removesuffix("]]>")
            elif not s.startswith(("<!", "<?")):
                yield "text", "", s
            continue
        tag = tag.lower()
        if m["close"]:
            yield "close", tag, ""
            continue
        yield "open", tag, m["attrs"]
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end()
            yield "close", tag, ""


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(text)}


def left_out(tag: str, attrs: str) -> bool:
    """Whether an element is a menu, an advert or the like."""
    if tag in DROP:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    a = attributes(attrs)
    if any(MARKED.search(a.get(k, "")) for k in ("class", "id")) or a.get("role", "").lower() in ROLES or a.get("aria-hidden", "").lower() == "true":
        return tag not in ("article", "main") or bool(re.search(r"comment|repl|related|promo|advert|sponsor|teaser", f"{a.get('class', '')} {a.get('id', '')}", re.I))
    return bool(re.search(r"(?:^|\s)hidden(?:$|[\s=])", re.sub(r"""=\s*("[^"]*"|'[^']*')""", "=", attrs))) or bool(re.search(r"display\s*:\s*none", a.get("style", ""), re.I))


def is_main(tag: str, attrs: str) -> int:
    """2 for an article, 1 for a main element, else 0."""
    if tag == "article":
        return 2
    if tag == "main" or attrs and re.search(r"""role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody\b""", attrs):
        return 1
    return 0


def walk(page: str) -> Iterator[tuple[str, str | None, int, str]]:
    """(key, None, 0, "") of block tags and ("", text, level, path) of the blocks that aren't left out; the
    level tells whether they lie in an article (2), in a main element (1) or elsewhere (0).  Paths have the
    containers' names and classes, with a star for articles and main elements."""
    part: list[str] = []
    stack: list[tuple[str, bool, int, str]] = []  # tag, left out, level and path outside
    skip = level = 0
    path = ""

    def text() -> Iterator[tuple[str, str | None, int, str]]:
        if part:
            found = " ".join(entities.unescape("".join(part)).split())
            part.clear()
            if found:
                yield "", found, level, path

    for kind, name, rest in tokens(page):
        if kind == "text" or kind == "raw":
            if not skip:
                part.append(rest if kind == "text" else rest.replace("&", "&amp;"))
        elif kind == "open":
            if name == "br":
                part.append(" ")
                continue
            key = name
            if name in BLOCK:
                yield from text()
                of = attributes(rest).get("class", "") if rest else ""
                key = name + "." + of if of else name
                yield key, None, 0, ""
            if name in ENDS and stack and stack[-1][0] in ENDS[name]:
                _, was, level, path = stack.pop()
                skip -= was
            if name in VOID or rest.endswith("/") and name in ("path", "svg"):
                continue
            drop = left_out(name, rest)
            stack.append((name, drop, level, path))
            skip += drop
            own = 0 if skip else is_main(name, rest)
            level = max(level, own)
            if own or name in BLOCK and name != "p":
                path += ">" + key + "*" * (own > 0)
        else:
            if name in BLOCK:
                yield from text()
                yield "/" + name, None, 0, ""
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    skip -= sum(was for _, was, _, _ in stack[k:])
                    level, path = stack[k][2:]
                    del stack[k:]
                    break
                if name not in BLOCK and stack[k][0] in BLOCK:
                    break  # an inline close ends nothing outside its block
    yield from text()


def blocks_of(page: str) -> list[tuple[str, int, str]]:
    """(text, level, path) of the blocks that aren't left out."""
    return [(t, level, path) for _, t, level, path in walk(page) if t is not None]


def lies_in(path: str, region: str) -> bool:
    return (path + ">").startswith(region + ">")


def is_title(path: str) -> bool:
    return path.rpartition(">")[2].partition(".")[0] == "h1"


def size_of(blocks: list[tuple[str, int, str]]) -> int:
    return sum(len(t) for t, _, _ in blocks)


def main_text(page: str | None, constant: frozenset[str] | set[str] = frozenset(), region: str = "") -> str:
    blocks = blocks_of(page or "")
    best = max((lv for _, lv, _ in blocks), default=0)
    if best:
        blocks = [b for b in blocks if b[1] == best or best == 1 and b[1] >= 1]
    varied = [b for b in blocks if b[0] not in constant]
    if 2 * size_of(varied) < size_of(blocks):
        varied = blocks
    inside = [b for b in varied if lies_in(b[2], region)]
    if 2 * size_of(inside) < size_of(varied):
        inside = varied
    else:
        inside = [b for b in varied if lies_in(b[2], region) or is_title(b[2])]
    return "\n".join(t for t, _, _ in inside)


# Wrappers. An item is [key, text or None, optional, items or None, characters]: a tag has its name and
# class as key, a slot "#" and its path, a constant text "=" and the text, a repeated group "+" and its items.
# Slots count the characters of all texts in them.


def mark(text: str) -> int:
    """64 bits that stand for a text."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def marks_of(page: str) -> tuple[int, set[int]]:
    """The mark of a page's whole text, and those of its blocks."""
    texts = [t for t, _, _ in blocks_of(page)]
    return mark("\n".join(texts)), set(map(mark, texts))


def stream(page: str, common: Container[int] = frozenset()) -> list[list]:
    """The block structure of a page as items; inline tags belong to the text.  ``common`` has the
    marks of the texts that can be constant."""
    out: list[list] = []
    for key, text, _, path in walk(page):
        if text is None:
            out.append([key, None, False, None, 0])
        elif mark(text) in common:
            out.append(["=" + text, text, False, None, 0])
        else:
            out.append(["#" + path, None, False, None, len(text)])
    return out


def _key(item: list) -> str:
    return item[0] if item[3] is None else "+(" + " ".join(map(_key, item[3])) + ")"


def _same(a: list, b: list) -> list:
    """Two items with equal keys as one."""
    if a[3] is not None:
        return [a[0], None, a[2] or b[2], [_same(x, y) for x, y in zip(a[3], b[3], strict=True)], a[4] + b[4]]
    return [a[0], a[1], a[2] or b[2], None, a[4] + b[4]]


def repeats(items: list[list]) -> list[list]:
    """Folds pieces that follow themselves into repeated groups, shortest first."""
    for width in range(1, WIDEST + 1):
        keys, out, i = [_key(x) for x in items], [], 0
        while i < len(items):
            j = i + width
            if j + width <= len(items) and keys[i:j] == keys[j : j + width] and any(not k.startswith("/") for k in keys[i:j]):
                group = [list(x) for x in items[i:j]]
                while keys[j : j + width] == keys[i : i + width]:
                    group = [_same(x, y) for x, y in zip(group, items[j : j + width], strict=True)]
                    j += width
                out.append(["+", None, False, group, 0])
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _fold_into(a: list[list], b: list[list]) -> tuple[list[list], list[list]]:
    """A piece that is a repeated group on one side and stands once on the other is the group."""
    groups = {tuple(map(_key, x[3])): x for x in (*a, *b) if x[3] is not None}
    if not groups:
        return a, b

    def fold(items: list[list]) -> list[list]:
        out, i = [], 0
        keys = [_key(x) for x in items]
        while i < len(items):
            for k in sorted(groups, key=len, reverse=True):
                if keys[i : i + len(k)] == list(k):
                    out.append(["+", None, False, [list(x) for x in items[i : i + len(k)]], 0])
                    i += len(k)
                    break
            else:
                out.append(items[i])
                i += 1
        return out

    return fold(a), fold(b)


def align(a: list[list], b: list[list]) -> list[list]:
    """One wrapper that matches what either matches."""
    if not a or not b:
        return [[*x[:2], True, *x[3:]] for x in a or b]
    a, b = _fold_into(a, b)
    out: list[list] = []
    for op, i, j, k, m in SequenceMatcher(None, [_key(x) for x in a], [_key(x) for x in b], autojunk=False).get_opcodes():
        if op == "equal":
            out += [_same(x, y) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [[*x[:2], True, *x[3:]] for x in (*a[i:j], *b[k:m])]
    return out


def common_of(pages: Iterable[str]) -> set[int]:
    """The marks of the texts that can be constant, if the host has no other pages."""
    distinct = dict(map(marks_of, pages))
    counts = Counter(t for texts in distinct.values() for t in texts)
    return {t for t, n in counts.items() if n >= LEAST and 2 * n > len(distinct)}


def wrapper_of(pages: Iterable[str], common: Container[int] | None = None) -> list[list]:
    """The wrapper of some pages of a host; equal structures are aligned without a search."""
    pages = list(pages)
    common = common_of(pages) if common is None else common
    wrapper: list[list] | None = None
    by_shape: dict[tuple[str, ...], list[list]] = {}
    for page in pages:
        items = repeats(stream(page, common))
        shape = tuple(map(_key, items))
        old = by_shape.get(shape)
        by_shape[shape] = items if old is None else [_same(x, y) for x, y in zip(old, items, strict=True)]
    for shape in sorted(by_shape, key=len):
        wrapper = by_shape[shape] if wrapper is None else align(wrapper, by_shape[shape])
    return wrapper or []


def single(items: list[list]) -> Iterator[list]:
    """The tags and texts, with those in groups."""
    for x in items:
        if x[3] is not None:
            yield from single(x[3])
        else:
            yield x


def constants(wrapper: list[list]) -> set[str]:
    """The texts of the template, if anything around them varies."""
    found = {x[1] for x in single(wrapper) if x[1] is not None}
    return found if any(x[0].startswith("#") for x in single(wrapper)) else set()


def region_of(wrapper: list[list]) -> str:
    """The path of the innermost container with ``SHARE`` of the slots' characters.  In an article or main
    element only another one is further in."""
    held: Counter[str] = Counter()
    for x in single(wrapper):
        if x[0].startswith("#"):
            at = x[0][1:]
            while at:
                held[at] += x[4]
                at = at.rpartition(">")[0]
            held[""] += x[4]
    region = ""
    for at in sorted((p for p, n in held.items() if n >= SHARE * held[""]), key=len):
        name = at.rpartition(">")[2]
        if name.split(".")[0].rstrip("*") in HOLDERS and (name.endswith("*") or "*" not in at):
            region = at
    return region


WRAPPER = "host string, wrapper string"


def common_texts(pages: DataFrame) -> DataFrame:
    """(host, texts): the marks of texts on ``LEAST`` pages and on more than half of those of the host.
    Pages of one text count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int | None, int], None] = {}
            for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if h:
                    host = host_of(u)
                    page, texts = marks_of(h)
                    found |= dict.fromkeys([(host, None, page), *((host, t, page) for t in texts)])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "t", "page"])

    counts = stored(pages.mapInArrow(count, "host string, t long, page long").distinct().groupBy("host", "t").agg(F.count("*").alias("n")).where(f"t is null or n >= {LEAST}"), "html-counts")
    whole = counts.where("t is null").select("host", F.col("n").alias("pages"))
    often = counts.where("t is not null").join(whole, "host").where("2 * n > pages")
    return stored(often.groupBy("host").agg(F.collect_list("t").alias("texts")), "html-common")


def with_hosts(pages: DataFrame, table: DataFrame, value: str, size: Column, make: Callable, limit: int) -> tuple[DataFrame, Callable]:
    """``pages`` and a function that gives for a batch of them what ``make`` makes of each row's host's value (of None
    where the host has none).  The values are broadcast if they fit in ``limit`` bytes, and joined by host otherwise."""
    if (table.agg(F.sum(size + F.octet_length("host"))).first()[0] or 0) <= limit:
        known = pages.sparkSession.sparkContext.broadcast({r["host"]: make(r[value]) for r in table.collect()})
        none = make(None)
        return pages, lambda batch: [known.value.get(host_of(u), none) for u in batch.column("url").to_pylist()]
    host = F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = pages.withColumn("host", F.coalesce(host, F.lit(""))).join(table, "host", "left").select(*pages.columns, value)
    return joined, lambda batch: [make(v) for v in batch.column(value).to_pylist()]


def learn_wrappers(pages: DataFrame, url: str = "url", html: str = "html", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(host, wrapper) for each host.  Pages that are byte for byte alike are aligned once in a batch."""
    pages = pages.select(F.col(url).alias("url"), F.col(html).alias("html"))
    pages, common_for = with_hosts(pages, common_texts(pages), "texts", 8 * F.size("texts"), lambda x: frozenset(x or ()), limit)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, dict[str, None]] = {}
            common: dict[str, frozenset[int]] = {}
            for u, h, c in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), common_for(batch), strict=True):
                if h:
                    host = host_of(u)
                    by.setdefault(host, {})[h] = None
                    common[host] = c
            if by:
                yield pa.RecordBatch.from_pydict({"host": list(by), "wrapper": [json.dumps(wrapper_of(x, common[k]), ensure_ascii=False) for k, x in by.items()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        whole: list[list] = []
        for w in sorted(pdf["wrapper"], key=lambda w: (len(w), w)):
            whole = align(whole, json.loads(w)) if whole else json.loads(w)
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": [json.dumps(whole, ensure_ascii=False)]})

    parts = pages.mapInArrow(learn, WRAPPER).distinct()
    parts = stored(parts, "wrappers")
    # two levels, so that a host of many pages is merged in many tasks first
    parts = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(32))).applyInPandas(merge, WRAPPER)
    return stored(parts.groupBy("host").applyInPandas(merge, WRAPPER), "wrappers")


def rules(wrapper: str | None) -> tuple[frozenset[str], str]:
    """The constant texts and the main region."""
    items = json.loads(wrapper or "[]")
    return frozenset(constants(items)), region_of(items)


def extract(pages: DataFrame, wrappers: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    pages = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    pages, rules_for = with_hosts(pages, wrappers, "wrapper", F.octet_length("wrapper"), rules, limit)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, *r) for h, r in zip(batch.column("html").to_pylist(), rules_for(batch), strict=True)]
        return pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return map_batches(pages, one, "page_id long, url string, text string, n_chars long")


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, learn_wrappers(pages))
