"""Main text of pages by template deduction over the pages of a host.

Tokens of a page are its opening tags, told apart by their path (names, classes and ids from the root), and the
texts of its blocks, told apart by path and wording.  A token's occurrence vector says how often it occurs on
each page of the host; it is kept as an order-free fingerprint over (page, count), so vectors are compared without
being gathered anywhere.  Tokens of equal vectors form a class.

A class of tags is valid if its tags occur once on each of its pages, on at least ``TAG_SHARE`` of the host's pages,
and hang below at most one other class; valid classes nest into the host's template, a tree of elements.  Every text
belongs to the slot of the deepest template element around it, and the slots of all pages of the host decide:

- A slot of which links hold ``LINKED`` of the characters is a menu, if the host has several pages.
- The article is in the template's article or main element if that holds more than ``DOMINANT`` of the weight of all
  slots, else in the whole page.  Weight is the length of texts outside links; being in such an element, or below a class or
  id that names an outside part, only shifts it (``ARTICLE``, ``NAMED``), so a teaser does not hide a longer text.

The text of a page is that of its slots in that region without menus, and without the footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments in it; a class or id that says so does not count for an
element that holds half of the region.  A page that lacks the region is its own host.

Texts of valid classes (occurring alike, and with an element) are template text and no part of a slot.  Their support is
at least ``MIN_PAGES`` pages and ``MIN_SHARE`` of the host's.  Pages of a host with the same texts count as one page, whatever
their markup.  For texts, a page is a near copy, and does not count, if the text that it shares with support enough is
``NEAR`` times its other text or more (two such pages are three quarters equal, as in near-dedup): text that copies of
an article share is not boilerplate.

Pages are parsed once; what is staged (tokens and blocks) serves the deduction and the extraction.  The deduction reads
no texts, only their sizes and hashes, so no join of it moves them.

Defined cases: a null or empty html gives an empty text; a page with a null url, or one without a host, is its own
host; repeated rows are copies; unclosed and stray tags are taken as browsers do, roughly; white space, also
the unbreakable kind, becomes one space, a line break too; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat, zip_longest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.llm.common import read, staged
from meterlens.llm.textnum import slices

MIN_PAGES = 10
MIN_SHARE = 0.1
NEAR = 6  # shared / (shared + 2 * own) is 0.75
TAG_SHARE = 0.5
DOMINANT = 0.5
LINKED = 0.5

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))|([^\s=\"'/]+)")
_WORD = re.compile(r"[a-z0-9]+")

RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
#: Elements that are no part of an article.
OUTSIDE = {
    "head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "button", "select", "textarea",
    "menu", "dialog", "object", "canvas", "title", "datalist", "noembed", "noframes",
}
#: Words of a class or id that say the same of any element.
OUTSIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "related", "respond", "share", "sharing", "sidebar",
    "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: How much a character weighs that stands in no named part, in an article or main element, below a class or id that
#: names an outside part, in an element that is such a part.
PLAIN, ARTICLE, NAMED, APART = 4, 16, 1, 0
#: Elements that leave an open head.
_HEAD = {"title", "meta", "link", "style", "script", "base", "noscript", "template", "basefont", "bgsound"}
#: Opening one of these ends an open element of its kind, up to the container named.
SIBLINGS = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",)),
    "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
}
_NO_P = INLINE | VOID - {"hr"}


class _Element:
    __slots__ = ("apart", "article", "link", "mark", "name", "number", "path")

    def __init__(self, name: str, path: int, number: int, mark: int, article: bool, link: bool):
        self.name, self.path, self.number, self.mark, self.article, self.link = name, path, number, mark, article, link
        self.apart = False  # stands in an outside part of a paragraph


class Block:
    """A run of text between block boundaries, and where it stands."""

    __slots__ = ("chars", "link_chars", "number", "text", "token")

    def __init__(self, text: str, element: _Element, link_chars: int):
        self.text, self.number, self.chars, self.link_chars = text, element.number, len(text), link_chars
        self.token = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=element.path)


def _opened(name: str, attributes: str, parent: _Element, number: int) -> _Element:
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
    label = f"{found.get('class', '')} {found.get('id', '')}".strip().lower()
    path = xxhash.xxh64_intdigest(f"{name} {label}".encode("utf-8", "surrogatepass"), seed=parent.path)
    role = found.get("role", "").lower()
    article = parent.article or name in ("article", "main") or role == "main"
    mark = PLAIN
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in re.sub(r"\s", "", found.get("style", "").lower())
    if (name in OUTSIDE and name != "form") or hidden:
        mark = APART
    elif name not in ("html", "body", "article", "main"):
        words = set(_WORD.findall(label))
        if name == "form" or role in OUTSIDE_ROLES or words & OUTSIDE_WORDS or (not parent.article and (name == "header" or "header" in words)):
            mark = NAMED
    element = _Element(name, path, number, mark, article, parent.link or name == "a")
    element.apart = name in INLINE and (mark != PLAIN or parent.apart)
    return element


class Page:
    """Elements in page order as (path, number of the parent, mark, in an article), and blocks in page order.  Element 0 is the page itself."""

    def __init__(self) -> None:
        self.paths, self.parents, self.marks, self.articles = [0], [-1], [PLAIN], [False]
        self.blocks: list[Block] = []

    def add(self, e: _Element, parent: int) -> None:
        self.paths.append(e.path)
        self.parents.append(parent)
        self.marks.append(e.mark)
        self.articles.append(e.article)


def parsed(page: str) -> Page:
    out = Page()
    blocks = out.blocks
    stack = [_Element("", 0, 0, PLAIN, False, False)]
    open_names: Counter[str] = Counter()
    runs: list[tuple[str, _Element]] = []  # texts of the block

    def text(raw: str) -> None:
        if raw:
            runs.append((raw, stack[-1]))

    def flush() -> None:
        # a part of a paragraph that is an outside part goes alone; what is left stands in the innermost element around it
        if not runs:
            return
        for some in ([r for r in runs if not r[1].apart], [r for r in runs if r[1].apart]):
            whole = " ".join(entities.unescape("".join(raw for raw, _ in some)).split())
            if whole:
                holders = [(raw, e) for raw, e in some if not raw.isspace()]
                linked = sum(len(raw.strip()) for raw, e in holders if e.link)
                blocks.append(Block(whole, holders[0][1], min(linked, len(whole))))
        runs.clear()

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_names[stack.pop().name] -= 1

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name == "br":
            text(" ")
            continue
        if name not in INLINE:
            flush()
        if closing:
            if open_names[name]:
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                if any(e.name not in INLINE for e in stack[depth:]):
                    flush()
                pop_to(depth)
            continue
        if open_names["head"] and name not in _HEAD and name not in ("html", "head"):
            depth = len(stack) - 1
            while stack[depth].name != "head":
                depth -= 1
            pop_to(depth)
        if open_names["p"] and name not in _NO_P:
            depth = len(stack) - 1
            while stack[depth].name != "p":
                depth -= 1
            pop_to(depth)
        if name in SIBLINGS:
            ends, containers = SIBLINGS[name]
            depth = len(stack) - 1
            while depth and stack[depth].name not in containers:
                if stack[depth].name in ends.split():
                    pop_to(depth)
                depth -= 1
        if name in VOID:
            continue
        element = _opened(name, attributes, stack[-1], len(out.paths))
        out.add(element, stack[-1].number)
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = end.start() if end else n
            if end:
                close = page.find(">", end.end())
                at = close + 1 if close >= 0 else n
            continue
        stack.append(element)
        open_names[name] += 1
    flush()
    return out


def _slot_of(page: Page, template: set[int]) -> list[int]:
    """For each element, the deepest template element around it, as its number; 0 is the page."""
    slot = [0]
    for k in range(1, len(page.paths)):
        slot.append(k if page.paths[k] in template else slot[page.parents[k]])
    return slot


def slots_of(page: Page, template: set[int]) -> list[tuple[int, int, bool, int, int, int]]:
    """(element, template element around it, is an article, weight, characters, characters in links) of each slot."""
    slot, least = _slot_of(page, template), [PLAIN]
    for k in range(1, len(page.paths)):
        least.append(min(least[page.parents[k]], page.marks[k]))
    sums = {k: [0, 0, 0] for k in {*slot}}
    for b in page.blocks:
        mark = ARTICLE if least[b.number] == PLAIN and page.articles[b.number] else least[b.number]
        own = sums[slot[b.number]]
        own[0] += mark * (b.chars - b.link_chars)
        own[1] += b.chars
        own[2] += b.link_chars
    out = []
    for k, (weight, chars, linked) in sums.items():
        above = page.parents[k] if k else 0
        begins = page.articles[k] and not page.articles[above]
        out.append((page.paths[k], page.paths[slot[above]], begins, weight, chars, linked))
    return out


def chosen(slots: list[tuple[int, int, bool, int, int, int]]) -> tuple[int, list[int]]:
    """The region of a template (0 is the whole page), and its menus."""
    parents = {node: parent for node, parent, *_ in slots if node}
    total: Counter[int] = Counter()
    for node, _, _, weight, _, _ in slots:
        total[0] += weight
        while node:
            total[node] += weight
            node = parents.get(node, 0)
    articles = [node for node, _, begins, *_ in slots if node and begins and total[node] > DOMINANT * total[0]]
    menus = [node for node, *_, chars, linked in slots if node and linked and linked >= LINKED * chars]
    return max(articles, key=lambda node: (total[node], node), default=0), sorted(menus)


def own_template(page: Page) -> set[int]:
    """The elements that occur once: the template of a page without others of its host."""
    return {path for path, n in Counter(page.paths).items() if n == 1 and path}


def main_text(page: Page, template: set[int], region: int, menus: set[int], texts: set[int]) -> str:
    """The slots of the region without menus, template texts and the outside parts below it, one block a line."""
    if region not in page.paths:
        template = own_template(page)
        region, menus = chosen(slots_of(page, template))[0], set()
    n, slot = len(page.paths), _slot_of(page, template)
    inside, chars = [False] * n, [0] * n
    for k in range(n):
        inside[k] = page.paths[k] == region or (k > 0 and inside[page.parents[k]])
    for b in page.blocks:
        chars[b.number] += b.chars
    for k in range(n - 1, 0, -1):
        chars[page.parents[k]] += chars[k]
    whole = sum(chars[k] for k in range(n) if page.paths[k] == region)
    out = [False] * n
    for k in range(1, n):
        if inside[k] and page.paths[k] != region:
            apart = page.marks[k] == APART or (page.marks[k] == NAMED and 2 * chars[k] < whole)
            out[k] = apart or out[page.parents[k]]
    kept = [
        b.text for b in page.blocks
        if inside[b.number] and not out[b.number] and b.token not in texts and (page.articles[b.number] or page.paths[slot[b.number]] not in menus)
    ]
    return "\n".join(kept)


def text_alone(html: str) -> str:
    """The text of a page without others of its host."""
    page = parsed(html)
    template = own_template(page)
    return main_text(page, template, chosen(slots_of(page, template))[0], set(), set())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Elements and blocks are kept as one array per figure.  Texts stand apart: what is deduced needs their sizes only.
_ELEMENTS = {"paths": "long", "parents": "int", "marks": "int", "articles": "boolean"}
_BLOCKS = {"numbers": "int", "sizes": "int", "links": "int"}
_SHAPE = (*_ELEMENTS, *_BLOCKS)
_TOKENS = {"token": "long", "parent": "long", "is_tag": "boolean", "n": "long"}
_LISTS = {"texts": "long", "chars": "long", **_ELEMENTS, **_BLOCKS, "block_tokens": "long", "block_texts": "string"}
_PAGE = (
    "page long, page_id {kind}, url string, host string, content long, "
    + f"tokens array<struct<{', '.join(f'{k}: {v}' for k, v in _TOKENS.items())}>>, "
    + ", ".join(f"{k} array<{v}>" for k, v in _LISTS.items())
)
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_PAGE``: each token of each page once; ``content`` is a hash of its texts, ``texts`` and ``chars`` tell their share."""
    for batch in batches:
        for part in slices(batch, "html"):
            content: list[int] = []
            flat: dict[str, list] = {name: [] for name in (*_TOKENS, *_LISTS)}
            ends: dict[str, list[int]] = {name: [0] for name in ("tokens", *_LISTS)}
            for page in map(parsed, (x or "" for x in part.column("html").to_pylist())):
                paths, blocks = page.paths, page.blocks
                found = Counter(zip(paths[1:], [paths[max(k, 0)] for k in page.parents[1:]], [True] * (len(paths) - 1), strict=True))
                found.update((b.token, paths[b.number], False) for b in blocks)
                flat["token"] += [_signed(t) for t, _, _ in found]
                flat["parent"] += [_signed(p) for _, p, _ in found]
                flat["is_tag"] += [k for _, _, k in found]
                flat["n"] += found.values()
                least = [PLAIN]
                for k in range(1, len(paths)):
                    least.append(min(least[page.parents[k]], page.marks[k]))
                inside = [b for b in blocks if least[b.number] == PLAIN]
                content.append(_signed(xxhash.xxh64_intdigest("\n".join(b.text for b in inside).encode("utf-8", "surrogatepass"))))
                long: Counter[int] = Counter()
                for b in inside:
                    long[_signed(b.token)] += b.chars
                flat["texts"] += long
                flat["chars"] += long.values()
                flat["paths"] += map(_signed, paths)
                flat["parents"] += page.parents
                flat["marks"] += page.marks
                flat["articles"] += page.articles
                flat["numbers"] += [b.number for b in blocks]
                flat["sizes"] += [b.chars for b in blocks]
                flat["links"] += [b.link_chars for b in blocks]
                flat["block_tokens"] += [_signed(b.token) for b in blocks]
                flat["block_texts"] += [b.text for b in blocks]
                for name, upto in ends.items():
                    upto.append(len(flat["token" if name == "tokens" else name]))
            columns = {name: part.column(name) for name in ("page", "page_id", "url", "host")}
            tokens = pa.StructArray.from_arrays([pa.array(flat[k], _ARROW[v]) for k, v in _TOKENS.items()], list(_TOKENS))
            values = {"tokens": tokens} | {k: pa.array(flat[k], _ARROW[v]) for k, v in _LISTS.items()}
            columns["content"] = pa.array(content, pa.int64())
            columns |= {k: pa.ListArray.from_arrays(pa.array(ends[k], pa.int32()), v) for k, v in values.items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _rows(column: pa.Array) -> list[list]:
    """The lists of a column, none of them null."""
    ends = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))).tolist()
    flat = column.flatten()
    values = flat.to_pylist() if pa.types.is_string(flat.type) else flat.to_numpy(zero_copy_only=False).tolist()
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _stored(batch: pa.RecordBatch, texts: bool = False) -> Iterator[Page]:
    """The pages of a batch; blocks have their text and token only if asked for."""
    shape = zip(*(_rows(batch.column(name)) for name in _SHAPE), strict=True)
    wording = zip(_rows(batch.column("block_tokens")), _rows(batch.column("block_texts")), strict=True) if texts else repeat(((), ()))
    for (paths, parents, marks, articles, numbers, sizes, links), (tokens, texts_) in zip(shape, wording, strict=False):
        page = Page()
        page.paths, page.parents, page.marks, page.articles = paths, parents, marks, articles
        for number, size, linked, token, text in zip_longest(numbers, sizes, links, tokens, texts_):
            block = Block.__new__(Block)
            block.number, block.chars, block.link_chars, block.token, block.text = number, size, linked, token, text
            page.blocks.append(block)
        yield page


def _of_host(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[set[int], ...]]:
    """For each row the lists of its host as sets, nulls as empty ones; rows of a host share them."""
    known: dict[str, tuple[set[int], ...]] = {}
    for k, host in enumerate(batch.column("host").to_pylist()):
        if host not in known:
            known[host] = tuple(set(batch.column(name)[k].as_py() or ()) for name in names)
        yield known[host]


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``host, content, tokens`` of the pages that are no near copies, given the ``common`` texts of their host."""
    for batch in batches:
        keep = []
        for k, (texts, chars, (common,)) in enumerate(zip(_rows(batch.column("texts")), _rows(batch.column("chars")), _of_host(batch, "common"), strict=True)):
            shared = sum(n for t, n in zip(texts, chars, strict=True) if t in common)
            if shared < NEAR * (sum(chars) - shared):
                keep.append(k)
        yield batch.select(["host", "content", "tokens"]).take(pa.array(keep, pa.int64()))


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def parsed_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The staged tokens and blocks of every row of ``pages`` (page_id, url, html); a page without a host is its own."""
    fields = _PAGE.format(kind=pages.schema["page_id"].dataType.simpleString())
    rows = pages.select(F.monotonically_increasing_id().alias("page"), "page_id", "url", host_of(F.col("url")).alias("host"), "html")
    host = F.when(F.col("host") != "", F.col("host")).otherwise(F.concat(F.lit("/"), F.xxhash64("html"), F.lit("/"), F.col("page")))
    return staged(spark, rows.withColumn("host", host).mapInArrow(_pages, fields), "pages", compression="zstd")


def firsts(pages: DataFrame) -> DataFrame:
    """``bucket, firsts``: bits of the first page with each content of a host.  Page numbers run on inside a split, so
    that a split has one row for every 32,768 of its pages."""
    once = pages.groupBy("host", "content").agg(F.min("page").alias("page"))
    return once.groupBy(F.bitmap_bucket_number("page").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("page")).alias("firsts"))


def first_of(pages: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``pages`` that ``firsts`` has marked, without a shuffle of pages as long as its bits can be broadcast."""
    at = F.bitmap_bit_position("page")
    byte = F.conv(F.hex(F.substring("firsts", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    both = pages.join(marked, F.bitmap_bucket_number("page") == F.col("bucket"))
    return both.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*pages.columns)


def _classes(pages: DataFrame, hosts: DataFrame, least: Column) -> DataFrame:
    """Tokens with support enough and their class: the xor of fingerprints of (page, count) is an occurrence vector."""
    tokens = pages.select("host", "content", F.inline("tokens"))
    tokens = tokens.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("content", "n")).alias("vector"), F.sum("n").alias("total"), F.count("*").alias("support"),
        F.min("parent").alias("parent"), F.max("is_tag").alias("is_tag"),
    )
    tokens = tokens.join(hosts, "host").filter(F.col("support") >= least)
    return tokens.withColumn("class", F.xxhash64("vector", "total", "support")).drop("vector")


def _nested(tokens: DataFrame) -> DataFrame:
    """``v_host, v_class`` of the classes that hold an element and hang below at most one other class."""
    above = tokens.filter("is_tag").select(F.col("host").alias("p_host"), F.col("token").alias("p_token"), F.col("class").alias("p_class"))
    nested = tokens.filter("is_tag").join(above, (F.col("host") == F.col("p_host")) & (F.col("parent") == F.col("p_token")), "left")
    over = F.when(F.coalesce("p_class", F.lit(0).cast("long")) != F.col("class"), F.coalesce("p_class", F.lit(0).cast("long")))
    classes = nested.groupBy("host", "class").agg(F.countDistinct(over).alias("n_over"))
    return classes.filter("n_over <= 1").select(F.col("host").alias("v_host"), F.col("class").alias("v_class"))


def _of_valid(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    valid = _nested(tokens)
    return rows.join(valid, (F.col("host") == F.col("v_host")) & (F.col("class") == F.col("v_class")), "left_semi")


def template_texts(spark: SparkSession, once: DataFrame, min_pages: int, min_share: float) -> DataFrame:
    """``host, texts``: fingerprints of the texts in the valid classes of each host, given one page per content."""
    hosts = once.groupBy("host").agg(F.count("*").alias("host_pages")).filter(F.col("host_pages") >= min_pages)
    seen = once.select("host", "content", "tokens", "texts", "chars")
    common = seen.select("host", F.explode("texts").alias("token")).groupBy("host", "token").agg(F.count("*").alias("support"))
    common = common.filter(F.col("support") >= min_pages).join(hosts, "host").filter(F.col("support") >= min_share * F.col("host_pages"))
    common = staged(spark, common.groupBy(F.col("host").alias("c_host")).agg(F.collect_set("token").alias("common")), "common")
    counting = seen.join(common, F.col("host") == F.col("c_host"), "left").select("host", "content", "tokens", "texts", "chars", "common")
    counting = counting.mapInArrow(_counting, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seen.select("host", "content", "tokens").schema))
    counting = staged(spark, counting, "counting")
    hosts = counting.groupBy("host").agg(F.count("*").alias("host_pages")).filter(F.col("host_pages") >= min_pages)
    hosts = staged(spark, hosts, "hosts")
    least = F.greatest(F.lit(float(min_pages)), min_share * F.col("host_pages"))
    tokens = staged(spark, _classes(counting, hosts, least), "tokens")
    return _of_valid(tokens, tokens.filter("not is_tag")).groupBy("host").agg(F.collect_set("token").alias("texts"))


def template_tags(spark: SparkSession, once: DataFrame) -> DataFrame:
    """``host, tags, shared``: paths of the elements of each host's template, and whether it has several pages."""
    counted = once.select("host", "content", F.filter("tokens", lambda t: t.is_tag).alias("tokens"))
    hosts = once.groupBy("host").agg(F.count("*").alias("host_pages"))
    tokens = staged(spark, _classes(counted, hosts, TAG_SHARE * F.col("host_pages")), "tags")
    once_each = _of_valid(tokens, tokens.filter("total = support"))
    return once_each.groupBy("host").agg(F.collect_set("token").alias("tags"), (F.max("host_pages") > 1).alias("shared"))


_SLOT = "host string, node long, parent long, begins boolean, weight long, chars long, linked long"
_SUMS = ("weight", "chars", "linked")


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_SLOT``: what each slot holds, added up over the pages of a batch."""
    for batch in batches:
        total: dict[tuple, list[int]] = {}
        for host, (template,), page in zip(batch.column("host").to_pylist(), _of_host(batch, "tags"), _stored(batch), strict=True):
            for node, parent, begins, *sums in slots_of(page, template):
                key = (host, node, parent, begins)
                total[key] = [a + b for a, b in zip(total.get(key, (0, 0, 0)), sums, strict=True)]
        keys, values = list(total), list(total.values())
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[j] for k in keys], kind) for j, kind in enumerate(kinds)), *(pa.array([v[j] for v in values], pa.int64()) for j in range(3))],
            ["host", "node", "parent", "begins", *_SUMS],
        )


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [chosen([tuple(s.values()) for s in slots]) for slots in batch.column("slots").to_pylist()]
        regions, menus = pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("host"), regions, menus], ["host", "region", "menus"])


def templates(spark: SparkSession, seen: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, tags, region, menus, texts``: each host's template, the element of the article, slots that are menus, template texts."""
    marked = staged(spark, firsts(seen), "firsts")
    once = first_of(seen.drop("block_tokens", "block_texts", "page_id", "url"), marked)
    tags = staged(spark, template_tags(spark, once), "template")
    with_tags = once.join(tags.withColumnRenamed("host", "t_host"), F.col("host") == F.col("t_host")).select("host", *_SHAPE, "tags")
    slots = with_tags.mapInArrow(_slots, _SLOT).groupBy("host", "node", "parent", "begins").agg(*(F.sum(c).alias(c) for c in _SUMS))
    # as many as a page has different elements, at most twice
    trees = slots.groupBy("host").agg(F.collect_list(F.struct("node", "parent", "begins", *_SUMS)).alias("slots"))
    choices = trees.mapInArrow(_choices, "host string, region long, menus array<long>")
    texts = template_texts(spark, once, min_pages, min_share)
    return tags.join(choices, "host", "left").join(texts, "host", "left")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, regions = batch.column("shared").to_pylist(), batch.column("region").to_pylist()
        of_host, pages = _of_host(batch, "tags", "menus", "texts"), _stored(batch, texts=True)
        texts = [
            main_text(page, tags, region or 0, menus if many else set(), common)
            for page, (tags, menus, common), many, region in zip(pages, of_host, shared, regions, strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extracted(spark: SparkSession, pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html)."""
    seen = parsed_pages(spark, pages)
    found = staged(spark, templates(spark, seen, min_pages, min_share).withColumnRenamed("host", "t_host"), "templates")
    stored = (*_SHAPE, "block_tokens", "block_texts")
    rows = seen.select("page_id", "url", "host", *stored).join(found.withColumnRenamed("texts", "t_texts"), F.col("host") == F.col("t_host"), "left")
    rows = rows.select("page_id", "url", "host", *stored, "tags", "shared", "region", "menus", F.col("t_texts").alias("texts"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, read(spark, sf_dir, "pages"))
