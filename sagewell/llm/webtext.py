"""Main text of web pages: site templates are found by counting hashed subtrees per host.

A subtree has two hashes: of its content (names, classes and words), and of its shape (names, classes
and what stands within, without words). Menus, adverts and footers whose words change from page to
page recur in shape; notices and link bars recur in content.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, raw

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
OPAQUE = frozenset("script style textarea title xmp iframe noframes".split())
BLOCK = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the key ends open elements of these names.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Block elements within which an open paragraph of an outer element is out of reach.
SCOPE = frozenset("article aside blockquote body button caption dd div dl dt figure footer form header html li main nav object ol section table td th ul".split())
#: Elements that are never main text.
BOILERPLATE = frozenset("nav footer aside form script style noscript template iframe button select textarea svg dialog menu head title object canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar".split())
#: Class and id values that mark what is not main text: as they stand, or compounds of these words only.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification newsletter subscribe signup popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended comment comments commentlist disqus replies widget toolbar pagination pager login".split())
#: Plain text blocks, which are content wherever an article quotes them again.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li td th tr tbody table ul ol dl dt dd b i em strong a span br code figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Templates broadcast at once.
BLOCK_TEMPLATES = 4_000_000
#: A shape with at least this share of the text of its pages is content unless its class says otherwise.
CONTENT_SHARE = 0.25
#: An element that holds this share of the text of its pages is where a host puts its articles.
MAIN_SHARE = 0.5
#: Kinds of counted rows: pages, content hashes, shape hashes, places (paths of names and classes).
PAGE, CONTENT, SHAPE, PLACE = range(4)
#: Kind of a shape that is template within the main element too: mostly links.
LINKS = 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*+)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_OPEN_END = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")
_CLOSE = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in OPAQUE}


class Node:
    """An element; up is its parent, kids its elements and texts. size counts its text, links what of it
    stands in links; hash, shape and place are the hashes of its content, shape and path."""

    __slots__ = ("tag", "attrs", "up", "kids", "size", "links", "hash", "shape", "place")

    def __init__(self, tag: str, attrs: str, up: Node | None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []
        self.size = self.links = self.hash = self.shape = self.place = 0


class Template(NamedTuple):
    """What a host's pages share: hashes of content and shapes, of shapes that are mostly links, and the
    places of articles. counted: the host has pages enough for this to tell."""

    content: frozenset = frozenset()
    shapes: frozenset = frozenset()
    links: frozenset = frozenset()
    places: frozenset = frozenset()
    counted: bool = False


def parse(page: str) -> list[Node]:
    """Elements of a forgiving tree in document order, the root first; character references decoded.

    Work and memory are in proportion to the page at any depth of nesting."""
    root, at, end, last = Node("#page", "", None), 0, len(page), page.rfind(">")
    nodes, stack, unescape, open_tags = [root], [root], html.unescape, Counter()

    def close(i: int):
        for x in stack[i:]:
            open_tags[x.tag] -= 1
        del stack[i:]

    while at < end:
        m = _TOKEN.search(page, at) if at <= last else None
        if m is None and (cut := _OPEN_END.search(page, page.rfind("<", at) if page.rfind("<", at) >= 0 else end)):
            end = cut.start()  # a tag that the end cuts off
        to = m.start() if m else end
        if to > at:
            text = page[at:to]
            stack[-1].kids.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if open_tags[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in ENDS or tag in BLOCK and tag != "br":
            gone = ENDS.get(tag, ()) + (("p",) if tag in BLOCK else ())
            if any(open_tags[x] > 0 for x in gone):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in gone:
                        close(i)
                        break
                    if stack[i].tag in SCOPE:
                        break
        attrs = (m[3] if m[2] else m[6]) or ""
        node = Node(tag, attrs, stack[-1])
        stack[-1].kids.append(node)
        nodes.append(node)
        if tag in OPAQUE:
            done = _CLOSE[tag].search(page, at)
            at = done.end() if done else end
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
            open_tags[tag] += 1
    return nodes


@functools.lru_cache(maxsize=4096)
def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attrs)}


def attributes(node: Node) -> dict[str, str]:
    return _attributes(node.attrs) if node.attrs else {}


def is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or 'role="main"' in node.attrs


def is_never_text(node: Node, inside: bool) -> bool:
    """By the meaning of its name, its role, or as hidden. inside: within the main element."""
    if node.tag in BOILERPLATE or node.tag == "header" and not inside:
        return True
    if not node.attrs or node.tag in ("html", "body"):
        return False
    a = attributes(node)
    return "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in ROLES or re.search(r"display:\s*none", a.get("style", "")) is not None


def is_marked(node: Node, inside: bool) -> bool:
    """By class and id. These never tell of articles, main elements and headings, and ids, which are
    often slugs of titles, never within the main element."""
    if not node.attrs or node.tag in ("html", "body") or node.tag in HEADINGS or is_main(node):
        return False
    a = attributes(node)
    names = (a.get("class", "") + ("" if inside else " " + a.get("id", ""))).lower().split()
    return any(MARKS.issuperset(re.split(r"[-_]+", name)) for name in names)


@functools.lru_cache(maxsize=4096)
def _name(tag: str, attrs: str) -> bytes:
    """Element name with class and id, numbers as one sign."""
    a = _attributes(attrs) if attrs else {}
    return re.sub(r"\d+", "0", f"<{tag}.{' '.join(a.get('class', '').split())}#{a.get('id', '')}").encode("utf-8", "replace")


def measure(nodes: list[Node]) -> None:
    """Sizes and hashes of all subtrees, kept in the nodes."""
    names = [_name(x.tag, x.attrs) for x in nodes]
    for x, name in zip(nodes, names, strict=True):
        x.place = xxhash.xxh64_intdigest(name, x.up.place & 0xFFFFFFFF if x.up else 0)
    for x, name in zip(reversed(nodes), reversed(names), strict=True):  # children stand behind their parent
        h, size, links, shapes = xxhash.xxh64(name), 0, 0, []
        for k in x.kids:
            if isinstance(k, Node):
                h.update(k.hash.to_bytes(8, "little"))
                size += k.size
                links += k.links
                part = k.shape
            elif words := " ".join(k.split()):
                h.update(words.encode("utf-8", "replace"))
                size += len(words)
                part = 1
            else:
                continue
            if not shapes or shapes[-1] != part:  # a run of one shape is one
                shapes.append(part)
        x.size, x.links, x.hash = size, size if x.tag == "a" else links, h.intdigest()
        x.shape = xxhash.xxh64_intdigest(name + b"".join(s.to_bytes(8, "little") for s in shapes))


def _within(nodes: list[Node], chosen) -> set[int]:
    """Ids of the nodes that are chosen or stand within a chosen one."""
    out: set[int] = set()
    for x in nodes:
        if x.up is not None and id(x.up) in out or chosen(x):
            out.add(id(x))
    return out


def counted(nodes: list[Node]) -> list[tuple[int, int, int, int, int]]:
    """A page's rows to be counted: kind, hash, characters, characters in links, elements (places) or
    whether marked (shapes). One row for each kind and hash."""
    inside, page = _within(nodes, is_main), nodes[0].size
    rows: dict[tuple[int, int], list[int]] = {(PAGE, 0): [page, 0, 1]}
    for x in nodes[1:]:
        if not x.size or x.tag in ("html", "body", "head") or x.tag in OPAQUE:
            continue
        within, plain = x.up is not None and id(x.up) in inside, x.tag in PLAIN
        if not (plain and within) and not is_main(x):
            rows.setdefault((CONTENT, x.hash), [0, 0, 0])
        if plain:
            continue
        place = rows.setdefault((PLACE, x.place), [0, 0, 0])
        place[0] += x.size
        place[2] += 1
        if not is_main(x) and (x.attrs or x.tag in BOILERPLATE or x.tag == "header"):
            shape = rows.setdefault((SHAPE, x.shape), [0, 0, int(is_marked(x, within))])
            shape[0] += x.size
            shape[1] += x.links
    return [(kind, h, *row) for (kind, h), row in rows.items()]


def main_text(page: str, template: Template = Template()) -> str:
    """The text left without boilerplate and template subtrees, white space collapsed."""
    nodes = parse(page)
    measure(nodes)
    return text_of(nodes, template)


def text_of(nodes: list[Node], template: Template) -> str:
    """Of a measured page: the text that is neither template nor never text.

    The main elements are those at the host's places of articles (the innermost, or the article or main
    element around), else article and main elements. They are no template, nor what holds them. Within
    them plain blocks stay even where many pages quote them, and shapes count only if mostly links.
    On a host with too few pages to count, marks take the place of templates, and only the outermost
    main elements are read, if there are any.
    """
    placed = {id(x) for x in nodes if x.place in template.places}
    holds = _holding(x for x in nodes if id(x) in placed)
    tops, outer_main = [], {}  # of nodes within or at a main element: the outermost
    for x in nodes:
        if (outer := outer_main.get(id(x.up), x if is_main(x) else None)) is not None:
            outer_main[id(x)] = outer
        if id(x) in placed and id(x) not in holds:
            tops.append(outer_main.get(id(x), x))
    if not tops:
        own = _within(nodes, lambda x: is_never_text(x, False) or not template.counted and is_marked(x, False) and x.size <= nodes[0].size / 2)
        for tag in ("article", "main"):
            tops = tops or [x for x in nodes if id(x) not in own and is_main(x) and (x.tag == "article") == (tag == "article")]
    main = {id(x) for x in tops}
    inside, kept = _within(nodes, lambda x: id(x) in main), main | _holding(tops)
    most, out = nodes[0].size / 2, []

    def goes(x: Node) -> bool:
        within = id(x) in inside
        if is_never_text(x, within):
            return True
        if id(x) in kept or not main and x.size > most:
            return False
        if not template.counted:
            return x.size <= most and is_marked(x, within)
        if x.shape in template.links or not within and x.shape in template.shapes and x.tag not in PLAIN:
            return True
        return x.hash in template.content and not (within and x.tag in PLAIN)

    starts = [nodes[0]]
    if main and not template.counted:
        starts = [x for x in tops if id(x.up) not in inside]
    for start in starts:
        todo: list = [" ", start]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x is start or not goes(x):
                block = x.tag in BLOCK
                todo += [" "] * block + x.kids[::-1]
                out += [" "] * block
            elif x.tag in BLOCK:
                out.append(" ")
    return " ".join("".join(out).split())


def _holding(nodes) -> set[int]:
    """Ids of the elements around these."""
    out: set[int] = set()
    for x in nodes:
        while (x := x.up) is not None and id(x) not in out:
            out.add(id(x))
    return out


def least_pages(pages: int, min_pages: int = 5, share: float = 0.1) -> float:
    """On how many of a host's distinct pages a template stands at least: min_pages, and beyond the
    size of which they are that share, more by the logarithm of the host only (60 of 3 million)."""
    return min_pages * (1 + math.log(max(pages * share / min_pages, 1)))


_COUNTS = "host string, root bigint, kind tinyint, hash bigint, chars bigint, links bigint, more bigint, page bigint"


def _signed(values) -> pa.Array:
    return pa.array([h - (h >> 63 << 64) for h in values], pa.int64())


def site_templates(read: DataFrame, min_pages: int = 5, share: float = 0.1) -> DataFrame:
    """Rows (host, kind, hash) of what a host's pages share; kind PAGE for a host with pages enough.

    read has host and html. Pages with one root hash count once, so copies of a page make no template
    of it. CONTENT: as many distinct pages as least_pages() asks hold the subtree. SHAPE: they hold one
    of this shape, which is named by an element, class or id of its own, and it has less than
    CONTENT_SHARE of their text or is marked; LINKS if over half of it is links. PLACE: once a page on
    average (1.2 times at most), with MAIN_SHARE of the text of its pages.
    """

    def rows(batch):
        seen: set[tuple[str, int]] = set()
        columns: list[list] = [[] for _ in range(8)]
        for host, page in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
            nodes = parse(page.decode("utf-8", "replace"))
            measure(nodes)
            if (host, nodes[0].hash) in seen:
                continue
            seen.add((host, nodes[0].hash))
            for row in counted(nodes):
                for column, value in zip(columns, (host, nodes[0].hash, *row, nodes[0].size), strict=True):
                    column.append(value)
        host, root, kind, h, *numbers = columns
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), _signed(root), pa.array(kind, pa.int8()), _signed(h), *(pa.array(x, pa.int64()) for x in numbers)], names=[x.split()[0] for x in _COUNTS.split(", ")])

    distinct = map_arrow(read.select("host", "html"), rows, _COUNTS).distinct()
    sums = distinct.groupBy("host", "kind", "hash").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("chars", "links", "more", "page")))
    sums = materialise(sums.where((F.col("n") >= min_pages) | (F.col("kind") == PAGE)), "subtrees")
    per_host = sums.where(F.col("kind") == PAGE).select("host", F.col("n").alias("pages"))
    ratio = F.greatest(F.col("pages") * share / min_pages, F.lit(1.0))
    # the join stands between plain exchanges, so adaptive execution can split a hot host's rows
    often = sums.where(F.col("kind") != PAGE).join(per_host, "host").where((F.col("n") >= min_pages * (1 + F.log(ratio))) & (F.col("pages") >= 2 * min_pages))
    small = (F.col("chars") < CONTENT_SHARE * F.col("page")) | (F.col("more") * 2 >= F.col("n"))
    kind = (
        F.when(F.col("kind") == CONTENT, CONTENT)
        .when((F.col("kind") == SHAPE) & (F.col("links") * 2 > F.col("chars")), LINKS)
        .when((F.col("kind") == SHAPE) & small, SHAPE)
        .when((F.col("kind") == PLACE) & (F.col("chars") >= MAIN_SHARE * F.col("page")) & (F.col("more") <= 1.2 * F.col("n")), PLACE)
    )
    found = often.select("host", kind.cast("tinyint").alias("kind"), "hash").where("kind is not null")
    return found.union(per_host.where(F.col("pages") >= 2 * min_pages).select("host", F.lit(PAGE).cast("tinyint"), F.lit(0).cast("bigint")))


def _own(nodes: list[Node], kept: dict[int, np.ndarray] | None) -> Template:
    """Of a host's sorted hashes by kind, those that a page has."""
    if kept is None:
        return Template()

    def having(kind: int, values) -> frozenset:
        table = kept.get(kind)
        if table is None:
            return frozenset()
        hashes = np.fromiter(values, np.uint64, len(nodes))
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return frozenset(hashes[table[at] == hashes].tolist())

    shapes = [x.shape for x in nodes]
    return Template(having(CONTENT, (x.hash for x in nodes)), having(SHAPE, shapes), having(LINKS, shapes), having(PLACE, (x.place for x in nodes)), True)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 5, share: float = 0.1) -> DataFrame:
    """The article of every page, without what its site repeats.

    First pass: each page's element subtrees are hashed, by content and by shape, and counted per host
    over distinct pages (site_templates). Second pass: each block of hosts with their templates is
    broadcast, so pages aren't shuffled or weighed by their host, and each page deletes its own template
    subtrees; main elements and plain blocks within them are none (text_of). Hosts are dealt to blocks
    of about BLOCK_TEMPLATES templates (8 bytes each), mostly one; of several, each is written before
    the next. Scripts, styles, forms, and what names, roles or hiding call navigation, footers or asides
    go on any page. Class and id words decide only on hosts with fewer than 2 * min_pages distinct
    pages, which are too few to count.

    Null html is empty, null or relative urls share the empty host, malformed and cut-off markup is
    read as far as it goes at any depth, repeated pages come back each, an empty table gives no rows,
    other columns are ignored. Returns page_id, url, text, n_chars.
    """
    kind = dict(pages.dtypes)[id_col]
    authority = F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"([^@]*)$", 1))
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    frequent = materialise(site_templates(read, min_pages, share), "templates")
    blocks = max(1, math.ceil(frequent.count() / BLOCK_TEMPLATES))
    block = lambda k: F.pmod(F.xxhash64("host"), F.lit(blocks)) == k

    def texts_with(shared):
        def texts(batch):
            out = []
            for host, page in zip(batch.column(3).to_pylist(), raw(batch.column(2)), strict=True):
                nodes = parse(page.decode("utf-8", "replace"))
                measure(nodes)
                out.append(text_of(nodes, _own(nodes, shared.value.get(host))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return texts

    done = None
    for k in range(blocks):
        lists = frequent.where(block(k)).groupBy("host", "kind").agg(F.collect_list("hash").alias("hashes"))
        template: dict[str, dict[int, np.ndarray]] = {}
        for r in lists.toLocalIterator():
            template.setdefault(r["host"], {})[r["kind"]] = np.sort(np.array(r["hashes"], np.int64).view(np.uint64))
        shared = pages.sparkSession.sparkContext.broadcast(template)
        part = map_arrow(read.where(block(k)), texts_with(shared), f"page_id {kind}, url string, text string, n_chars bigint")
        if blocks > 1:
            part = materialise(part, "texts")
            shared.destroy()
        done = part if done is None else done.union(part)
    return done
