"""Main text of web pages, with site templates removed.

Spark counts, for each host, on how many different pages every element subtree
occurs; subtrees on ``LEAST_PAGES`` pages of a host are a template of it and go. A
subtree is counted by two hashes: its *wording* (tags, names and text) and, outside
the page's main part, its *shape* (tags, names and the order of children, with texts
masked and repeated children folded), so that a menu or an advert with changing words
recurs, too; but never by shape alone if a run of ``PROSE`` characters stands in it, as
articles of a site are shaped alike. A name is an element's class, id or role. The
number of pages doesn't grow with the host, so a section's template counts on a large
host, too; only a text block inside a marked article must be on ``INSIDE_SHARE`` of the
host's pages, since articles quote and copy one another.

What no count can tell is judged by the page alone, on hosts of every size alike:
elements that are never text (scripts, forms, ``nav``, ``footer`` and the like) go by
their tag, adverts, notices and comments by their names, and beside a marked article
(or more of them) only parts with a run of prose stay, such as its continuation.

Two passes parse the pages: the first sends out only hashes, the second gets the
template hashes.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import arrays as A
from assayer.llm.shared import keep
from assayer.llm.urls import host_of

#: A template is on so many different pages of its host.
LEAST_PAGES = 5
#: A text block inside a marked article is template only if it is on such a part of its host's different pages.
INSIDE_SHARE = 0.5
#: Characters of a run of text outside links that no menu has.
PROSE = 80
#: Characters of such a run that a part beside a marked article must have.
BESIDE = 80
#: Seeds that keep hashes of shapes, of text blocks in articles and of hosts themselves apart.
WORDING, SHAPE, INSIDE, HOST = 0, 1, 2, 3
#: Template hashes of all hosts are sent to tasks up to so many (8 MB); beyond, each page is joined with its own ones by shuffle.
BROADCAST_HASHES = 1_000_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
DROPPED = frozenset("head title nav footer aside form script style noscript iframe button select option input textarea dialog menu template svg canvas object embed noembed noframes math audio video map label fieldset datalist".split())
BLOCKS = frozenset("html body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table caption thead tbody tfoot tr section article main header footer blockquote pre figure figcaption address details summary hr hgroup center".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd td th tr figcaption b i em strong a span code br".split())
INLINE = frozenset("b i em strong a span code br".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Elements that may be told by shape without a name of their own.
SECTIONS = frozenset("nav footer aside header menu ul ol dl table form dialog section".split())
#: Parts of class names and ids, and roles, that mark boilerplate where templates can't.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sidebar cookie cookies consent notice notices comment comments share sharing social related recommended promo promotion newsletter subscribe subscription breadcrumb breadcrumbs menu nav navbar navigation footer masthead topbar popup modal overlay sponsor sponsored disqus pager pagination widget skip login signup".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_WORD = re.compile(r"\w")
_DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "attrs", "children", "length", "known", "flow", "longest")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.children, self.length, self.known, self.flow, self.longest = tag, attrs, [], 0, None, 0, 0


def parse(page: str) -> Node:
    """The elements of a page; badly closed ones end where HTML would end them, by and large."""
    root = Node("#root")
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break
            continue
        if tag in BLOCKS:  # a block ends an open paragraph and what is open in it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS or stack[i].tag in ("td", "th"):
                    break
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE.get(tag, ()):
                    break
        node = Node(tag, m[3] or "")
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if tag not in DROPPED:
                node.children.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not node.attrs.endswith("/"):
            stack.append(node)
    return root


def attributes(node: Node) -> dict[str, str]:
    if node.known is None:
        node.known = {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(node.attrs)} if node.attrs else {}
    return node.known


def is_boilerplate(node: Node, inside: bool) -> bool:
    """By tag, role, class or visibility. ``inside``: it is in the article, whose own header stays."""
    if node.tag in DROPPED or node.tag == "header" and not inside:
        return True
    if not node.attrs or node.tag in ("html", "body", "article", "main"):
        return "comment" in node.attrs.lower() and node.tag == "article" and bool(MARKS & set(_SPLIT.split(" ".join(v.lower() for k, v in attributes(node).items() if k in ("class", "id")))))
    a = attributes(node)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    marks = set(_SPLIT.split(f"{a.get('class', '')} {a.get('id', '')}".lower()))
    return bool(MARKS & marks) or "header" in marks and not inside


def measure(node: Node) -> int:
    """Characters of text below each node that isn't boilerplate, and its longest run of text outside links, kept in the nodes."""
    order, stack = [], [node]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.children if isinstance(c, Node)]
    for x in reversed(order):
        boilerplate = x is not node and is_boilerplate(x, True)
        x.length = 0 if boilerplate else sum(c.length if isinstance(c, Node) else len(c.strip()) for c in x.children)
        # text of inline elements runs on with the text around them
        x.flow = 0 if boilerplate or x.tag == "a" else sum(len(c.strip()) if isinstance(c, str) else c.flow if c.tag in INLINE else 0 for c in x.children)
        x.longest = max([x.flow, *(c.longest for c in x.children if isinstance(c, Node))]) if not boilerplate else 0
    return node.length


def article_of(root: Node) -> Node | None:
    """The outermost article with most text, else the main element; none if the page marks neither."""
    measure(root)
    found: dict[str, list[Node]] = {"article": [], "main": []}
    stack = [root]
    while stack:
        x = stack.pop()
        if x is not root and is_boilerplate(x, False):
            continue
        if x.tag == "article":
            found["article"].append(x)
            continue
        if x.tag == "main" or "main" in x.attrs and attributes(x).get("role") == "main":
            found["main"].append(x)
        stack += [c for c in reversed(x.children) if isinstance(c, Node)]
    for kind in found.values():
        if kind:
            return max(kind, key=lambda n: n.length)
    return None


def main_of(root: Node) -> tuple[Node, bool]:
    """The page's main part, and whether the page marks it; else the smallest container with over half of the text."""
    marked = article_of(root)
    if marked:
        return marked, True
    at = root  # article_of has measured all nodes
    while True:
        inner = [c for c in at.children if isinstance(c, Node) and c.tag not in TEXT_BLOCKS and c.length > at.length / 2]
        if not inner:
            return at, False
        at = inner[0]


def name_of(node: Node) -> str:
    """Class, id and role, with digits masked."""
    if not node.attrs:
        return ""
    a = attributes(node)
    return _DIGITS.sub("#", " ".join(f"{k}={' '.join(sorted(a[k].lower().split()))}" for k in ("class", "id", "role") if a.get(k)))


def subtree_hashes(root: Node) -> list[tuple[Node, int, int, bool]]:
    """Each element subtree with text, with 64-bit hashes of its wording and of its shape, and whether it has a headline."""
    order, stack, known = [], [root], {}
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.children if isinstance(c, Node)]
    for x in reversed(order):
        name = f"{x.tag} {name_of(x)}".encode("utf-8", "replace")
        wording, shape, text, head = [name], [name], False, x.tag == "h1"
        for c in x.children:
            if isinstance(c, Node):
                w, s, t, h = known[id(c)]
                wording.append(w)
                text |= t
                head |= h
            elif c.strip():
                wording.append(b"t" + " ".join(c.split()).encode("utf-8", "replace"))
                s, text = b"t", True
            else:
                continue
            if shape[-1] != s or len(shape) == 1:
                shape.append(s)
        known[id(x)] = blake2b(b"\0".join(wording), digest_size=8).digest(), blake2b(b"\0".join(shape), digest_size=8).digest(), text, head
    number = lambda d: int.from_bytes(d, "little")
    return [(x, number(known[id(x)][0]), number(known[id(x)][1]), known[id(x)][3]) for x in order if known[id(x)][2] and x.tag not in ("#root", "html", "body", "article", "main")]


def blocks_of(node: Node, dropped: Callable[[Node], bool]) -> list[str]:
    """Text blocks below ``node`` in page order, without elements that are ``dropped``."""
    out, line = [], []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    stack: list[tuple[object, bool]] = [(node, False)]
    while stack:
        x, over = stack.pop()
        if isinstance(x, str):
            line.append(entities.unescape(x))
        elif over:
            flush()
        elif x is node or not dropped(x):
            if x.tag in BLOCKS:
                flush()
                stack.append((x, True))
            elif x.tag in ("br", "td", "th"):
                line.append(" ")
            stack += [(c, False) for c in reversed(x.children)]
    flush()
    return out


def host_key(host: str, kind: int) -> np.uint64:
    return np.frombuffer(blake2b(f"{kind} {host}".encode("utf-8", "replace"), digest_size=8).digest(), np.uint64)[0]


def _above(root: Node, main: Node) -> set[int]:
    """The elements that ``main`` lies in."""
    stack: list[tuple[Node, tuple[int, ...]]] = [(root, ())]
    while stack:
        x, path = stack.pop()
        if x is main:
            return set(path)
        stack += [(c, (*path, id(x))) for c in x.children if isinstance(c, Node)]
    return set()


def template_parts(root: Node, main: Node, marked: bool, host: str) -> tuple[np.ndarray, np.ndarray, list[Node]]:
    """Hashes of the subtrees that may be template, their kinds, and the subtrees. Hashes differ from host to host and kind to kind.

    Inline elements in running text never are, as their loss would break a
    sentence; they go with a block around them. Shapes count only outside the
    main part, for elements with a name or of ``SECTIONS``, without a headline or
    a run of prose.
    """
    within, above = _within(main), _above(root, main)
    running: set[int] = set()
    stack = [root]
    while stack:
        x = stack.pop()
        inner = [c for c in x.children if isinstance(c, Node)]
        if any(c.tag in INLINE for c in inner) and any(isinstance(c, str) and _WORD.search(c) for c in x.children):
            running.update(id(c) for c in inner if c.tag in INLINE)
        stack += inner
    hashes, kinds, parts = [], [], []
    for x, wording, shape, head in subtree_hashes(root):
        if id(x) in running or x is main:
            continue
        inside = id(x) in within
        hashes.append(wording)
        kinds.append(INSIDE if marked and inside and x.tag in TEXT_BLOCKS else WORDING)
        parts.append(x)
        if not inside and not head and x.longest < PROSE and id(x) not in above and (x.tag in SECTIONS or name_of(x)):
            hashes.append(shape)
            kinds.append(SHAPE)
            parts.append(x)
    kind = np.array(kinds, np.int64)
    keys = np.array([host_key(host, k) for k in (WORDING, SHAPE, INSIDE)], np.uint64)
    return A.mix(np.array(hashes, np.uint64) ^ keys[kind]), kind, parts


def main_text(page: str | None, host: str = "", template: np.ndarray | None = None) -> str:
    """The main text of one page; ``template`` has template hashes (ascending), of its host at least."""
    if not page:
        return ""
    root = parse(page)
    main, marked = main_of(root)
    gone: set[int] = set()
    if template is not None and len(template):
        hashes, _, parts = template_parts(root, main, marked, host)
        gone = {id(parts[k]) for k in np.flatnonzero(A.member(hashes, template)).tolist()}
    return "\n".join(blocks_of(root, _dropped(root, main, marked, gone)))


def _dropped(root: Node, main: Node, marked: bool, gone: set[int]) -> Callable[[Node], bool]:
    """Whether an element goes: as template, by tag or name, or as a part beside a marked article that has no run of prose."""
    within, above = _within(main), _above(root, main)
    beside: set[int] = set()
    if marked:
        stack = [root]
        while stack:
            x = stack.pop()
            if id(x) not in above:
                continue
            # text that stands in no element of its own is judged like one
            x.children = [c for c in x.children if isinstance(c, Node) or len(c.strip()) >= BESIDE]
            beside.update(id(c) for c in x.children if isinstance(c, Node) and id(c) not in above and c is not main and c.longest < BESIDE)
            stack += [c for c in x.children if isinstance(c, Node)]
    return lambda x: id(x) not in above and (id(x) in gone or id(x) in beside or is_boilerplate(x, id(x) in within))


def _within(article: Node) -> set[int]:
    seen, stack = set(), [article]
    while stack:
        x = stack.pop()
        seen.add(id(x))
        stack += [c for c in x.children if isinstance(c, Node)]
    return seen


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, contents, hosts, hashes, kinds = [], [], [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for host, page, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if page:
                root = parse(page)
                main, marked = main_of(root)
                found, kind, _ = template_parts(root, main, marked, host)
                text = "\n".join(blocks_of(main if marked else root, lambda x: is_boilerplate(x, marked)))  # noqa: B023
                content = int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
                found, first = np.unique(np.r_[found, host_key(host, HOST)], return_index=True)
                pages += [key] * len(found)
                contents += [content] * len(found)
                hosts += [host_key(host, HOST)] * len(found)
                hashes.append(found)
                kinds.append(np.r_[kind, HOST][first])
        columns = [pa.array(pages, pa.int64()), pa.array(contents, pa.int64()), pa.array(np.array(hosts, np.uint64).view(np.int64)), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(kinds).astype(np.int8))]
        yield pa.RecordBatch.from_arrays(columns, names=["page", "content", "host", "hash", "kind"])


def _subtrees(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    host = host_of(F.col(url_col))
    rows = pages.where(F.col(html_col).isNotNull()).select(host.alias("host"), F.col(html_col).alias("html"), F.xxhash64(host, F.col(html_col)).alias("page"))
    return rows.mapInArrow(_hash_batches, "page long, content long, host long, hash long, kind byte")


def recurring(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """Subtrees, and hosts themselves (kind ``HOST``), with ``n`` different pages, ``least_pages`` or more.

    Pages with the same main text are one page, so mirrored articles make no
    template. Counting is by hash, not by host: a hot host is many keys.
    """
    seen = _subtrees(pages, url_col, html_col).select("content", "host", "hash", "kind").distinct()
    return keep(seen.groupBy("hash", "host", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages), "counted")


def site_templates(counted: DataFrame, inside_share: float = INSIDE_SHARE) -> DataFrame:
    """``hash`` of each template subtree among the ``recurring`` ones; the host and the kind are part of the hash."""
    hosts = counted.where(F.col("kind") == HOST).select("host", F.col("n").alias("pages"))
    inside = counted.where(F.col("kind") == INSIDE).join(hosts, "host").where(F.col("n") >= inside_share * F.col("pages"))
    return counted.where(F.col("kind").isin(WORDING, SHAPE)).select("hash").unionByName(inside.select("hash"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url`` and main ``text`` of every page, a row each, from its whole HTML.

    White space in a block is one space, blocks are joined by one ``\\n``. Null
    or empty HTML gives an empty text; null or odd URLs share the empty host;
    repeated rows stay and count as one page; an empty table gives an empty result.
    Only id, URL and HTML are read, so other columns' names don't matter. A page of
    any length is parsed whole, one at a time, at about 200 bytes an element.
    """
    known = keep(site_templates(recurring(pages, url_col, html_col)), "site_templates")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    everywhere = None
    if known.count() <= BROADCAST_HASHES:
        everywhere = np.sort(known.toArrow()["hash"].to_numpy().view(np.uint64))
        rows = rows.withColumn("template", F.lit(None).cast("array<long>"))
    else:
        own = _subtrees(pages, url_col, html_col).select("page", "hash").distinct().join(known, "hash")
        rows = rows.withColumn("page", F.xxhash64("host", "html")).join(own.groupBy("page").agg(F.collect_list("hash").alias("template")), "page", "left")
    rows = rows.select("page_id", "url", "html", "host", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, host, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                texts.append(main_text(page, host, everywhere if everywhere is not None else np.sort(np.array(own.as_py() or [], np.int64).view(np.uint64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")
