"""Main text of web pages by wrapper induction.

1. Every page is parsed to a light tree of block elements. Its skeleton (tags,
   class words, runs of equal siblings folded into one node) is counted per
   host; a host's most frequent skeleton is its wrapper tree.
2. Every page is aligned with the wrapper tree of its host by simple tree
   matching. The texts met at a wrapper node are counted over the distinct
   pages of the host (by main text: copies count once): a text that a node has
   nearly everywhere is template there, and what differs from it is content.
3. A page's main text is what its slots hold inside the content region
   (``article`` or ``main``, else the body), without navigation, headers and
   footers of the page, sidebars, notices, adverts, forms, comments and blocks
   that are mostly links. Names (class, id, role) only decide on minor parts: a
   named part that holds the region or most of its text stays, comments only if
   nothing else is left; whether it is template is for the wrapper to say.

Wrapper trees and template nodes are joined to the pages by host; they are a
few hundred bytes a host, and Spark chooses the kind of join by their size.
Texts are summed per task before they are shuffled, so a hot host costs no
more rows than others.

Defined results: null html is empty and gives the empty text; a null or broken
url belongs to the host ""; repeated rows and null ids stay rows; pages of a
host with fewer than ``MIN_PAGES`` distinct pages have no template nodes. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptlens.llm.common import stored, table, text_batches

MIN_PAGES, CONSTANT_SHARE, LINK_SHARE = 5, 0.9, 0.5
#: What is nested deeper belongs to the element at this depth.
DEEPEST = 150

# Element kinds and words that name parts of a page.
BLOCKS = frozenset(
    "html body head main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table "
    "thead tbody tfoot tr td th caption form fieldset blockquote pre figure figcaption address hr details summary "
    "dialog noscript iframe object svg select button template video audio canvas center".split())
VOID = frozenset("hr".split())
NEVER = frozenset(
    "head nav footer aside noscript iframe object svg select button template dialog video audio canvas".split())
PARTS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments "
    "disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login search widget pagination pager toolbar copyright".split())
#: Words that may stand beside those of PARTS in one class or id.
SHAPES = frozenset("area bar block box button buttons container group inner item links list outer panel section widget wrapper".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
FORMS = frozenset("form fieldset".split())
#: Never left out by name; ids of ANCHORS are link targets.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ANCHORS = HEADINGS | frozenset("section p li dt dd td th".split())
PAGE_HEADS = frozenset("header masthead topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())
REGIONS = frozenset("article main".split())
#: Open elements that a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LISTS = frozenset("ul ol dl table".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title)\b.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*>", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    """A block element: ``items`` are texts, (text,) of a link, and nodes."""

    __slots__ = ("tag", "words", "names", "role", "items", "key")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.items, self.words, self.names, self.role = tag, [], frozenset(), frozenset(), ""
        if "=" in attrs:
            words, names = set(), set()
            for name, a, b, c in _ATTR.findall(attrs):
                value = (a or b or c).lower()
                if name.lower() == "role":
                    self.role = value
                words.update(_WORD.findall(value))
                if name.lower() in ("class", "itemprop") or name.lower() == "id" and tag not in ANCHORS:
                    names.update(value.split())
            self.words, self.names = frozenset(words), frozenset(names)
        self.key = f"{tag}.{'.'.join(sorted(self.words))}" if self.words else tag


def parse(text: str) -> Node:
    root = Node("html")
    stack, link, at = [root], False, 0
    for m in _TOKEN.finditer(text):
        if m.start() > at:
            piece = text[at:m.start()]
            stack[-1].items.append((piece,) if link else piece)
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        end = bool(m["end"] or m["end2"])
        if tag == "a":
            link = not end
        elif tag == "br":
            stack[-1].items.append(" ")
        if tag not in BLOCKS or tag == "html":
            continue
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            else:  # it closes nothing, but what follows is another block
                stack[-1].items.append(Node(tag))
            continue
        link = False
        if stack[-1].tag == "p":
            stack.pop()
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in LISTS:
                    break
        node = Node(tag, m["attrs"] or "")
        stack[-1].items.append(node)
        if tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)
    if at < len(text):
        stack[-1].items.append(text[at:])
    return root


# -- skeletons and their alignment ---------------------------------------------

def skeleton(nodes: list[Node]) -> list:
    """[key, children] of a run of equal siblings; runs are folded."""
    kids: dict[str, list[Node]] = {}
    for n in nodes:
        for item in n.items:
            if isinstance(item, Node):
                kids.setdefault(item.key, []).append(item)
    return [nodes[0].key, [skeleton(run) for run in kids.values()]]


def tree_match(a: list, b: list, memo: dict | None = None) -> tuple[int, list]:
    """Simple tree matching: the size of the largest mapping of two ordered
    trees that keeps roots, order and parents, and the pairs of children of
    each matched pair, as (pair of trees, their pairs)."""
    memo = {} if memo is None else memo
    known = memo.get((id(a), id(b)))
    if known is not None:
        return known
    if a[0] != b[0]:
        memo[id(a), id(b)] = (0, [])
        return 0, []
    m, n = len(a[1]), len(b[1])
    best = [[0] * (n + 1) for _ in range(m + 1)]
    inner = {}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            inner[i, j] = tree_match(a[1][i - 1], b[1][j - 1], memo)
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + inner[i, j][0])
    pairs, i, j = [], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.append((a[1][i - 1], b[1][j - 1], inner[i, j][1]))
            i, j = i - 1, j - 1
    out = (best[m][n] + 1, pairs[::-1])
    memo[id(a), id(b)] = out
    return out


def _paths(tree: list, at: tuple = ()) -> dict[int, tuple]:
    out = {id(tree): at}
    for i, kid in enumerate(tree[1]):
        out |= _paths(kid, (*at, i))
    return out


@lru_cache(maxsize=4096)
def alignment(page: str, wrapper: str) -> dict[tuple, int]:
    """Key path of a page's skeleton -> number of the wrapper node (in
    preorder) that it is matched with."""
    a, b = json.loads(page), json.loads(wrapper)
    number = {path: i for i, path in enumerate(_paths(b).values())}
    places = _paths(b)
    out: dict[tuple, int] = {}

    def walk(pairs: list, keys: tuple) -> None:
        for x, y, inner in pairs:
            here = (*keys, x[0])
            out[here] = number[places[id(y)]]
            walk(inner, here)

    size, pairs = tree_match(a, b)
    if size:
        out[(a[0],)] = 0
        walk(pairs, (a[0],))
    return out


# -- text ----------------------------------------------------------------------

def _clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def _boilerplate(node: Node, inside: bool) -> bool:
    """By its kind; html, body, regions and headings never are."""
    if _kept(node):
        return False
    if node.tag in NEVER or node.role in ROLES:
        return True
    return not inside and (node.tag == "header" or bool(node.names & PAGE_HEADS))


def _kept(node: Node) -> bool:
    return node.tag in REGIONS or node.tag in HEADINGS or node.tag in ("html", "body") or node.role in REGIONS


@lru_cache(maxsize=65536)
def _part_words(name: str) -> frozenset:
    """Words of PARTS in a class or id that has no words but such and SHAPES."""
    words = frozenset(_WORD.findall(name))
    return words & PARTS if words <= PARTS | SHAPES else frozenset()


def _named(node: Node) -> bool:
    """A part by its name, unless it holds most text."""
    if _kept(node):
        return False
    return node.tag in FORMS or node.role == "form" or any(map(_part_words, node.names))


def blocks(node: Node, keys: tuple, inside: bool, stays: set | None = None):
    """(key path, text, letters in links) of the blocks of content below; of
    named parts all, or those in ``stays`` (by id)."""
    parts, linked = [], 0
    for item in node.items:
        if isinstance(item, Node):
            if text := _clean(parts):
                yield keys, text, linked
            parts, linked = [], 0
            if not _boilerplate(item, inside) and (stays is None or id(item) in stays or not _named(item)):
                yield from blocks(item, (*keys, item.key), inside, stays)
        elif isinstance(item, tuple):
            parts.append(item[0])
            linked += len(_clean([item[0]]))
        else:
            parts.append(item)
    if text := _clean(parts):
        yield keys, text, linked


def _letters(node: Node, inside: bool, stays: set | None = None) -> int:
    return sum(len(text) for _, text, _ in blocks(node, (), inside, stays))


def _parts(node: Node, inside: bool):
    """Outermost named parts."""
    for item in node.items:
        if isinstance(item, Node) and not _boilerplate(item, inside):
            if _named(item):
                yield item
            else:
                yield from _parts(item, inside)


def _prose(node: Node, inside: bool) -> int:
    """Letters of paragraphs below."""
    return sum(_letters(item, inside) if item.tag == "p" else _prose(item, inside)
               for item in node.items if isinstance(item, Node) and not _boilerplate(item, inside))


def _staying(node: Node, inside: bool) -> set:
    """Named parts below that hold more than half of the text and are what they
    are called by mistake: they hold a region, or paragraphs for the most part.
    A page that has nothing but a form, a sidebar or comments has no text."""
    stays, at = set(), node
    while at is not None:
        found, whole, at = list(_parts(at, inside)), _letters(at, inside), None
        for part in found:
            comments = any(_part_words(name) & COMMENTS for name in part.names)
            most = not comments and 2 * _letters(part, inside) > whole
            if most and (next(_regions(part, (), True), None) or 2 * _prose(part, inside) > _letters(part, inside)):
                stays.add(id(part))
                at = part
    return stays


def _regions(node: Node, keys: tuple, named: bool = False):
    """Outermost content regions that are in no boilerplate, and in no named
    part unless ``named``."""
    for item in node.items:
        if isinstance(item, Node) and not _boilerplate(item, False) and (named or not _named(item)):
            here = (*keys, item.key)
            if item.tag in REGIONS or item.role in REGIONS:
                yield item, here
            else:
                yield from _regions(item, here, named)


def _region(root: Node) -> tuple[Node, tuple, bool]:
    """The content region: of several the one with most text, an article in it
    if that holds most of its text; else the whole page. A region in a named
    part counts if there is no other and it holds most text of the page."""
    node, keys, inside = root, (root.key,), False
    while True:
        outer = list(_regions(node, keys))
        regions = outer or ([] if inside else list(_regions(node, keys, True)))
        found = [(_letters(n, True, set()), _letters(n, True), -i, n, k) for i, (n, k) in enumerate(regions)]
        if not found:
            return node, keys, inside
        most, all_, _, n, k = max(found, key=lambda x: x[:3])
        if inside and 2 * most < _letters(node, True, set()) or not outer and 2 * all_ < _letters(node, False):
            return node, keys, inside
        node, keys, inside = n, k, True


def main_text(root: Node, template: frozenset = frozenset()) -> str:
    """Blocks of the content region, without those whose key path is template;
    outside a marked region also without blocks that are mostly links."""
    node, keys, inside = _region(root)
    return "\n\n".join(text for path, text, linked in blocks(node, keys, inside, _staying(node, inside))
                       if path not in template and (inside or linked <= LINK_SHARE * len(text)))


# -- Spark ---------------------------------------------------------------------

def _dumped(root: Node) -> str:
    return json.dumps(skeleton([root]), separators=(",", ":"), ensure_ascii=False)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=8).digest()


def _node_texts(root: Node, place: dict[tuple, int]) -> dict[int, bytes]:
    """Digest of all text that a page has at each wrapper node."""
    held: dict[int, list[str]] = {}
    for keys, block, _ in blocks(root, (root.key,), True):
        if keys in place:
            held.setdefault(place[keys], []).append(block)
    return {node: _digest("\n".join(parts)) for node, parts in held.items()}


def induce(pages: DataFrame) -> DataFrame:
    """``pages`` (host, html) -> host, wrapper (skeleton), template (node and
    text of its constant nodes). Pages with one main text count once."""

    def shapes(batches):
        for batch in batches:
            found = set()
            for host, text in zip(batch.column("host").to_pylist(), batch.column("html")):
                root = parse(text.as_py() or "")
                found.add((host, _dumped(root), _digest(main_text(root))))
            yield pa.RecordBatch.from_pydict({
                "host": pa.array([f[0] for f in found], pa.string()), "wrapper": pa.array([f[1] for f in found], pa.string()),
                "page": pa.array([f[2] for f in found], pa.binary())})

    seen = pages.select("host", "html").mapInArrow(shapes, "host string, wrapper string, page binary").distinct()
    seen = seen.groupBy("host", "wrapper").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "wrapper"))
    trees = stored(seen.withColumn("rank", rank).filter("rank = 1").select("host", "wrapper"), "wrappers")

    def texts(batches):
        for batch in batches:
            found = set()
            for host, text, tree in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("wrapper").to_pylist()):
                root = parse(text.as_py() or "")
                page = _digest(main_text(root))
                found.update((host, page, *x) for x in _node_texts(root, alignment(_dumped(root), tree)).items())
            keys = list(found)
            yield pa.RecordBatch.from_pydict({
                "host": pa.array([k[0] for k in keys], pa.string()), "page": pa.array([k[1] for k in keys], pa.binary()),
                "node": pa.array([k[2] for k in keys], pa.int32()), "text": pa.array([k[3] for k in keys], pa.binary())})

    met = pages.select("host", "html").join(trees, "host").mapInArrow(texts, "host string, page binary, node int, text binary")
    once = met.groupBy("host", "page", "node").agg(F.min("text").alias("text"))
    constant = (once.groupBy("host", "node", "text").agg(F.count("*").alias("n")).groupBy("host", "node")
                .agg(F.max(F.struct("n", "text")).alias("most"), F.sum("n").alias("all"))
                .filter((F.col("all") >= MIN_PAGES) & (F.col("most.n") >= CONSTANT_SHARE * F.col("all"))))
    # nodes of one wrapper: bounded by its own skeleton
    constant = constant.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", F.col("most.text").alias("text")))).alias("template"))
    return stored(trees.join(constant, "host", "left"), "host-wrappers")


def extract(pages: DataFrame, wrappers: DataFrame, carried: list[str]) -> DataFrame:
    """``carried`` columns of ``pages`` (host, html), then text and n_chars."""

    def tell(batches):
        for batch in batches:
            for a, b in text_batches(batch, "html"):
                part = batch.slice(a, b - a)
                out = []
                for text, tree, constant in zip(part.column("html"), part.column("wrapper").to_pylist(), part.column("template").to_pylist()):
                    root = parse(text.as_py() or "")
                    template = frozenset()
                    if constant and tree:
                        place = alignment(_dumped(root), tree)
                        own = _node_texts(root, place)
                        gone = {c["node"] for c in constant if own.get(c["node"]) == c["text"]}
                        template = frozenset(k for k, node in place.items() if node in gone)
                    out.append(main_text(root, template))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carried), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                    [*carried, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*carried).schema)
    wide = pages.select(*carried, "host", "html").join(wrappers, "host", "left")
    return wide.select(*carried, "html", "wrapper", "template").mapInArrow(tell, f"{schema}, text string, n_chars long")


def with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.withColumn("host", host)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_host(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return extract(pages, induce(pages), ["page_id", "url"])
