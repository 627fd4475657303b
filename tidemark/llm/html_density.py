"""HTML extraction (op 7) by composite text density.

A page is read once into a tree. Elements that are no article text by their kind (menus, headers of the page, footers,
scripts and so on), or by clear words in their class, id and role, are cut off; a heading isn't cut by its id. Inside an article
a name cuts only if all its words are marks or ``PLAIN`` ones. Words in ``UNCLEAR``, and those of a section's id, cut only what is mostly
links, or stands outside every article and doesn't hold the core. A form is cut unless it holds the core; a header inside ``main``
is kept if it holds a heading. For every other node: C characters, T tags
below, LC characters in links, LT links; with the body's C and LC

    density = C / T * log(C * T / (LC * LT)) / (1 + log(log(C * LC / (C - LC) + LC_body * C / C_body + e)))

each of T, LC, LT and C - LC at least 1; the 1 in the divisor keeps it above 0 on pages without links. A node's sum is that of its children's densities. The node with the largest sum is the
core; the least density on its path to the body is the threshold. From the body down, each node at or above the threshold gives
the subtree with the largest sum below it, and the walk goes on into its children outside that subtree. Density is low for
short text, so these subtrees are completed. If the core lies in an ``article`` or ``main``, each outermost one of these that holds one of
the subtrees, or reaches the threshold itself, is taken whole, and what lies outside is no article. On other pages, what stands between the first and the last
subtree belongs to the article, and so do the last ``h1`` before them and the neighbours of the first and the last in their own parent, up to
the next that isn't plain text; of all these not what is half links or more.

Blocks come in page order. Character references are decoded, white space in a block becomes one space, and blocks are
joined by a space. Parsing is one walk over the page with a stack, linear in its length, closed or not; no page is cut off, and there's no
recursion, so depth is no limit. Memory is one page per worker.

Edge cases: null, empty and text-less pages give an empty text. Tags that are never closed end with what holds them; a ``<`` after
which no ``>`` comes is text. A page without a body is read as one. Repeated rows give repeated rows; extra columns pass; an empty table gives an empty one.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.storage import prepare

# HTML's elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript".split())
CUT = frozenset("nav header footer aside script style textarea title head noscript iframe noembed noframes template svg canvas object audio video select button input fieldset dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - frozenset("br caption dd dt legend li option optgroup tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INSIDE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
# Words in a class, id or role that mark what is no article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner promo promotion promoted sponsor sponsored nav navbar navigation menu "
    "menubar sidebar sidebars rail breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist disqus respond "
    "discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe newsletter signup login "
    "share sharing social related recommended recommendations pagination pager widget widgets complementary contentinfo search "
    "copyright legal disclaimer skip".split()
)
# Of these, words that articles use of themselves as well.
UNCLEAR = frozenset(
    "discussion related recommended recommendations search legal notice notices alert social share sharing copyright promotion rail skip respond consent disclaimer".split()
)
# Beside unclear words these leave a name as it is.
PLAIN = frozenset(
    "site page main global top bottom left right box bar block list area container wrapper wrap panel links link buttons button post posts article entry "
    "section inner outer item items content body group row col slot unit zone icon icons count form title text module component js".split()
)
# A quote opens a value just after an equals sign; one that never ends is a character like others.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ANY_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
_NOTICE = re.compile(r"\s*(?:©|\(c\)|&copy;|copyright\b)", re.I)
SCOPES = frozenset("article main section div td th blockquote table ul ol dl".split())


class Node:
    __slots__ = ("tag", "parent", "items", "cut", "chars", "tags", "link_chars", "links", "density", "total", "best", "titled", "headed", "doubt")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False):
        self.tag, self.parent, self.cut, self.items = tag, parent, cut, []
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.total = 0.0
        self.best, self.titled, self.headed, self.doubt = self, tag == "h1", tag in HEADINGS, ""


def _words(name: str) -> set[str]:
    return set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))


def _marked(tag: str, attributes: str, articles: int, mains: int) -> tuple[bool, str]:
    """Whether it is no article text by its kind or clear names, and why it may be none: "form", "head", "in" or "out" of an article."""
    inside, doubt = articles + mains > 0, ""
    if tag == "header" and inside:  # an article's own header holds its title
        doubt = "" if articles else "head"
    elif tag in CUT:
        return True, ""
    elif tag == "form":
        doubt = "form"
    if tag in ("html", "body", "main", "h1"):
        return False, ""
    for name, *values in _NAMED.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, ""
        if name in ("hidden", "aria-hidden") or name == "id" and (tag in HEADINGS or tag == "article"):
            continue
        for part in value.split():
            words = _words(part)
            if tag == "article":  # reader comments are articles on some pages
                if name == "class" and words & {"comment", "comments"} and words <= MARKS | PLAIN:
                    return True, ""
                continue
            marks = words & MARKS - ({"header"} if tag == "header" else set())
            whole = words <= MARKS | PLAIN
            clear = not marks <= UNCLEAR and (whole or not inside) and not (name == "id" and tag == "section")
            if clear or name == "role" and part.lower() in MARKS:
                return True, ""
            if marks and tag not in HEADINGS and whole:
                doubt = doubt or ("in" if inside else "out")
    return False, doubt


def parse(page: str) -> Node:
    """The page's tree, without what is cut."""
    root = body = Node("body", None)
    at, open_, size, tags = 0, root, len(page), _TAG
    counts: Counter[str] = Counter()

    def close(last: Node) -> None:
        """Closes all that is open below ``last``."""
        nonlocal open_
        while open_ is not last:
            counts[open_.tag] -= 1
            open_ = open_.parent

    def text(end: int) -> None:
        if end > at and not open_.cut:
            open_.items.append(page[at:end])

    found = 0
    while (found := page.find("<", found)) >= 0:
        if page.startswith("<!--", found):
            end = page.find("-->", found + 4)
            text(found)
            found = at = size if end < 0 else end + 3
            continue
        if page[found + 1 : found + 2] in ("!", "?"):
            end = page.find(">", found)
            text(found)
            found = at = size if end < 0 else end + 1
            continue
        m = tags.match(page, found)
        named = page[found + 1 : found + 3].lstrip("/")[:1]
        if m is None and named.isascii() and named.isalpha():
            if page.find(">", found) < 0:
                break  # no tag ends any more: the rest is text
            tags = _ANY_TAG  # all ends left stand in quotes
            m = tags.match(page, found)
        if m is None:
            found += 1
            continue
        text(found)
        found = at = m.end()
        tag = m[2].lower()
        if m[1]:
            if counts[tag] > 0:
                node = open_
                while node.tag != tag:
                    node = node.parent
                close(node.parent)
            elif tag == "br" and not open_.cut:
                open_.items.append(Node("br", open_))
            continue
        if tag in ("html", "body"):
            continue
        if tag in INSIDE or tag in ENDS_P and counts["p"] > 0:
            close(_ended(open_, body, tag))
        cut, doubt = (True, "") if open_.cut else _marked(tag, m[3], counts["article"], counts["main"])
        node = Node(tag, open_, cut)
        node.doubt = doubt
        if not cut:
            open_.items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            found = at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            open_ = node
            counts[tag] += 1
    text(size)
    return body


def _ended(open_: Node, body: Node, tag: str) -> Node:
    """What is open after the elements that this start tag ends."""
    stop = INSIDE.get(tag)
    node = open_
    while node is not body:
        if node.tag == tag and stop or node.tag == "p" and tag in ENDS_P or tag in ("dt", "dd") and node.tag in ("dt", "dd") or tag in ("td", "th") and node.tag in ("td", "th"):
            return node.parent
        if stop and node.tag in stop or node.tag in SCOPES:
            return open_
        node = node.parent
    return open_


def _order(body: Node) -> list[Node]:
    """All nodes in page order, each before those below it."""
    out, stack = [], [body]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in reversed(node.items) if isinstance(x, Node)]
    return out


def measure(body: Node) -> list[Node]:
    nodes = _order(body)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.links = 0
        node.density = 0.0
        for x in node.items:
            if isinstance(x, Node):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.links += x.links
            else:
                node.chars += len(x) - x.count(" ")
        if node.tag == "a":
            node.link_chars, node.links = node.chars, node.links + 1
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.links)
        if c:
            base = math.log(math.log(c * node.link_chars / max(1, c - node.link_chars) + share * c + math.e) + 1e-9)
            node.density = c / t * max(0.0, math.log(max(1.0, c * t / (lc * lt)))) / (1 + max(0.0, base))
        below = [x for x in node.items if isinstance(x, Node)]
        node.total = sum(x.density for x in below)
        node.titled = node.tag == "h1" or any(x.titled for x in below)
        node.headed = node.tag in HEADINGS or any(x.headed for x in below)
        node.best = node
        for x in below:  # of equal ones, the first in page order
            if x.best.total > node.best.total:
                node.best = x.best
    return nodes


def _settle(body: Node, nodes: list[Node]) -> None:
    """Cut what is doubtful by its names, or a form, as its links and the core's place tell."""
    doubtful = [x for x in nodes if x.doubt]
    if not doubtful:
        return
    path, node = set(), body.best if body.best.total else None
    while node is not None:
        path.add(node)
        node = node.parent
    # a page without any sum has no core to go by: its text stays, whatever holds it
    gone = {x for x in doubtful if x not in path and (_linked(x) if x.doubt == "in" else not x.headed or _linked(x) if x.doubt == "head" else path or _linked(x))}
    for parent in {x.parent for x in gone}:
        parent.items = [y for y in parent.items if y not in gone]
    if gone:
        measure(body)


def _whole(node: Node | None) -> Node | None:
    """The outermost article or main that holds the node."""
    found = None
    while node is not None:
        if node.tag in ("article", "main"):
            found = node
        node = node.parent
    return found


def core(body: Node) -> list[Node | str]:
    """The nodes, and loose texts between them, that are the main text, in page order."""
    _settle(body, measure(body))
    best = body.best
    if not best.total:
        return [body]
    threshold, node = best.density, best
    while node is not None:
        threshold, node = min(threshold, node.density), node.parent
    tops, stack = set(), [body]
    while stack:
        node = stack.pop()
        if node.density < threshold:
            continue
        top = node.best if node.best.total else node
        tops.add(top)
        if top is not node:
            stack += [x for x in node.items if isinstance(x, Node)]
    if _whole(best) is None:
        return _span(body, tops)
    held, out, stack = {_whole(x) for x in tops}, [], [body]
    while stack:
        node = stack.pop()
        if node.tag in ("article", "main"):
            if node in held or node.density >= threshold and not _linked(node):
                out.append(node)
            continue
        stack += [x for x in reversed(node.items) if isinstance(x, Node)]
    return out


def _span(body: Node, tops: set[Node]) -> list[Node | str]:
    """The tops in page order, with their title and the text between them that isn't mostly links."""
    holders = set()
    for node in tops:
        while node is not None and node not in holders:
            holders.add(node)
            node = node.parent
    units, stack = [], [body]
    while stack:
        x = stack.pop()
        if isinstance(x, str) or x in tops or x not in holders and (x.tag == "h1" or not x.titled):
            units.append(x)
            continue
        # one by one, with an end of block on either side
        edge = [Node("br", None)] if x.tag in BLOCKS else []
        stack += [*edge, *reversed(x.items), *edge]
    at = [i for i, x in enumerate(units) if x in tops]
    first, last = at[0], at[-1]
    titles = [i for i in range(first) if isinstance(units[i], Node) and units[i].tag == "h1" and not _linked(units[i])]
    while first and _plain(units[first - 1], units[at[0]]):
        first -= 1
    while last + 1 < len(units) and _plain(units[last + 1], units[at[-1]]):
        last += 1
    start = min(first, titles[-1]) if titles else first
    return [x for x in units[start : last + 1] if isinstance(x, str) or x in tops or not _linked(x)]


def _plain(x: Node | str, top: Node) -> bool:
    """Whether a neighbour of a subtree, in its parent, is plain text that goes on: paragraphs and such, not links or a notice."""
    if isinstance(x, str):
        return not x.strip()
    if x.parent is not top.parent:
        return False
    if not x.chars:
        return True
    if _linked(x):
        return False
    if x.tag in HEADINGS:
        return True
    own = text_of([x])
    return _SENTENCE.search(own) is not None and _NOTICE.match(own) is None


def _linked(x: Node) -> bool:
    return x.chars > 0 and 2 * x.link_chars >= x.chars


def text_of(tops: list[Node | str]) -> str:
    """Blocks in page order, each with its white space made single."""
    blocks, now, stack = [], [], list(reversed(tops))
    mark = object()
    while stack:
        x = stack.pop()
        if x is mark:
            blocks.append("".join(now))
            now = []
        elif isinstance(x, str):
            now.append(x)
        else:
            block = x.tag in BLOCKS
            if block:
                stack.append(mark)
            stack += reversed(x.items)
            if block:
                stack.append(mark)
    blocks.append("".join(now))
    return " ".join(" ".join(" ".join(html.unescape(b).split()) for b in blocks).split())


def extract(page: str | None) -> str:
    return text_of(core(parse(page))) if page else ""


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """pages with text and n_chars in place of the html."""
    prepare(pages.sparkSession)
    others = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_")).alias("_row"), F.col(f"`{html_column}`").alias("_html"))
    schema = T.StructType([rows.schema["_row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column("_html")]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema).select(*[F.col(f"_row.`{c}`") for c in others], "text", "n_chars")


def query(spark, sf_dir):
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
