"""Web pages as a source: text, title, date and links of stored HTML, in Arrow batches on the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import types as ty
from tidemark.operators.steps import scratch
from tidemark.sources.page_tree import Node, Selectors, parse

# What holds a page's text, best first; what is cut from it; blocks and those that make a block no leaf; where dates stand.
CONTAINERS = (".mw-parser-output", "#mw-content-text", "article", ".article-content", ".content", "#content", ".post-content", ".detail-content", "#artibody", ".news_content")
CUT = (
    "script", "style", "noscript", "nav", "header", "footer", "aside", "form", "iframe", ".nav", ".menu", ".sidebar", ".advertisement", ".ad", ".comment", ".comments",
    ".related", ".breadcrumb", ".toolbar", ".mw-editsection", ".catlinks", ".printfooter", "#toc", ".toc",
)
HEADINGS = frozenset("h1 h2 h3 h4 h5".split())
BLOCK_TAGS = HEADINGS | frozenset("p li td th div tr".split())
INNER_TAGS = frozenset("p li div td".split())
DATES = (("property", "article:published_time"), ("name", "publishdate"), ("name", "pubdate"), ("itemprop", "datePublished"), ("name", "weibo: article:create_at"))
CONTAINER_CHARS, LEAST_CHARS = 200, 80
#: Pages whose texts by all strategies a task holds at once.
PAGES = 64
MAX_LINKS, MAX_URL, MIN_TITLE = 500, 2048, 4
BOMS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
META_CHARSET = re.compile(rb"<meta[^>]{1,200}?charset\s*=\s*[\"']?([A-Za-z0-9_-]{1,40})", re.I)

_CONTAINERS, _CUT = Selectors(CONTAINERS), Selectors(CUT)
_TAG, _ENTITIES = re.compile(r"<[^>]{0,200}>"), (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def _inline(text: str) -> str:
    """One line without tags that an attribute or a title may hold as text."""
    text = _TAG.sub(" ", text)
    for entity, char in _ENTITIES:
        text = text.replace(entity, char)
    return " ".join(text.split())


def _tidy(text: str) -> str:
    lines = [re.sub(r"[ \t\xa0]+", " ", line).strip() for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _chars(node: Node) -> int:
    """Characters of the element's texts, each without the white space around it."""
    return sum(len(t.strip()) for t in node.texts())


def pick_container(tree: Node, own: Selectors | None = None) -> Node:
    """The first element of the first selector whose text is long enough, given selectors before the usual ones; else the body."""
    for selectors in filter(None, (own, _CONTAINERS)):
        for node in selectors.first(tree):
            if node is not None and _chars(node) > CONTAINER_CHARS:
                return node
    return next((n for n in tree.walk() if n.tag == "body"), tree)


def _leaves(node: Node) -> Iterator[Node]:
    """The blocks below the element that hold no paragraph, list entry, division or cell, in order."""
    holding = set()
    for n in node.walk():
        if n is not node and n.tag in INNER_TAGS:
            for above in n.ancestors():
                if id(above) in holding:
                    break
                holding.add(id(above))
    yield from (n for n in node.walk() if n is not node and n.tag in BLOCK_TAGS and id(n) not in holding)


def blocks_to_text(node: Node, plain: bool = False) -> str:
    """The texts of an element's leaf blocks as lines; text outside of blocks isn't one.

    Headings have room around them and blocks of one character go, unless ``plain`` lines are asked for.
    """
    out = []
    for block in _leaves(node):
        content = _inline(" ".join(block.texts()))
        if len(content) > (not plain):
            out.append(f"\n{content}\n" if block.tag in HEADINGS and not plain else content)
    return "\n".join(out)


def _without_cuts(node: Node) -> Node:
    """The element as the only one below a root, without what is cut. The page's tree loses it."""
    root = Node("", children=[node])
    node.remove()
    node.parent = root
    _CUT.remove(root)
    return root


def extract(html: str | None, own: Selectors | None = None, plain: bool = True) -> tuple[str, str, str]:
    """Text, title and publication date; the whole page's text where the container has hardly any."""
    if not html:
        return "", "", ""
    tree = parse(html)
    first: dict[str, Node] = {}
    metas: dict[tuple[str, str], str] = {}
    for node in tree.walk():
        first.setdefault(node.tag, node)
        if node.tag == "meta":
            for mark in ("property", "name", "itemprop"):
                metas.setdefault((mark, node.attrs.get(mark, "")), node.attrs.get("content", ""))
    told = lambda tag: _inline(" ".join(first[tag].texts())) if tag in first else ""
    title = _inline(metas.get(("property", "og:title"), "")) or told("title") or told("h1")
    date = next((_inline(metas[d]) for d in DATES if metas.get(d)), "")
    if not date and "time" in first:
        date = _inline(first["time"].attrs.get("datetime", "")) or told("time")
    text = blocks_to_text(_without_cuts(pick_container(tree, own)), plain)
    if len(text.strip()) < LEAST_CHARS:
        whole = parse(html)
        _CUT.remove(whole)
        text = blocks_to_text(whole, plain)
    return _tidy(text), title, date


def variants(html: str | None, containers: Sequence[str]) -> dict[str, str]:
    """A page's text by each container, null where the page has none like it, and as a whole."""
    out = {}
    for name, node in zip(containers, Selectors(containers).first(parse(html)), strict=True):
        # each on a page of its own, as cutting changes it
        out[name] = None if node is None else _tidy(blocks_to_text(_without_cuts(Selectors([name]).first(parse(html))[0])))
    whole = parse(html)
    _CUT.remove(whole)
    return out | {"page": _tidy(blocks_to_text(whole))}


@F.pandas_udf(ty.struct(text=ty.STRING, title=ty.STRING, published=ty.STRING))
def html_extract(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(p, plain=False) for p in pages], columns=["text", "title", "published"])


def _texts(batches: Iterator[pa.RecordBatch], containers: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows (key, html) to rows (key, strategy, text), ``PAGES`` pages at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES):
            part = batch.slice(at, PAGES)
            rows = [(i, *x) for i, p in enumerate(part.column(1).to_pylist()) for x in [("reader", extract(p, plain=False)[0]), *variants(p, containers).items()]]
            columns = [part.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "strategy", "text"])


def texts_by_strategy(pages: DataFrame, containers: Sequence[str] = CONTAINERS) -> DataFrame:
    """key, strategy and text of pages (key, html): as they are read, by each container, and whole. A task holds the texts of ``PAGES`` pages at once."""
    names, kind = tuple(containers), T.StructType([pages.schema[0], T.StructField("strategy", ty.STRING), T.StructField("text", ty.STRING)])
    return pages.mapInArrow(lambda batches: _texts(batches, names), kind)


def container_texts(html: Column, containers: Sequence[str] = CONTAINERS) -> Column:
    """A map of each container's text, and the page's under ``page``."""
    names = tuple(containers)

    @F.pandas_udf(T.MapType(ty.STRING, ty.STRING))
    def read(pages: pd.Series) -> pd.Series:
        return pd.Series([variants(p, names) for p in pages])

    return read(html)


@F.pandas_udf(T.ArrayType(ty.struct(url=ty.STRING, title=ty.STRING)))
def extract_links(pages: pd.Series, bases: pd.Series) -> pd.Series:
    def one(html: str | None, base: str | None) -> list[dict]:
        out, seen = [], set()
        for link in parse(html).walk():
            if link.tag != "a" or "href" not in link.attrs:
                continue
            title, url = " ".join("".join(link.texts()).split()), urljoin(base or "", link.attrs["href"]).split("#")[0]
            if url.startswith(("http://", "https://")) and len(url) <= MAX_URL and len(title) >= MIN_TITLE and url not in seen:
                seen.add(url)
                out.append({"url": url, "title": title})
        return out[:MAX_LINKS]

    return pd.Series([one(h, b) for h, b in zip(pages, bases, strict=True)])


@F.pandas_udf(ty.STRING)
def decode_bytes(raw: pd.Series, declared: pd.Series) -> pd.Series:
    """Bytes as text: the declared charset, then what the bytes tell of themselves (a byte order mark, a meta element), then UTF-8, GB18030 and Big5, then with replacement marks."""

    def one(data: bytes | None, charset: str | None) -> str | None:
        if data is None:
            return None
        data = bytes(data)
        marked = next((name for mark, name in BOMS if data.startswith(mark)), None)
        meta = META_CHARSET.search(data[:2048])
        for name in filter(None, (charset, marked, meta and meta[1].decode("ascii"), "utf-8", "gb18030", "big5")):
            try:
                return data.decode(name)
            except (UnicodeDecodeError, LookupError):
                continue
        return data.decode("utf-8", "replace")

    return pd.Series([one(d, c) for d, c in zip(raw, declared, strict=True)])


def read_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with title, text and published in place of the html."""
    return pages.withColumn("_p", html_extract(F.col(html))).select(*[c for c in pages.columns if c != html], F.col("_p.title").alias("title"), F.col("_p.text").alias("text"), F.col("_p.published").alias("published"))


def frontier(seen: DataFrame, links: DataFrame) -> DataFrame:
    """URLs of links that aren't seen yet, once each, in order of their first place."""
    fresh = links.groupBy("url").agg(F.min("seq").alias("seq"))
    return fresh.join(seen.select("url").distinct(), "url", "left_anti")


def crawl(start: DataFrame, links: DataFrame, rounds: int | None = None) -> DataFrame:
    """url and round of breadth-first search over a table of links (url, to), to its end or for ``rounds`` rounds.

    Each round's new URLs are written before the next one, which meets the links with these alone and leaves out what earlier rounds have
    written. So a round costs its own links, and a lost executor its tasks.
    """
    spark, folder = start.sparkSession, scratch(start.sparkSession, "crawl")
    read = lambda: spark.read.schema("url string, round int").parquet(folder)
    start.select("url").filter("url IS NOT NULL").distinct().write.parquet(f"{folder}/round=0")
    links = links.select("url", "to").filter("to IS NOT NULL")
    n = 0
    while rounds is None or n < rounds:
        edge = spark.read.schema("url string").parquet(f"{folder}/round={n}")
        step = links.join(edge, "url").select(F.col("to").alias("url")).distinct()
        n += 1
        step.join(read().select("url"), "url", "left_anti").write.parquet(f"{folder}/round={n}")
        if spark.read.schema("url string").parquet(f"{folder}/round={n}").isEmpty():
            break
    return read()


def annotate_class(pages: DataFrame, narrative: Column) -> DataFrame:
    """source_class: narrative or data."""
    return pages.withColumn("source_class", F.when(narrative, "narrative").otherwise("data"))
