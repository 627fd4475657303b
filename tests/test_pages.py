"""Selectors against a plain matcher, and pages by their containers."""

import random
import re

import pytest

from tidemark.sources import pages
from tidemark.sources.page_tree import Node, Selectors, parse

NAMES = ("a", "b", "c")


def make(rng, depth=0):
    tag = rng.choice(["div", "section", "span", "article"])
    attrs = "".join(f' {k}="{v}"' for k, v in (("class", " ".join(rng.choices(NAMES, k=rng.randrange(3)))), ("id", rng.choice(["", *NAMES]))) if v)
    inner = "".join(make(rng, depth + 1) if depth < 5 and rng.random() < 0.6 else f"t{rng.randrange(9)}" for _ in range(rng.randrange(4)))
    return f"<{tag}{attrs}>{inner}</{tag}>"


def plainly(selector, node):
    """One selector on one element, by trying every way up."""
    *outer, last = selector.split()

    def fits(part, n):
        return all((m == "" and n.tag == x) or (m == "." and x in n.classes) or (m == "#" and n.id == x) for m, x in re.findall(r"([.#]?)([\w-]+)", part))

    def below(parts, n):
        return not parts or any(fits(parts[-1], up) and below(parts[:-1], up) for up in n.ancestors())

    return fits(last, node) and below(outer, node)


@pytest.mark.parametrize("seed", range(8))
def test_selectors_equal_a_plain_matcher(seed):
    rng = random.Random(seed)
    simple = lambda: rng.choice(["div", "article", "span", ".a", ".b", "#c", "div.a", ".a.b", "span#b.c", "section.c"])
    selectors = [" ".join(simple() for _ in range(rng.choice([1, 1, 2, 3]))) for _ in range(25)]
    compiled, tree = Selectors(selectors), parse("".join(make(rng) for _ in range(12)))
    nodes = [n for n in tree.walk() if n.tag]
    assert len(nodes) > 20
    for n in nodes:
        assert compiled.of(n) == [i for i, s in enumerate(selectors) if plainly(s, n)]
    assert compiled.first(tree) == [next((n for n in nodes if plainly(s, n)), None) for s in selectors]
    compiled.remove(tree)
    assert not [n for n in tree.walk() if n.tag and any(plainly(s, n) for s in selectors)]
    for bad in ("a > b", "a:first", "", "[x]"):
        with pytest.raises((ValueError, IndexError)):
            Selectors([bad])


@pytest.mark.parametrize("selector", pages.CONTAINERS)
def test_each_container_is_taken(selector):
    mark = {".": "class", "#": "id"}.get(selector[0])
    open_, close = (f'<div {mark}="x {selector[1:]}">' if mark == "class" else f'<div id="{selector[1:]}">', "</div>") if mark else ("<article>", "</article>")
    cut = "".join(f'<div class="{c[1:]}">gone</div>' if c[0] == "." else f'<div id="{c[1:]}">gone</div>' if c[0] == "#" else f"<{c}>gone</{c}>" for c in pages.CUT)
    body = "<h2>Heading here</h2>" + "<p>Some words of text.</p>" * 15 + cut
    text, _, _ = pages.extract(f"<html><body><p>outside of it</p>{open_}{body}{close}</body></html>", plain=False)
    assert "gone" not in text and "outside" not in text
    assert text.split("\n") == ["Heading here", "", *["Some words of text."] * 15]


def test_pages():
    long = "<p>" + "word " * 60 + "</p>"
    assert pages.extract(f"<article>short</article><div class=content>{long}</div><p>else</p>")[0] == ("word " * 60).strip()
    # a given container comes first; without a long enough one the body
    assert pages.extract(f"<article>{long}</article><div class=mine><ul><li>{'x ' * 150}<li>second one</ul></div>", Selectors([".mine"]))[0].endswith("second one")
    assert pages.extract("<body><p>one two</p><div>three<p>four five</p></div></body>")[0] == "one two\nfour five"
    title = '<title>a &amp; b</title><meta property="og:title" content="&lt;span&gt;T&lt;/span&gt; 1"><h1>H</h1>'
    assert pages.extract(title)[1] == "T 1" and pages.extract("<h1>H <b>x</b></h1>")[1] == "H x" and pages.extract("<title> a\n b</title>")[1] == "a b"
    assert pages.extract('<meta name="pubdate" content="2026-01-02"><time datetime="x">y</time>')[2] == "2026-01-02"
    assert pages.extract("<time>yesterday</time>")[2] == "yesterday"
    assert pages.extract(None) == ("", "", "") and pages.extract("")[0] == ""
    deep = "<div>" * 20_000 + "<p>at the bottom of it</p>"
    assert pages.extract(deep)[0] == "at the bottom of it"


def test_the_tree_of_loose_html():
    tree = parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<p>y<div>z</div></b></x>")
    rows = [n for n in tree.walk() if n.tag in ("li", "td", "p")]
    assert ["".join(n.texts()) for n in rows] == ["a", "bc", "c", "d", "1", "2", "3", "x", "y"]
    assert isinstance(tree, Node) and [n.tag for n in tree.walk()].count("tr") == 2


def test_variants_and_charsets(spark):
    long = "<p>" + "word " * 60 + "</p>"
    got = pages.variants(f"<article>{long}<nav>n</nav></article><div id=content><p>other one</p></div>", ("article", "#content", ".none"))
    assert got["article"] == ("word " * 60).strip() and got["#content"] == "other one" and got[".none"] is None and got["page"].endswith("other one")
    from pyspark.sql import functions as F

    texts = [("甲乙".encode("gbk"), None, "甲乙"), ("é".encode("latin-1") + b'<meta charset="latin-1">', None, 'é<meta charset="latin-1">'), ("甲".encode("utf-16"), None, "甲"), (b"\xef\xbb\xbfx", None, "x"), ("é".encode("latin-1"), "latin-1", "é"), (None, None, None)]
    rows = spark.createDataFrame([(i, bytearray(b) if b is not None else None, c) for i, (b, c, _) in enumerate(texts)], "i int, b binary, c string")
    assert [r.t for r in rows.select("i", pages.decode_bytes(F.col("b"), F.col("c")).alias("t")).orderBy("i").collect()] == [t for _, _, t in texts]


def test_crawl_runs_to_its_end(spark):
    links = [(f"u{i}", f"u{i + 1}") for i in range(6)] + [("u3", "u0"), ("u2", "u5"), ("u9", "u1"), ("u1", None)]
    frame = spark.createDataFrame(links, "url string, to string")
    start = spark.createDataFrame([("u0",), ("u0",), (None,)], "url string")
    assert {r.url: r.round for r in pages.crawl(start, frame).collect()} == {"u0": 0, "u1": 1, "u2": 2, "u3": 3, "u5": 3, "u4": 4, "u6": 4}
    assert {r.url: r.round for r in pages.crawl(start, frame, 1).collect()} == {"u0": 0, "u1": 1}
    assert pages.crawl(start.limit(0), frame).count() == 0
