"""What keeps queries' work in proportion to their tables."""

import random
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.grounding import common_run
from tidemark.operators import answers, names
from tidemark.plans import catalog
from tidemark.sources import pages, wiki

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["compare", "template_fields"])
def test_a_table_of_one_file_is_dealt_over_all_cores(spark, name):
    assert "RoundRobin" in plan(catalog.queries()[name](spark, SMALL))


def test_questions_are_made_once_for_each_title(spark, monkeypatch):
    written, keep = [], answers.settle
    monkeypatch.setattr(answers, "settle", lambda df, name: (written.append(df.count()), keep(df, name))[1])
    facts = spark.createDataFrame([("part1·price" if i % 2 else "part2·price", i) for i in range(40)], "title string, id long")
    got = answers.starter_asks(facts, 7, 5)
    assert got.count() == 2, got.collect()
    assert written == [2]


def test_a_text_that_holds_the_other_needs_no_automaton():
    text, began = "abcdefghij" * 200_000, time.perf_counter()
    assert common_run(text, "x" + text) == len(text) and common_run("", "x") == 0
    assert time.perf_counter() - began < 0.5


def test_list_pages_are_parsed_once(spark):
    html = "<a href='/d/{}.html'>Detail page {}</a>"
    rows = spark.createDataFrame([("s", i, "https://x.example/l", html.format(i, i) if i != 2 else "<p>none</p>") for i in range(4)], "source string, page_no int, url string, html string")
    got = wiki.list_links(rows, r"/d/[0-9]+\.html")
    assert "extract_links" not in got._jdf.queryExecution().optimizedPlan().toString() or "InMemoryRelation" in plan(got)
    assert sorted(r.link[-6:] for r in got.collect()) == ["0.html", "1.html"]


def test_texts_of_few_pages_are_held_at_once(spark):
    html = ["<article><p>" + "some words of a page. " * 12 + f"{i}</p></article>" for i in range(pages.PAGES * 3)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(html))), pa.array(html)], names=["page_id", "html"])
    out = list(pages._texts(iter([batch]), ("article", ".none")))
    assert len(out) == 4 and max(len(set(x.column(0).to_pylist())) for x in out) == pages.PAGES
    got = {(k, s): t for x in out for k, s, t in zip(*(c.to_pylist() for c in x.columns), strict=True)}
    assert len(got) == 4 * len(html) and got[(0, ".none")] is None
    assert all(got[(i, "reader")] == pages.extract(h, plain=False)[0] and got[(i, "page")] == pages.variants(h, ("article",))["page"] for i, h in enumerate(html))


def test_a_part_that_all_texts_have_costs_a_few_rows(spark, monkeypatch):
    """Of a token in every fact no more rows go on than a question takes; the facts found are those of holding all against all."""
    rng = random.Random(3)
    texts = [f"part{i % 90}·price {rng.choice(['ab', 'ab cd', ''])}" if i % 40 else None for i in range(400)]
    rows = [(i, t, rng.choice([0.5, 0.6, None]), rng.choice(["2024", "2025", None])) for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["key", "text", "_c", "_u"])
    out = [x for part in names._firsts(["a", "b c", "art1", "price", "none"], 5)(iter([batch] * 20)) for x in part.column("name").to_pylist()]
    assert sorted(Counter(out).items()) == [("a", 5), ("art1", 5), ("b c", 5), ("price", 5)]

    monkeypatch.setattr(names, "NAME_CHARS", 12)  # several passes
    df = spark.createDataFrame(rows, "key long, text string, _c double, _u string").repartition(7)
    terms = ["a", "b c", "art1", "art17", "price", "none", "", "·"]
    got = names.first_rows(df, spark.createDataFrame([(t,) for t in [*terms, "a"]], "term string"), 6, F.desc("_c"), F.desc("_u"), F.asc("key"), name="term")
    latest = lambda x: (x is None, [-ord(c) for c in x or ""])
    order = lambda r: (r[2] is None, -(r[2] or 0), latest(r[3]), r[0])
    want = {(t, r[0]) for t in terms if t for r in sorted((r for r in rows if t in (r[1] or "")), key=order)[:6]}
    assert {(r.term, r.key) for r in got.collect()} == want and got.columns == ["term", "key", "_c", "_u"]
