"""Queries against SQL of the same result, on the smallest tables; the rest of the registry is checked at larger ones."""

import decimal
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalog, source_queries, store_queries
from tidemark.sources import pages

SMALL = "/root/testdata/sf0.001"
MADE_HERE = {f.__module__ for f in (source_queries.character_page, store_queries.scan_chunks)}
NAMES = [n for n, q in catalog.queries().items() if q.__module__ in MADE_HERE and n in catalog.oracles()]
ALSO = ["compare", "value_like", "grounded", "merge_seed_facts", "gap_judge", "followup", "search_facts", "search_chunks", "trust_tag", "simhash64", "validate_page", "decide_tier", "newest_in_slot", "fact_fallback", "index_follow", "followup_rewrite", "missing_subjects", "simhash_neighbours", "mentioned_entities"]

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no tables")


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, int):
        return v
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", [*NAMES, *ALSO])
def test_same_rows_as_sql(spark, base, name):
    df = catalog.queries()[name](spark, SMALL)
    sql = base.execute(catalog.oracles()[name])
    named = sorted(c[0] for c in sql.description)
    assert sorted(df.columns) == named
    places = [[c[0] for c in sql.description].index(c) for c in named]
    want = Counter(tuple(plain(r[i]) for i in places) for r in sql.fetchall())
    assert Counter(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in named]).collect()) == want and want


INLINE = r"""SELECT page_id, CAST(length(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]{1,200}>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\f\r\v]+', ' ', 'g'), ' ')) AS INTEGER) AS chars FROM pages"""


def test_every_page_by_every_strategy(spark, base):
    rows = catalog.queries()["extract_variants"](spark, SMALL).collect()
    html = dict(base.execute("SELECT page_id, html FROM pages").fetchall())
    got = {(r.page_id, r.strategy): (r.chars, r.preview) for r in rows}
    assert len(got) == len(rows) == len(html) * (4 + len(pages.CONTAINERS))
    assert {i: n for (i, s), (n, _) in got.items() if s == "inline"} == dict(base.execute(INLINE).fetchall())
    for i, page in html.items():
        for name, text in {"reader": pages.extract(page, plain=False)[0], **pages.variants(page, pages.CONTAINERS)}.items():
            assert got[i, name] == (-1 if text is None else len(text), (text or "")[:240]), (i, name)
