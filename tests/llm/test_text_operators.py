"""Packing, substring dedup, decontamination, HTML and the classifier against brute force and planted cases."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fm_quality, html_density, packing, substring_dedup


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


# --- packing ---


def test_pieces_and_slots(spark):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(packing.tokenizer_file())
    rng = random.Random(4)
    texts = [None, "", "Hi  there\n\n it's 42!", " ".join(words(rng, 900)), "<|endoftext|> x", "é漢😀" * 50] + [" ".join(words(rng, rng.randrange(1, 400))) for _ in range(60)]
    data = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "null id", "x"), (3, texts[3], "x")]
    out = packing.pack(spark.createDataFrame(data, "doc_id long, text string, offset string").repartition(5)).collect()
    want = Counter()
    for i, t, _ in data:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for j, (start, n) in enumerate(packing.cut(len(ids))):
            want[(i, j, start, n, zlib.crc32(ids[start : start + n].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 1024
    total = sum(r.length for r in out)
    assert len(sequences) <= 1.1 * total / 1024 + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_is_best_fit_and_whole():
    rng = random.Random(1)
    counts = Counter(rng.randrange(1, 65) for _ in range(3000))
    used = Counter()
    for length, rank, first, offset, n, each in packing.plan(dict(counts), 64):
        for r in range(rank, rank + n):
            k = r - rank
            used[first + k // each] += int(length)
            assert offset + (k % each) * length + length <= 64
    assert sum(used.values()) == sum(k * v for k, v in counts.items()) and max(used.values()) <= 64
    # one piece at a time, best fit in order of falling length
    rooms, sequences = Counter(), 0
    for length in sorted(counts.elements(), reverse=True):
        fit = min((r for r in rooms if r >= length and rooms[r]), default=None)
        if fit is None:
            sequences, fit = sequences + 1, 64
        else:
            rooms[fit] -= 1
        rooms[fit - length] += 1
    assert len(used) == sequences


def test_cut():
    assert packing.cut(5) == [(0, 5)] and packing.cut(1024) == [(0, 1024)]
    assert packing.cut(1025) == [(0, 1), (1, 1024)] and packing.cut(2048) == [(0, 1024), (1024, 1024)]


# --- substring dedup ---


def removed(texts, k):
    rows = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in rows for i in range(len(w) - k + 1))
    out = []
    for w in rows:
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@pytest.mark.parametrize(("block_chars", "range_windows"), [(10**6, 10**6), (600, 40)])
def test_removed_words_equal_brute_force(spark, block_chars, range_windows):
    rng = random.Random(5)
    shared = [words(rng, n) for n in (9, 10, 11, 25, 60)]
    texts = [None, "", " \n ", "few words only"]
    for _ in range(60):
        t = words(rng, rng.randrange(0, 30))
        for _ in range(rng.randrange(0, 3)):
            part = rng.choice(shared)
            a = rng.randrange(len(part))
            t += part[a:] + words(rng, rng.randrange(0, 5))
        texts.append(" ".join(t) + rng.choice(["", "\n", " x"]))
    texts += [" ".join(["a", "b"] * 20), texts[10], texts[10], "x y z " * 5 + "end", "p q r s t u v w x y z p q r s t u v w x y"]
    data = [(i if i != 7 else None, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_words string")
    got = substring_dedup.remove_repeats(docs, window=10, block_chars=block_chars, range_windows=range_windows).collect()
    want = Counter((data[i][0], *x) for i, x in enumerate(removed(texts, 10)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_many_repeated_rows_spread_over_blocks(spark):
    rng = random.Random(8)
    same, other = words(rng, 40), words(rng, 60)
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(" ".join(same)).alias("text"))
    docs = docs.union(spark.createDataFrame([(1, " ".join(other)), (2, " ".join(other[:34] + ["x"] + same[5:]))], "doc_id long, text string"))
    got = substring_dedup.remove_repeats(docs, block_chars=200_000, range_windows=500).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert {tuple(r) for r in got} == {(None, 40, 40, 100_000), (1, 60, 0, 1), (2, 70, 35, 1)}


def test_a_very_long_text(spark):
    rng = random.Random(9)
    long_ = words(rng, 300_000)
    data = [(1, " ".join(long_)), (2, " ".join(long_[1000:1040])), (3, " ".join(["the"] * 50_000))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), block_chars=100_000, range_windows=5000).drop("kept").collect()}
    assert got == {1: (300_000, 40), 2: (40, 40), 3: (50_000, 50_000)}


def test_anchors_are_those_of_equal_windows():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**64, 400, np.uint64)
    h[100:140] = np.tile(h[100:104], 10)
    for n in (1, 2, 7, 18):
        values, at = substring_dedup._least(h, n)
        assert values.tolist() == [min(h[i : i + n].tolist()) for i in range(401 - n)]
        assert at.tolist() == [i + int(np.argmin(h[i : i + n])) for i in range(401 - n)]
    rows = rng.integers(0, 5, (300, 2)).astype(np.uint64)
    values, number, count = substring_dedup._distinct(rows)
    assert (values[number] == rows).all() and [tuple(x) for x in values.tolist()] == sorted({tuple(x) for x in rows.tolist()})
    assert count.sum() == 300 and (np.bincount(number) == count).all()


def test_kept_hash_of_nothing(spark):
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


# --- decontamination ---


def test_items_are_found_wherever_they_stand(spark):
    rng = random.Random(10)
    items = [" ".join(words(rng, n)) for n in (5, 6, 12, 20, 33, 60, 130, 400)]
    data, want = [], set()
    for k, item in enumerate(items):
        for n in (0, 30, 700, 6000):
            at = rng.randrange(n + 1)
            t = words(rng, n)
            data.append((len(data), " ".join(t[:at] + [item.upper()] + t[at:])))
            want.add((len(data) - 1, k))
        w = item.split()
        if len(w) >= 60:  # one word of sixty changed: five shingles of 56 are lost
            w[len(w) // 2] = "changed"
            data.append((len(data), " ".join(words(rng, 300) + w)))
            want.add((len(data) - 1, k))
        data.append((len(data), " ".join(words(rng, 300) + w[: len(w) // 2])))
    data += [(900, None), (901, ""), (None, items[3])]
    want.add((None, 3))
    bench = [*enumerate(items), (100, None), (101, ""), (102, "too few words"), (103, items[3])]
    want |= {(i, 103) for i, k in want if k == 3}
    docs = spark.createDataFrame([(i, t, "c") for i, t in data], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.find_items(docs.drop("item_id"), benchmark)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    clean = decontaminate.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in data if i not in {d for d, _ in want})
    assert decontaminate.find_items(docs.drop("item_id").limit(0), benchmark).count() == 0
    assert decontaminate.find_items(docs.drop("item_id"), benchmark.limit(0)).count() == 0


def test_short_items_are_found_in_long_documents(spark):
    rng = random.Random(11)
    stem = words(rng, 6)
    items = [words(rng, 5 + i % 10) for i in range(80)] + [stem + words(rng, 1 + i % 4) for i in range(12)]
    data = []
    for item in items:
        t = words(rng, rng.randrange(60, 400))
        at = rng.randrange(len(t) + 1)
        data.append(" ".join(t[:at] + item + t[at:]))
        data.append(" ".join(t[:at] + item[:-1] + t[at:]))  # one shingle short, which is a fifth or less from nine words on
    data.append(" ".join(stem * 3))
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]
    texts = [t.split() for t in data]
    own = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    want = {(d, i, len(x & g)) for d, x in enumerate(own) for i, g in enumerate(grams) if 10 * len(x & g) >= 8 * len(g)}
    found = decontaminate.find_items(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    got = found.collect()
    assert {(r.doc_id, r.item_id, r.n_shared) for r in got} == want and len(got) == len(want)


def test_parts_of_the_benchmark(spark, monkeypatch):
    rng = random.Random(3)
    items = [" ".join(words(rng, 30)) for _ in range(12)]
    docs = spark.createDataFrame([(i, " ".join(words(rng, 50)) + " " + t) for i, t in enumerate(items)], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "PART_BYTES", 500)
    found = decontaminate.find_items(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in range(12)}


# --- HTML ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">A menu entry</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="page"><article><h1>Title &amp; more</h1><p>First <b>bo</b>ld&nbsp;paragraph with   some words,
and a line.<br>Next<p>Second one, quite long, to hold the density of the page up, as an article does.</p><form><input> <button>Send</button></form>
<ul><li>One<li>Two</ul></article><aside class="sidebar">Related stuff</aside><div class="comments"><p>Reader: nice long comment, longer than the article itself, indeed, with many words in it and more of them still</p></div></div>
<div class="ad">Buy</div><footer>&copy; site</footer></body></html>"""


def test_article_text():
    assert html_density.extract(PAGE) == "Title & more First bold paragraph with some words, and a line. Next Second one, quite long, to hold the density of the page up, as an article does. One Two"


def test_page_without_article():
    body = "<p>" + "A sentence of the main text of this page. " * 6 + "</p>"
    page = f"<html><body><div class=nav><a href=x>x</a></div><div><div>{body}{body}</div><div><a href=1>one link</a> <a href=2>two link</a></div></div></body></html>"
    assert html_density.extract(page) == " ".join(["A sentence of the main text of this page."] * 12)


def test_all_parts_of_a_page_without_article():
    def part(name, n):
        return [f"Sentence {i} of {name}, which is as long as others of this text, and has a comma more." for i in range(n)]

    def wrap(lines):
        return "".join(f"<p>{x}</p>" for x in lines)

    links = "<div>" + "".join(f"<a href={i}>A link with some words {i}</a> " for i in range(8)) + "</div>"
    lead, text = part("lead", 1), part("text", 20)
    page = f"<body>{links}<div id=page><h1>Title</h1><div class=lead>{wrap(lead)}</div><div class=text>{wrap(text)}</div></div>{links}</body>"
    assert html_density.extract(page) == " ".join(["Title", *lead, *text])
    one, two, three = part("one", 9), part("two", 12), part("three", 9)
    page = f"<body><div>{links}<section>{wrap(one)}</section>loose<h2>Two</h2><div>{links}<div>{wrap(two)}</div></div>{links}<div>{wrap(three)}</div></div>{links}</body>"
    assert html_density.extract(page) == " ".join([*one, "loose", "Two", *two, *three])


def test_names_and_forms_alone_cut_no_article_text():
    def part(name, n=4):
        return [f"Sentence {i} of {name}, which is as long as others of this text, and has a comma more." for i in range(n)]

    def wrap(lines):
        return "".join(f"<p>{x}</p>" for x in lines)

    a, b, c, d = part("text"), part("discussion"), part("analysis"), part("related")
    links = "<div class=related><a href=1>Another article to read</a> <a href=2>One more of them</a></div>"
    parts = f'{wrap(a)}<section id="discussion"><h2 id="related-work">Related work</h2>{wrap(b)}</section><div class="legal-analysis">{wrap(c)}</div><div class=notice>{wrap(d)}</div>{links}'
    want = " ".join([*a, "Related work", *b, *c, *d])
    assert html_density.extract(f"<body><article>{parts}</article><div class=cookie-notice>We use cookies</div></body>") == want
    assert html_density.extract(f"<body><form action=x><input><article>{parts}</article></form><form><p>Your name</p></form></body>") == want
    page = f"<body><form><nav>menu</nav><div>{wrap(a)}</div></form><div class=comments>{wrap(b[:1])}</div><section id=comments>{wrap(c[:1])}</section></body>"
    assert html_density.extract(page) == " ".join(a)


def sentences(name, n=4):
    return [f"Sentence {i} of {name}, which is as long as others of this text, and has a comma more." for i in range(n)]


def paragraphs(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


def test_several_articles_are_kept():
    one, two, three = sentences("one", 6), sentences("two", 3), sentences("three", 2)
    card = "<article class=teaser><a href=1>Another page to read</a></article>"
    page = f"<body><div><article>{paragraphs(one)}</article><article>{paragraphs(two)}</article>{card}</div><div><p>Outside of it.</p></div></body>"
    assert html_density.extract(page) == " ".join([*one, *two])
    comments = f'<article class="comment-body">{paragraphs(three)}</article>'
    assert html_density.extract(f"<body><article>{paragraphs(one)}</article>{comments}{comments}</body>") == " ".join(one)


def test_what_stands_inside_an_article():
    a, b, c, d, e = (sentences(x) for x in "abcde")
    odd = f'<p class="social-science">{b[0]}</p><h2 id="search">Searching</h2><blockquote class="legal">{c[0]}</blockquote><div class="ad-hoc study">{paragraphs(d)}</div>'
    odd += "<p>Here <math><mi>x</mi> = 5</math> holds.</p>"
    gone = f'<div class="post-comments-area">{paragraphs(e)}</div><p class="advert">Buy now</p><section class="comments">{paragraphs(e)}</section><aside>{paragraphs(e)}</aside><footer>Tags</footer>'
    page = f"<body><article><header class=entry-header><h1>Title</h1></header>{paragraphs(a)}{odd}{gone}</article></body>"
    assert html_density.extract(page) == " ".join(["Title", *a, b[0], "Searching", c[0], *d, "Here x = 5 holds."])
    main = f'<main><header class="masthead">MENU</header><header>Top</header><header><h1>Title</h1></header>{paragraphs(a)}</main>'
    assert html_density.extract(f"<body>{main}</body>") == " ".join(["Title", *a])


def test_short_neighbours_without_article():
    a = sentences("text", 12)
    page = f"<body><div id=c><p>An intro.</p><div>{paragraphs(a)}</div><div>That was all of it.</div><div><a href=1>More pages</a></div></div><div>© 2024 Firm.</div></body>"
    assert html_density.extract(page) == " ".join(["An intro.", *a, "That was all of it."])


@pytest.mark.parametrize("unit", ["<a ", "<a href='", '<p title="x>', "<!-- ", "</b>", "<b>", "<div>", "<div></x>", "<li>x", "<td>", "&amp;", '<a x=">" ', "<p><b>", "< ", "<i><p>"])
def test_broken_markup_takes_linear_time(unit):
    began = time.process_time()
    html_density.extract(unit * (2_000_000 // len(unit)))
    assert time.process_time() - began < 20


def test_quotes_and_ends_of_tags():
    assert html_density.extract("<p title=it's>one</p><p title='a > b'>two</p><p title=\"x>three</p>") == "one two three"
    assert html_density.extract("a <b c & d") == "a <b c & d"


def test_measures_equal_those_of_a_recursion():
    rng = random.Random(7)

    def page(depth):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(rng.choice(["", "some words here, ", "x" * rng.randrange(60)]))
            if depth:
                tag = rng.choice(["div", "p", "a", "span", "section"])
                parts.append(f"<{tag}>{page(depth - 1)}</{tag}>")
        return "".join(parts)

    def totals(node):
        c = t = lc = lt = 0
        for x in node.items:
            if isinstance(x, str):
                c += len(x) - x.count(" ")
            else:
                a, b, d, e = totals(x)
                c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e
        return (c, t, c, lt + 1) if node.tag == "a" else (c, t, lc, lt)

    def density(node, share):
        c, t, lc, lt = totals(node)
        if not c:
            return 0.0
        base = math.log(math.log(c * lc / max(1, c - lc) + share * c + math.e) + 1e-9)
        return c / max(1, t) * max(0.0, math.log(max(1.0, c * max(1, t) / (max(1, lc) * max(1, lt))))) / (1 + max(0.0, base))

    for _ in range(60):
        body = html_density.parse(page(4))
        nodes = html_density.measure(body)
        c, _, lc, _ = totals(body)
        own = {x: density(x, lc / max(1, c)) for x in nodes}
        sums = {x: sum(own[y] for y in x.items if not isinstance(y, str)) for x in nodes}
        assert all(math.isclose(x.density, own[x], abs_tol=1e-9) and math.isclose(x.total, sums[x], abs_tol=1e-9) for x in nodes)
        assert math.isclose(body.best.total, max(sums.values()), abs_tol=1e-9)


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a b"), ("<div><script>x", ""), ("a < b & c", "a < b & c"), ("<b>x</b>y", "xy"), ("<!-- <p>no</p> --><p>yes</p>", "yes"), ("<div>" * 3000 + "deep", "deep")])
def test_odd_pages(page, text):
    assert html_density.extract(page) == text


def test_html_rows(spark):
    data = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, n_chars int")
    got = html_density.extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert [r.n_chars == len(r.text) for r in got.collect()] == [True] * 3
    assert html_density.extract_text(pages.limit(0)).count() == 0


# --- classifier ---


def test_classifier_learns_and_scores_all(spark):
    rng = random.Random(6)
    good, bad = [f"good{i}" for i in range(300)], [f"bad{i}" for i in range(300)]
    data, labels = [], []
    for i in range(700):
        q = int(rng.random() < 0.8)
        data.append((i, " ".join(rng.choices((good if q else bad) + ["the", "of"], k=rng.randrange(20, 60)))))
        labels.append((i, q))
    data += [(9000, None), (9001, ""), (None, "null id"), (1, "again")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in data], "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (9002, None), (None, 1)], "doc_id long, quality int")
    out = fm_quality.score(docs, fm_quality.fit(docs, marks, sample=400)).collect()
    assert len(out) == len(data) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    truth, seen = dict(labels), set()
    held = []
    for r in out:
        if r.held_out and r.doc_id in truth and r.doc_id not in seen and r.doc_id != 1:
            held.append(r.predicted == truth[r.doc_id])
    assert np.mean(held) > 0.95
    empty = fm_quality.score(docs, fm_quality.fit(docs, marks.limit(0)))
    assert {r.score for r in empty.collect()} == {0.5}
    assert fm_quality.score(docs.limit(0), fm_quality.Model()).count() == 0


def test_identity_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    model = fm_quality.Model(0.3)
    model.linear[:] = rng.normal(size=model.linear.shape)
    model.factors[:] = rng.normal(size=model.factors.shape)
    number, value = np.array([1, 5, 9, 70]), np.array([0.5, -1.0, 2.0, 0.25])
    pairs = sum(model.factors[number[i]] @ model.factors[number[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    want = 0.3 + model.linear[number] @ value + pairs
    assert np.allclose(model.logits(np.array([0, 4]), number, value), want, atol=1e-3)
