import random
import re

import numpy as np
import pytest

from tidemark.llm import jaccard_join


def sets_of(text, k=3):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(data, percent=90, k=3):
    """Smallest id that links reach, by a product of 0/1 matrices."""
    sets = [sets_of(t, k) for _, t in data]
    words = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(words)), np.float32)
    for i, s in enumerate(sets):
        m[i, [words[x] for x in s]] = 1
    shared, n = m @ m.T, m.sum(1)
    linked = (100 * shared >= percent * (n[:, None] + n - shared)) & (shared > 0)
    top = list(range(len(sets)))

    def find(a):
        while top[a] != a:
            top[a] = a = top[top[a]]
        return a

    for a, b in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        top[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(data):
        least[find(i)] = min(key, least.get(find(i), key))
    return {key: least[find(i)] for i, (key, _) in enumerate(data)}


def corpus(seed, crowds=((120, 250, (1, 2, 2, 3, 5)), (40, 120, (0, 1, 1, 2)), (300, 120, (2, 5, 9, 12)))):
    """Crowds around the threshold, a passage that a third of the texts share, copies, very short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts, passage = [], [word() for _ in range(40)]
    for size, crowd, edits in crowds:
        base = [word() for _ in range(size)]
        for _ in range(crowd):
            t = base.copy()
            for _ in range(rng.choice(edits)):
                at = rng.randrange(len(t))
                t[at : at + rng.choice([0, 1, 1, 2])] = [word() for _ in range(rng.choice([0, 1, 1, 2]))]
            texts.append(" ".join(t))
    for _ in range(200):
        t = [word() for _ in range(rng.randrange(1, 60))]
        at = rng.randrange(len(t))
        texts += [" ".join(t[:at] + passage + t[at:])] * rng.choice([1, 1, 2, 6])
    for _ in range(60):  # one edit at the end or the start: same prefixes are likely
        t = [word() for _ in range(rng.randrange(20, 90))]
        texts += [" ".join(t), " ".join([*t, word()]), " ".join(t[1:]), " ".join(t).upper()]
    texts += ["", "  \n", "one", "ONE", "one two", "two one", "a b c", "a b c d", "A\x0bB\x0cC", "   ", "É é", "é É"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "small", "percent", "shingle"), [(1, 16, 90, 3), (2, 2, 90, 3), (3, 5, 80, 1)])
def test_components_equal_brute_force(spark, monkeypatch, seed, small, percent, shingle):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    data = corpus(seed)
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(9)
    got = jaccard_join.link_sets(frame, shingle=shingle, percent=percent).collect()
    assert len(got) == len(data)
    want = brute([(i, t) for i, t in data if sets_of(t)], percent, shingle)
    assert {r.doc_id: r.component_id for r in got} == {i: want.get(i, i) for i, _ in data}
    sizes = {i: len(sets_of(t, shingle)) for i, t in data}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)
    assert 20 < len(set(want.values())) < len(want) - 200


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    long = " ".join(f"v{i}" for i in range(60_000))
    data = [(1, None, 7), (2, "", 7), (None, text, 7), (None, None, 7), (4, text, 7), (4, text, 8), (5, text.upper(), 9), (6, text + " tail", 1), (9, long, 1), (8, long + " more", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n int").selectExpr("*", "1 AS `group`", "2 AS component_id", "doc_id AS `the.key`")
    got = jaccard_join.link_sets(docs).collect()
    assert len(got) == len(data)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert by[(1, 0)] == 1 and by[(2, 0)] == 2 and by[(None, 48)] is None and by[(None, 0)] is None
    assert by[(4, 48)] == 4 and by[(5, 48)] == 4 and by[(6, 49)] == 4 and by[(9, 59_998)] == 8
    assert jaccard_join.link_sets(docs, key="the.key").count() == len(data)
    assert jaccard_join.link_sets(docs.limit(0)).count() == 0


def test_common_shingles_come_last(spark):
    data = corpus(5)
    ranks = jaccard_join.slot_ranks(spark.createDataFrame(data, "doc_id long, text string"), 3)
    assert sorted(ranks.tolist()) == list(range(1 << 16))
    run = jaccard_join._prefixed(3, 90, ranks)
    frame = spark.createDataFrame(data, "doc_id long, text string")
    rows = frame.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, prefix array<long>").collect()
    assert all(len(r.prefix) == (r.n - -(-90 * r.n // 100) + 1 if r.n else 0) and list(r.prefix) == sorted(r.prefix) for r in rows)
    # the shared passage is in more than a third of the texts, and in the prefixes of hardly any
    buckets = frame.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, prefix array<long>").selectExpr("n", "h1", "h2", "prefix").distinct()
    largest = buckets.selectExpr("explode(prefix) AS e").groupBy("e").count().agg({"count": "max"}).first()[0]
    assert largest < 260


def test_texts_that_share_single_shingles_do_not_meet(spark):
    """Of a small vocabulary every shingle is in many texts' prefixes; whole groups of shingles are in those of linked texts only."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(60, 200))) for _ in range(600)]
    texts += [f"{t} end" for t in texts[:50]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    run = jaccard_join._prefixed(3, 90, jaccard_join.slot_ranks(frame, 3), keyed=True)
    rows = frame.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, prefix array<long>, keys array<long>, owned int").persist()
    alone = rows.filter("doc_id >= 50 AND doc_id < 600")
    met = lambda c: alone.selectExpr(f"explode({c}) AS e").groupBy("e").count().filter("count > 1").agg({"count": "sum"}).first()[0] or 0
    assert met("prefix") > 2000 and met("keys") < 100
    high, differ = jaccard_join._classes(90, 1000)
    assert all(r.owned == differ[np.searchsorted(high, r.n)] + 1 for r in rows.collect())
    linked = rows.selectExpr("doc_id % 600 AS t", "doc_id", "explode(keys) AS e").groupBy("t", "e").agg({"doc_id": "max"}).filter("max(doc_id) >= 600")
    assert linked.select("t").distinct().count() == 50
    rows.unpersist()
