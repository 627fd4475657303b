import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import near_dedup
from tidemark.llm.components import components
from tidemark.llm.storage import Workspace


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(data):
    parent = {i: i for i, _ in data}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    sets = [(i, sets_of(t)) for i, t in data]
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, _ in data:
        groups[find(i)].append(i)
    return {i: min(g) for g in groups.values() for i in g}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    data = []
    base = [word() for _ in range(120)]
    for _ in range(320):  # a crowd around the threshold: some are linked, most are not
        t = base.copy()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            t[rng.randrange(120)] = word()
        data.append(" ".join(t))
    for _ in range(30):
        t = [word() for _ in range(rng.randrange(1, 80))]
        data += [" ".join(t)] * rng.choice([1, 2, 5])
    data += ["", " \n", "One two", "one TWO", "one two three", "Only"]
    rng.shuffle(data)
    return list(enumerate(data))


def test_components_equal_brute_force(spark):
    data = corpus()
    got = near_dedup.link_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == len(data)
    assert {r.doc_id: r.component_id for r in got} == brute(data)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    sizes = {i: len(sets_of(t)) for i, t in data}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    data = [(1, None, 7), (2, "", 7), (None, text, 7), (None, None, 7), (4, text, 7), (4, text, 8), (5, text.upper(), 9), (6, text + " tail", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, component_id int")
    got = near_dedup.link_documents(docs).collect()
    assert len(got) == len(data)
    by = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in got}
    assert by[(1, 0)] == (1, True) and by[(2, 0)] == (2, True) and by[(None, 46)] == (None, True)
    assert by[(4, 46)] == (4, True) and by[(5, 46)] == (4, False) and by[(6, 47)] == (4, False)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "4", "None", "None"]
    assert near_dedup.link_documents(docs.limit(0)).count() == 0


def components_of_sets(sets):
    """Exact components, by a product of 0/1 matrices."""
    words = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(words)), np.float32)
    for i, s in enumerate(sets):
        m[i, [words[x] for x in s]] = 1
    shared, n = m @ m.T, m.sum(1)
    linked = 100 * shared >= 85 * (n[:, None] + n - shared)
    top = list(range(len(sets)))

    def find(a):
        while top[a] != a:
            top[a] = a = top[top[a]]
        return a

    for a, b in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(sets))]


@pytest.mark.parametrize(("part", "middle"), [(200, 64), (17, 3)])
def test_crowds_around_the_threshold(spark, monkeypatch, part, middle):
    monkeypatch.setattr(near_dedup, "PART", part)
    monkeypatch.setattr(near_dedup, "MIDDLE", middle)
    rng, texts = random.Random(part), []
    word = lambda: f"w{rng.randrange(10**6)}"
    for size, crowd, edits in ((120, 900, (1, 2, 2, 3)), (60, 200, (0, 1, 1, 2)), (300, 300, (2, 4, 6, 8, 9))):
        base = [word() for _ in range(size)]
        for _ in range(crowd):
            t = base.copy()
            for _ in range(rng.choice(edits)):
                at = rng.randrange(len(t))
                t[at : at + rng.choice([0, 1, 1, 2])] = [word() for _ in range(rng.choice([0, 1, 1, 2]))]
            texts.append(" ".join(t))
    rng.shuffle(texts)
    got = near_dedup.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = components_of_sets([sets_of(t) for t in texts])
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(want))
    assert 20 < len(set(want)) < len(texts) - 300


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(links, Workspace(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_components_of_many_shapes(spark):
    rng = random.Random(2)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2600)] + [(9000, 9000 + i) for i in range(500)] + [(9500 - i, 9501 - i) for i in range(60)]
    top = {x: x for pair in links for x in pair}

    def find(a):
        while top[a] != a:
            top[a] = a = top[top[a]]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "test")).collect()}
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in top if x not in alone}
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), Workspace(spark, "test")).count() == 0
