"""Nearest vectors by cells against all pairs."""

import numpy as np
import pytest

from tidemark.operators import search, vectors


def frame(spark, rows, key="vec_id"):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in rows], f"{key} long, embedding array<float>")


def brute(rows, asked, k):
    """Each query's k best by rounded cosine and key."""
    out = set()
    for q, a in asked:
        if a is None or None in a or not np.linalg.norm(a):
            continue
        a, found = np.array(a, np.float32).astype(float), []
        for key, b in rows:
            if key is None or key == q or b is None or None in b or len(b) != len(a) or not np.linalg.norm(b):
                continue
            b = np.array(b, np.float32).astype(float)
            c = np.floor(a @ b / np.linalg.norm(a) / np.linalg.norm(b) * 10000 + 0.5) / 10000
            if c > 0:
                found.append((-c, key))
        out |= {(q, key, -c) for c, key in sorted(found)[:k]}
    return out


def top(spark, rows, asked, k, **more):
    got = search.cosine_topk(frame(spark, rows), frame(spark, asked, "query_id"), k, **more).select("query_id", "vec_id", "relevance").collect()
    return {tuple(r) for r in got}


@pytest.fixture
def clustered():
    g = np.random.default_rng(7)
    middles = g.normal(size=(20, 24))
    return [(i, (middles[i % 20] + 0.15 * g.normal(size=24)).tolist()) for i in range(1200)]


def test_clusters_equal_brute_force_and_most_cells_are_never_scored(spark, clustered, monkeypatch):
    monkeypatch.setattr(vectors, "MEMBERS", 32)
    monkeypatch.setattr(vectors, "PIECE", 100)
    asked = clustered[::20] + clustered[7::40]
    assert top(spark, clustered, asked, 5) == brute(clustered, asked, 5)
    kept = vectors.Cells(frame(spark, clustered))
    own = frame(spark, asked, "query_id").selectExpr("query_id AS _q", "embedding").withColumn("_v", vectors._unit("embedding"))
    sizes = spark.createDataFrame(kept.cells)
    kth = {q: float(c) for q, _, c in sorted(brute(clustered, asked, 5), key=lambda x: -x[2])}
    told = own.join(spark.createDataFrame(list(kth.items()), "_q long, _t double"), "_q")
    scored = kept.pairs(own).unionByName(kept.pairs(told, later=True)).join(sizes, ["_dim", "_cell"]).agg({"_n": "sum"}).first()[0]
    assert scored < 0.35 * len(asked) * len(clustered)


def test_random_vectors_and_small_pieces_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIECE", 16)
    monkeypatch.setattr(vectors, "MEMBERS", 60)
    g = np.random.default_rng(8)
    rows = [(i, g.normal(size=8).tolist()) for i in range(300)]
    assert top(spark, rows, rows[::10], 7, block=8) == brute(rows, rows[::10], 7)


def test_ties_copies_nulls_and_other_lengths(spark):
    rows = [(i, [1, 2, 3]) for i in range(40)] + [(50, [0, 0, 0]), (51, None), (52, [1, None, 3]), (53, [1, 2]), (54, [2, 4]), (55, [-1, -2, -3]), (None, [1, 2, 3]), (56, [])]
    asked = [(0, [1, 2, 3]), (90, [3, 2, 1]), (53, [1, 2]), (91, [5]), (92, None), (93, [0, 0, 0]), (55, [-1, -2, -3])]
    assert top(spark, rows, asked, 4) == brute(rows, asked, 4)
    assert {v for q, v, _ in top(spark, rows, asked, 4) if q == 0} == {1, 2, 3, 4}


def test_empty_tables(spark):
    assert top(spark, [], [(1, [1, 2])], 3) == set() and top(spark, [(1, [1, 2])], [], 3) == set()
    assert top(spark, [(1, [1, 2])], [(1, [1, 2]), (2, [1, 2])], 3) == {(2, 1, 1.0)}
