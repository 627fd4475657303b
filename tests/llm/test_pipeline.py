import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm import packing, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_over_a_small_corpus(spark, tmp_path):
    base = "The {} is in the sky and it is warm for all of us who go to the sea with the boat on a calm day number {} and stay there until night falls"
    item = "this exact question of the benchmark must not be in the corpus at all since then a model knows it"
    data = [(i, base.format(f"sun{i}", i) + f"\nShared menu line\nOwn end of text {i} and {i * 7} and {i * 13}", "en", "a", 1) for i in range(60)]
    data += [(100, data[5][1], "en", "a", 1), (101, "junk", "en", "a", 1), (102, None, "en", "a", 1), (103, base.format("moon", 1) + " " + item + " and so on with more words to the end", "en", "b", 1)]
    folder = str(tmp_path)
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert not {101, 102} & ids["quality_rules"] and len(ids["quality_rules"]) == 62
    assert seen["line_dedup"].filter(F.contains("text", F.lit("Shared menu line"))).count() == 0
    assert seen["line_dedup"].filter(F.length("text") != F.col("n_chars")).count() == 0
    assert 100 not in ids["near_dedup"] and 5 in ids["near_dedup"]
    assert 103 in ids["near_dedup"] and 103 not in ids["decontamination"]
    assert ids["packing"] == ids["decontamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == ids["packing"]


EXTRA = ("_words", "_row", "_text", "_counts", "n_words", "n_lines", "kept", "_host", "_page", "_lines", "_gone", "gone", "_hash", "node", "component_id", "text_a", "text_b", "n", "key", "item_id", "id", "a.b")
BASE = "The {} is in the sky and it is warm for all of us who go to the sea with the boat on a calm day number {} and stay there until night falls"
ITEM = "this exact question of the benchmark must not be in the corpus at all since then a model knows it"


def odd_documents(spark, rows):
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in [*fields, *((c, T.StringType()) for c in EXTRA)]])
    return spark.createDataFrame([(*r, *(f"{c} of {i}" for c in EXTRA)) for i, r in enumerate(rows)], schema)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_on_odd_rows(spark, folder, stage):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns named like those within."""
    name, run = stage
    rng = random.Random(1)
    long_ = " ".join(f"the{rng.randrange(10**6)} of" for _ in range(150_000))
    rows = [(i, BASE.format(f"sun{i}", i) + f"\nmenu\nOwn end {i * 7} and {i * 13}", "en", "a", 5) for i in range(40)]
    rows += [(50, None, "en", "a", 5), (51, "", "en", "a", 5), (52, " \n ", "en", "a", 5), (None, rows[3][1], None, None, None), (None, None, None, None, None)]
    rows += [(60, long_, "en", "b", 5), (61, long_ + " end", "en", "b", 5), (70, BASE.format("x", 70) + " " + ITEM, "en", "b", 5), rows[7], rows[7], (7, rows[7][1], "en", None, 5)]
    docs = odd_documents(spark, rows)
    got = run(spark, docs, folder)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    before, after = docs.collect(), got.collect()
    place = {r["_words"]: r for r in before}
    assert len({r["_words"] for r in after}) == len(after)
    for r in after:  # a row's extra columns and ids are its own
        want = place[r["_words"]]
        assert all(r[c] == want[c] for c in docs.columns if c not in (("text", "n_chars") if name == "line_dedup" else ()))
    kept = {int(r["_words"].split()[-1]) for r in after}
    gone = {rows[i][0] for i in range(len(rows)) if i not in kept}
    if name == "quality_rules":
        assert {50, 51, 52} <= gone and 7 not in gone and 60 not in gone
    elif name == "line_dedup":
        assert not gone and all("menu" not in (r.text or "") for r in after if r.source == "a")
        assert {(r.text, r.n_chars) for r in after if r.doc_id in (50, 51)} == {(None, None), ("", 0)}
    elif name == "near_dedup":
        assert gone == {61} and sum(r.doc_id == 7 for r in after) == 4 and sum(r.doc_id is None for r in after) == 2
    else:
        assert gone == {70}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_empty_tables(spark, folder, stage):
    docs = odd_documents(spark, [(1, "x", "en", "a", 1)]).filter("doc_id > 1")
    got = stage[1](spark, docs, folder)
    assert got.count() == 0 and (stage[0] == "packing" or got.columns == docs.columns)


def test_packing_of_odd_rows(spark, folder):
    rows = [(1, None, None, None, None), (1, "", "en", "a", 1), (None, "a b", None, None, None), (None, "a b", None, None, None), (2, "word " * 200_000, "en", "a", 1)]
    got = corpus_pipeline.sequences(spark, odd_documents(spark, rows), folder).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got if r.doc_id != 2) == [(0, 0, 3), (0, 0, 3), (1, 0, 1), (1, 0, 1)]
    assert sum(r.length for r in got if r.doc_id == 2) >= 200_000 and max(r.offset + r.length for r in got) <= 1024


def plain_pipeline(documents, items):
    """The first four stages, document by document: ids that are left and their texts."""
    stops = {*quality_rules.STOP_WORDS, *(w.capitalize() for w in quality_rules.STOP_WORDS)}

    def good(text):
        w = text.split()
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = len({j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
        lines, n = [x for x in text.split("\n") if x.strip()], max(1, len(w))
        mean, symbols, frequent = sum(map(len, w)) / n, len(re.findall(r"[#*$%&|<>]", text)) / n, sum(x in stops for x in w) / n
        same = (len(lines) - len(set(lines))) / max(1, len(lines))
        return len(w) >= 20 and again / n <= 0.3 and symbols <= 0.25 and 2 <= mean <= 20 and frequent >= 0.005 and same <= 0.6

    docs = [(i, t, s) for i, t, s in documents if good(t or "")]
    pages, total = defaultdict(set), Counter(s for _, _, s in docs)
    for k, (_, t, s) in enumerate(docs):
        for line in t.split("\n"):
            if line.strip():
                pages[(s, line.strip())].add(k)
    bad = {x for x, on in pages.items() if len(on) >= 5 and total[x[0]] >= 20 and len(on) > 0.02 * total[x[0]]}
    docs = [(i, "\n".join(x for x in t.split("\n") if (s, x.strip()) not in bad), s) for i, t, s in docs]

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, top = [shingles(t) for _, t, _ in docs], list(range(len(docs)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for b in range(len(docs)):
        for a in range(b):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    docs = [d for k, d in enumerate(docs) if find(k) == k]
    grams = [g for g in (shingles(t) for t in items if len(t.split()) >= 5)]
    return {i: t for i, t, _ in docs if not any(10 * len(g & shingles(t)) >= 8 * len(g) for g in grams)}


def test_run_equals_a_plain_pipeline(spark, tmp_path):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(3000)] + quality_rules.STOP_WORDS * 20
    passage = lambda n: " ".join(rng.choices(words, k=n))
    items = [passage(n) for n in (6, 9, 15, 30, 60)]
    menu, documents = [passage(4) for _ in range(6)], []
    for i in range(220):
        t = passage(rng.choice([8, 25, 60, 150]))
        if rng.random() < 0.2:
            t = f"{t} {rng.choice(items)} {passage(20)}"
        if rng.random() < 0.5:
            t = f"{rng.choice(menu)}\n{t}\n{rng.choice(menu)} "
        if rng.random() < 0.1:
            t += " | # $ %" * 40
        documents.append((i, t, rng.choice(["a", "b", "c"])))
    for i in range(220, 300):
        t = rng.choice(documents)[1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            t[rng.randrange(len(t))] = "changed"
        documents.append((i, " ".join(t), rng.choice(["a", "b", "c"])))
    rng.shuffle(documents)
    documents = [(i, t, s) for i, (_, t, s) in enumerate(documents)]
    want, path = plain_pipeline(documents, items), str(tmp_path)
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in documents], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, path).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in want.items()}
    assert 60 < len(want) < 200
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(
        (i, j, a, n, zlib.crc32(np.array(x[a : a + n], "<u4").tobytes())) for i, x in ids.items() for j, (a, n) in enumerate(packing.cut(len(x)))
    )
    places = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places[r.sequence_id]
        places[r.sequence_id] += r.length
    assert max(places.values()) <= 1024
