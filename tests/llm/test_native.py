"""Quality rules, line dedup, licence scans and preference formatting on small tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import chat_preference, license_scan, line_dedup, quality_rules

DOCS = "doc_id long, text string, source string, n_words string, _host int"
SPACE = re.compile(r"[ \t-\r]+")


def rows(spark, data, schema=DOCS):
    return spark.createDataFrame(data, schema)


def repeat_words(words, k=8):
    seen = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    cover = {j for i in range(len(words) - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(i, i + k)}
    return len(cover)


TEXTS = [
    None,
    "",
    " \n\t ",
    "one two",
    "a b c d e f g h " * 4,
    "x " * 30,
    "The sun is in the sky and it is warm for all of us. " * 1 + "We go to the sea with the boat on a calm day and stay there until night falls.",
    "line one here\nline one here\nother\n\nline one here",
    "p1 p2 p3 p4 p5 p6 p7 p8 mid p1 p2 p3 p4 p5 p6 p7 p8 tail p3 p4 p5 p6 p7 p8 mid p1",
    "é ü 漢字 😀  nbsp 　wide " * 10,
    "#tag *star $5 %x &y | <b> " * 3,
]


def test_quality_counts_are_those_of_a_plain_count(spark):
    data = [(i, t, "s", "clash", 1) for i, t in enumerate(TEXTS)] * 2 + [(None, "dup", None, None, None)]
    got = quality_rules.judge(rows(spark, data)).collect()
    assert len(got) == len(data)
    for r in got:
        text = r.text or ""
        words = [w for w in SPACE.split(text) if w]
        lines = [x for x in text.split("\n") if SPACE.sub("", x)]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeat_words(words)
        assert r.base_failed == (len(words) < 20 or 100 * repeat_words(words) > 30 * len(words))
        assert not (r.base_failed and r.kept)
    assert any(r.kept for r in got)
    assert quality_rules.judge(rows(spark, [])).count() == 0


CLASH = ("_words", "_lines", "_w", "_s", "_p", "_counts", "_row", "_text", "_host", "_key", "_page", "_gone", "_hash", "_at", "_line", "n_lines", "n_words", "word_chars", "kept", "failed", "gone", "_gone_", "node", "text_a", "component_id", "length", "part", "a.b")


def clashing(spark, data):
    """Rows of doc_id, text, source and a column for each name that an operator uses within."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), *(T.StructField(c, T.StringType()) for c in CLASH)])
    return spark.createDataFrame([(*x, *(f"{c}-{i}" for c in CLASH)) for i, x in enumerate(data)], schema)


def test_quality_keeps_columns(spark):
    docs = clashing(spark, [(1, TEXTS[6], "s"), (2, "short", "s"), (None, TEXTS[6], None)])
    got = quality_rules.keep(docs)
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in docs.collect() if r.doc_id != 2]
    judged = quality_rules.judge(docs)
    assert set(quality_rules.ADDED) <= set(judged.columns) and "_words" in judged.columns and judged.first()["n_lines"] == "n_lines-0"


def test_lines_keep_columns(spark):
    docs = clashing(spark, [(i, f"menu\nown {i}", "a") for i in range(30)] + [(None, None, None)])
    got = line_dedup.drop_lines(docs, F.col("source"), counts=None)
    assert got.columns == docs.columns
    want = sorted(str((*r[:1], r[1] and r[1].removeprefix("menu\n"), *r[2:])) for r in docs.collect())
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    counted = line_dedup.drop_lines(docs, F.col("source"), counts=("n_lines", "kept"))
    assert counted.columns == [c for c in docs.columns if c not in ("n_lines", "kept")] + ["n_lines", "kept"]
    assert {(r.n_lines, r.kept) for r in counted.filter("source = 'a'").collect()} == {(2, 1)}


def test_licences_keep_columns(spark):
    docs = clashing(spark, [(1, "mit license", "s")])
    got = license_scan.scan(docs)
    assert [c for c in got.columns if c not in license_scan.ADDED] == [c for c in docs.columns if c not in license_scan.ADDED]
    assert got.first()["_words"] == "_words-0" and got.first()["n_words"] == 2


def test_long_texts(spark):
    """One text of a million words, or of as many lines, takes no more than its row."""
    many = " ".join(f"w{i} the" for i in range(500_000))
    docs = rows(spark, [(1, many + " mit license", "s", None, None), (2, "\n".join(["same", *(f"l{i}" for i in range(300_000)), "same"]), "s", None, None)])
    got = {r.doc_id: r for r in quality_rules.judge(docs.drop("n_words")).select("doc_id", "n_words", "n_dup_lines", "n_repeat_words").collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[2].n_dup_lines) == (1_000_002, 0, 1)
    found = {r.doc_id: (r.n_words, r.n_base, r.first_word) for r in license_scan.scan(docs).collect()}
    assert found[1] == (1_000_002, 1, 1_000_000)
    lines = line_dedup.drop_lines(docs, F.col("source"), min_pages=2, min_host_pages=1)
    assert {r.doc_id: r._n_dropped for r in lines.select("doc_id", "_n_dropped").collect()} == {1: 0, 2: 0}


def licence_places(text):
    """Labels, base places and score, word by word."""
    w = [x for x in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    labels, base, score = set(), [], 0.0
    for t, (label, template, start, n) in enumerate(license_scan.TEMPLATES):
        words = template.split()
        rare = [at for k, _, at in license_scan.INDEX if k == t]
        for at in range(len(w)):
            here = [at + i < len(w) and w[at + i] == x for i, x in enumerate(words)]
            if all(here[start : start + n]) and sum(here[i] for i in rare) >= license_scan.VOTES:
                labels.add(label)
                if t < license_scan.BASE:
                    base.append(at)
                score = max(score, sum(license_scan.IDF[x] for x, ok in zip(words, here, strict=True) if ok) / sum(license_scan.IDF[x] for x in words))
    return len(w), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(labels)), round(score, 4)


def test_licences_equal_brute_force(spark):
    import random

    rng, texts = random.Random(2), []
    for _, template, *_ in license_scan.TEMPLATES:
        w = template.split()
        for share in (0, 0.05, 0.2, 0.5):
            changed = [rng.choice(["x", "the", "license", x]) if rng.random() < share else x for x in w]
            texts.append(" ".join(["some", "words", "first", "of"] * rng.randrange(3) + changed + ["and", "more"]))
        texts.append(template.upper().replace(" ", ", ") + " / " + template)
        texts.append(" ".join(w[len(w) // 2 :]))
    texts += [" ".join(rng.choices("gnu general public license apache cc by mit nc version 2 0 3".split(), k=200)) for _ in range(20)]
    got = license_scan.scan(rows(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        *counts, score = licence_places(t)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == tuple(counts) and abs(r.score - score) < 2e-4, t


def test_lines(spark):
    menu = "Home | About"
    data = [(i, f"{menu}\nown text {i}\n\n{menu}", "a", "clash", 1) for i in range(30)]
    data += [(100 + i, f"{menu}\nother {i}" if i < 2 else f"other {i}", "b", "c", 1) for i in range(200)]
    data += [(300, None, "a", "c", 1), (301, "", "a", "c", 1), (302, menu, None, "c", 1), (0, f"{menu}\nown text 0\n\n{menu}", "a", "clash", 1), (None, f" {menu} \nlast", "a", "c", 1)]
    docs = rows(spark, data).drop("_host")
    out = line_dedup.drop_lines(docs, F.col("source"))
    assert set(docs.columns) < set(out.columns)
    got = {(r.doc_id, r.source): (r.text, r._n_dropped) for r in out.collect()}
    assert got[(3, "a")] == ("own text 3\n", 2) and got[(None, "a")] == ("last", 1)
    assert got[(100, "b")] == (f"{menu}\nother 0", 0)
    assert got[(300, "a")] == (None, 0) and got[(301, "a")] == ("", 0) and got[(302, None)] == (menu, 0)
    assert out.count() == len(data)
    assert line_dedup.drop_lines(docs.limit(0), F.col("source")).count() == 0


def test_licences(spark):
    data = [
        (1, "Released under the MIT License. See mit-license", "s", "c", 1),
        (2, "This work: GNU  General/Public License, version 3!", "s", "c", 1),
        (3, "cc by nc 4.0 and CC BY", "s", "c", 1),
        (4, None, None, None, None),
        (5, "", "s", "c", 1),
        (6, "mit licenses; apache-licence", "s", "c", 1),
        (7, "Permission is hereby granted, free of charge, to any person obtaining a copy", "s", "c", 1),
        (7, "gnu lesser general public license " * 3, "s", "c", 1),
        (8, "KIT License mıt license", "s", "c", 1),
    ]
    out = license_scan.scan(rows(spark, data))
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in out.orderBy("doc_id", "text").collect()]
    assert got[0] == (1, 8, 2, 3, 6, "mit", "mit")
    assert got[1] == (2, 8, 1, 2, 2, "gpl", "gpl,gpl-3.0")
    assert got[2] == (3, 8, 2, 0, 6, "cc-by", "cc-by,cc-by-nc")
    assert got[3][1:] == (0, 0, None, None, "", "") and got[4][1:] == (0, 0, None, None, "", "")
    assert got[5][2] == 0 and got[8][2] == 0
    assert got[6][6] == "mit" and got[6][5] == ""
    assert got[7][6] == "lgpl" and got[7][2] == 0
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert license_scan.scan(rows(spark, [])).count() == 0


TURNS = "conv_id long, turn long, role string, text string, prompt string"


def test_preference(spark):
    both = [("system", "S"), ("user", "Q")]
    data = [(0, i, r, t, "clash") for i, (r, t) in enumerate([*both, ("assistant", "good long answer")])]
    data += [(1, i, r, t, "clash") for i, (r, t) in enumerate([*both, ("assistant", "bad"), ("user", "why")])]
    data += [(2, 0, "user", "alone", None)]
    data += [(c, i, r, t, None) for c in (4, 5) for i, (r, t) in enumerate([("user", "same"), ("assistant", "same")])]
    data += [(6, 0, None, None, None), (6, 0, "user", "a", None), (6, 0, "user", "a", None), (7, None, "user", "b", None), (None, 0, "user", "none", None)]
    turns = spark.createDataFrame(data, TURNS)
    got = {r.pair_id: r for r in chat_preference.format_pairs(chat_preference.pair_conversations(turns)).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    a = got[0]
    assert (a.chosen_id, a.rejected_id, a.n_common, a.usable) == (0, 1, 2, True)
    assert a.prompt == "<|system|>\nS<|end|>\n<|user|>\nQ<|end|>\n"
    assert a.chosen_completion == "<|assistant|>\ngood long answer<|end|>\n" and a.chosen_mask == "14:0,24:1"
    assert a.rejected_completion.endswith("<|user|>\nwhy<|end|>\n") and a.rejected_mask == "14:0,11:1,20:0"
    assert (got[1].chosen_id, got[1].rejected_id, got[1].usable, got[1].rejected_completion) == (2, None, False, "")
    assert (got[2].usable, got[2].n_common, got[2].chosen_completion) == (False, 2, "")
    assert got[3].usable and got[3].n_common == 0
    for r in got.values():
        for side in ("chosen", "rejected"):
            runs = [int(x.split(":")[0]) for x in r[f"{side}_mask"].split(",") if x]
            assert sum(runs) == len(r[f"{side}_completion"])
    assert chat_preference.format_pairs(chat_preference.pair_conversations(turns.limit(0))).count() == 0


def _nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("run", [quality_rules.judge, license_scan.scan, lambda d: line_dedup.drop_lines(d.drop("_host"), F.col("source"))])
def test_no_python_in_native_plans(spark, run):
    assert not re.search("Python|Pandas|Arrow", _nodes(run(rows(spark, [(1, "a", "b", "c", 1)]))))


def test_pairs_keep_columns_of_any_name(spark):
    turns = "array<struct<role:string,text:string>>"
    long = [("user", "q")] + [("assistant", "word " * 20_000)] * 60
    rows = [(1, [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "c")], 10, 11, 12, "old", 13), (2, long, long[:-1], 20, 21, 22, "old", 23)]
    pairs = spark.createDataFrame(rows, f"id int, yes {turns}, no {turns}, _c int, _R int, _n int, Prompt string, `a.b` int")
    out = chat_preference.format_pairs(pairs, "yes", "no")
    assert out.columns == ["id", "_c", "_R", "_n", "a.b", "n_common", "prompt", "chosen_completion", "chosen_mask", "rejected_completion", "rejected_mask", "usable"]
    one, two = out.orderBy("id").collect()
    assert (one["_c"], one["_R"], one["_n"], one["a.b"], one.n_common, one.usable) == (10, 11, 12, 13, 1, True)
    assert one.prompt == "<|user|>\na<|end|>\n" and one.chosen_completion == "<|assistant|>\nb<|end|>\n"
    assert two.n_common == 60 and two.rejected_completion == "" and len(two.chosen_completion) > 100_000
