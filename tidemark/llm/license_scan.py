"""Licence scans (op 2): a positional index of rare licence words.

``TEMPLATES`` are phrases that name a licence, and whole licence texts and notices. The index holds, for each template, its ``RARE``
highest-IDF words, and the ``VOTES`` highest of its key phrase, with their places; IDF is taken over the templates, so the index is a constant of the code. A file is looked up
word by word: each hit votes for a template and a start (its own place less the word's place in the template), so votes for one
start are postings that meet at their relative places. Starts with ``VOTES`` votes or more
are checked: the template's mandatory key phrase must stand there word for word. The score is the IDF weight of the template's
words that stand where they should, as a share of all the template's weight; the best start counts. So a whole text with some words
changed is found and scored by what is left of it, and a phrase is found just where it stands.

All of it is expressions over one row, without shuffle or Python. A file's votes are sorted, not compared in pairs, so a
long text of licence words costs n log n.

Edge cases: null and empty texts have no words, null places, empty labels and score 0. Overlapping places all count. A text that begins
in the middle of a template is before its own start, so it is no place of it. Repeated rows are judged one by one; extra columns of
any names pass, but for the seven that ``scan`` adds, which replace columns of their names. An empty table gives an empty one.
"""

from __future__ import annotations

import json
import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label, template, and start and length of its key phrase. The first four are the base phrases.
TEMPLATES = (
    ("gpl", "gnu general public license", 0, 4),
    ("apache", "apache license", 0, 2),
    ("cc-by", "cc by", 0, 2),
    ("mit", "mit license", 0, 2),
    ("lgpl", "gnu lesser general public license", 0, 5),
    ("agpl", "gnu affero general public license", 0, 5),
    ("mpl", "mozilla public license", 0, 3),
    ("cc-by", "creative commons attribution", 0, 3),
    ("cc-by-nc", "cc by nc", 0, 3),
    ("cc0", "creative commons zero", 0, 3),
    ("apache-2.0", "licensed under the apache license version 2 0", 3, 5),
    ("gpl-3.0", "gnu general public license version 3", 0, 6),
    ("reserved", "all rights reserved", 0, 3),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall "
        "be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but "
        "not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        0,
        8,
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of "
        "source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above "
        "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        0,
        8,
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
        "this permission notice appear in all copies",
        0,
        5,
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this "
        "software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
        "subject to the following restrictions",
        12,
        12,
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        "the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        8,
        7,
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either "
        "in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        2,
        8,
    ),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an "
        "as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and "
        "limitations under the license",
        3,
        5,
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any "
        "warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        18,
        4,
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software "
        "foundation either version 2 1 of the license or at your option any later version",
        18,
        5,
    ),
    (
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software "
        "foundation either version 3 of the license or at your option any later version",
        18,
        5,
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", 11, 3),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0", 6, 3),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", 14, 9),
)
BASE = 4
#: Indexed words of a whole template, and postings that must meet at one start: a key phrase has as many of its own.
RARE, VOTES = 6, 2
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _weights() -> dict[str, float]:
    texts = [set(t.split()) for _, t, _, _ in TEMPLATES]
    return {w: round(math.log(1 + len(texts) / sum(w in t for t in texts)), 6) for w in sorted(set().union(*texts))}


IDF = _weights()


def index() -> list[tuple[int, str, int]]:
    """Template, word and place: the highest-IDF words of each key phrase, VOTES of them, and of each whole template, RARE; of equal ones the earlier."""
    out = []
    for t, (_, text, start, n) in enumerate(TEMPLATES):
        words = text.split()
        first = {w: i for i, w in reversed(list(enumerate(words)))}
        within = {w: i for i, w in reversed(list(enumerate(words))[start : start + n])}
        rarest = lambda places, k: sorted(places, key=lambda w: (-IDF[w], places[w]))[:k]
        picked = {w: first[w] for w in rarest(first, RARE)} | {w: within[w] for w in rarest(within, VOTES)}
        out += [(t, w, at) for w, at in picked.items()]
    return out


INDEX = index()


def _postings(word: Column) -> Column:
    """array<struct<t, at>> of a word."""
    by: dict[str, list[dict[str, int]]] = {}
    for t, w, at in INDEX:
        by.setdefault(w, []).append({"t": t, "at": at})
    return F.try_element_at(F.from_json(F.lit(json.dumps(by)), "map<string, array<struct<t: int, at: int>>>"), word)


def _pick(t: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), t)


ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(files: DataFrame, text: str = "text") -> DataFrame:
    """files with n_words, n_base, first_word, last_word, base_labels, labels and score."""
    lower = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    row = F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("_row")
    df = files.select(row, F.array_remove(F.split(lower, _SPLIT), "").alias("_words"))
    rare = sorted({w for _, w, _ in INDEX})
    n = F.size("_words")
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_hits", F.filter(every, lambda i: F.get("_words", i).isin(rare)))
    votes = F.flatten(F.transform("_hits", lambda i: F.transform(_postings(F.get("_words", i)), lambda p: F.struct((i - p["at"]).alias("start"), p["t"].alias("t")))))
    df = df.withColumn("_votes", F.array_sort(votes))
    # a start with VOTES equal votes in the sorted list; the first of them stands for it
    full = F.filter("_votes", lambda v, i: (v["start"] >= 0) & F.coalesce(F.get("_votes", i + VOTES - 1) == v, F.lit(False)))
    df = df.withColumn("_starts", F.array_distinct(full))
    texts = [t.split() for _, t, _, _ in TEMPLATES]
    phrases = [" ".join(w[s : s + k]) for w, (_, _, s, k) in zip(texts, TEMPLATES, strict=True)]
    begin, length = [s for *_, s, _ in TEMPLATES], [k for *_, k in TEMPLATES]
    here = lambda v: F.array_join(F.slice("_words", v["start"] + 1 + _pick(v["t"], begin), _pick(v["t"], length)), " ")
    df = df.withColumn("_found", F.filter("_starts", lambda v: here(v) == _pick(v["t"], phrases)))
    df = df.withColumn("_base", F.filter("_found", lambda v: v["t"] < BASE))
    labels = [x for x, *_ in TEMPLATES]
    words = F.array(*[F.split(F.lit(" ".join(x)), " ") for x in texts])
    shares = F.array(*[F.split(F.lit(" ".join(repr(IDF[w]) for w in x)), " ").cast("array<double>") for x in texts])
    total = [sum(IDF[w] for w in x) for x in texts]

    def share(v: Column) -> Column:
        own = F.slice("_words", v["start"] + 1, F.size(F.get(words, v["t"])))
        met = F.zip_with(F.zip_with(own, F.get(words, v["t"]), lambda a, b: F.coalesce(a == b, F.lit(False))), F.get(shares, v["t"]), lambda ok, w: F.when(F.coalesce(ok, F.lit(False)), w).otherwise(0.0))
        return F.aggregate(met, F.lit(0.0), lambda a, b: a + b) / _pick(v["t"], total)

    named = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda v: _pick(v["t"], labels)))), ",")
    starts = F.transform("_base", lambda v: v["start"])
    added = {
        "n_words": n.cast("long"),
        "n_base": F.size("_base").cast("long"),
        "first_word": F.array_min(starts).cast("long"),
        "last_word": F.array_max(starts).cast("long"),
        "base_labels": named("_base"),
        "labels": named("_found"),
        "score": F.round(F.coalesce(F.array_max(F.transform("_found", share)), F.lit(0.0)), 4),
    }
    df = df.withColumn("_added", F.struct(*[x.alias(c) for c, x in added.items()]))
    return df.select(*[F.col(f"_row.`{c}`") for c in files.columns if c.lower() not in ADDED], "_added.*")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).drop("text")


def _sql() -> str:
    rows = [f"({t}, '{label}', '{text}', '{' '.join(text.split()[s : s + k])}', {s}, {k}, {t < BASE}, {sum(IDF[w] for w in text.split())!r})" for t, (label, text, s, k) in enumerate(TEMPLATES)]
    idf = ", ".join(f"('{w}', {v!r})" for w, v in IDF.items())
    rare = ", ".join(f"({t}, {at})" for t, _, at in INDEX)
    return rf"""
WITH tpl(t, label, text, phrase, s, k, base, total) AS (VALUES {", ".join(rows)}),
idf(word, x) AS (VALUES {idf}),
rare(t, place) AS (VALUES {rare}),
tw AS (SELECT a.*, rare.place IS NOT NULL AS votes FROM (SELECT t, unnest(range(len(string_split(text, ' ')))) AS place, unnest(string_split(text, ' ')) AS word FROM tpl) a LEFT JOIN rare USING (t, place)),
d AS (SELECT row_number() OVER () AS rid, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, unnest(range(len(w))) AS i, unnest(w) AS first FROM d),
c AS (SELECT p.rid, tpl.t, p.i - tpl.s AS start, d.w FROM p JOIN tpl ON p.first = string_split(tpl.phrase, ' ')[1] JOIN d USING (rid)
  WHERE p.i >= tpl.s AND array_to_string(d.w[p.i + 1 : p.i + tpl.k], ' ') = tpl.phrase),
m AS (SELECT c.rid, c.t, c.start, sum(CASE WHEN c.w[c.start + tw.place + 1] = tw.word THEN idf.x ELSE 0 END) AS x
  FROM c JOIN tw USING (t) JOIN idf USING (word) GROUP BY c.rid, c.t, c.start HAVING count(*) FILTER (tw.votes AND c.w[c.start + tw.place + 1] = tw.word) >= {VOTES}),
g AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS a, max(start) FILTER (base) AS b,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS l, max(x / total) AS score
  FROM m JOIN tpl USING (t) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word,
  coalesce(bl, '') AS base_labels, coalesce(l, '') AS labels, CAST(round(coalesce(score, 0), 4) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (rid)
"""


SQL = _sql()
