import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import resampling

ALPHABET = {chr(c): chr(c + 32) for c in range(65, 91)}


def features(text, ngrams):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(ALPHABET.get(c, c) for c in text or ""))
    return len(own), [" ".join(own[i : i + n]) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(own) - n + 1)]


def brute(docs, target, ngrams=(1, 1), buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in features(x, ngrams)[1]) for texts in ([x for _, x in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    rows = []
    for key, text in docs:
        n_words, own = features(text, ngrams)
        weight = sum(gain(bucket(g)) for g in own)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = Counter()
    out = [(*r[:4], i + 1) for i, r in enumerate(able[: len(able) * percent // 100])]
    drawn.update(r[:4] for r in out)
    for r in rows:
        if drawn[r[:4]] and r[4]:
            drawn[r[:4]] -= 1
        else:
            out.append((*r[:4], None))
    return Counter(out)


def corpus(n=900):
    rng = random.Random(3)
    words = [f"{rng.choice(['Ab', 'x', 'é', 'Été', '7'])}{i}" for i in range(300)]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([0, 5, 19, 20, 60])))) for i in range(n)]
    hot = " ".join(words[:40])
    docs += [(n + i, hot) for i in range(n // 2)] + [(n * 2, None), (n * 2 + 1, ""), (n * 2 + 2, "word " * 150_000), (None, hot), (None, hot), (3, hot), (3, hot)]
    rng.shuffle(docs)
    return docs, [" ".join(words[20:60]), " ".join(words[30:50]) * 3, None, ""]


@pytest.mark.parametrize("options", [{}, {"ngrams": (1, 2), "buckets": 777}, {"percent": 100, "min_words": 0}, {"percent": 1, "seed": 5}])
def test_equals_brute_force(spark, options):
    docs, target = corpus()
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(x,) for x in target], "text string"), **options)
    names = {"min_words": "least"}
    want = brute(docs, target, **{names.get(k, k): v for k, v in options.items()})
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == want


def test_odd_tables(spark):
    docs, target = corpus(60)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    assert resampling.resample(frame.limit(0), wanted).count() == 0
    assert resampling.resample(frame, wanted, min_words=10**9).filter("rank IS NOT NULL").count() == 0
    none = resampling.resample(frame, wanted.limit(0)).collect()
    assert len(none) == len(docs) and Counter((r.doc_id, r.weight) for r in none) == Counter((k, w) for k, _, w, _, _ in brute(docs, []).elements())
    # names that the operator uses itself, and text keys
    named = frame.selectExpr("CAST(doc_id AS STRING) AS `key`", "text", "1 AS row", "2 AS score", "3 AS drawn", "4 AS `a.b`")
    drawn = resampling.draw(named, wanted, key="key", min_words=0)
    assert drawn.columns == named.columns
    ranked = resampling.resample(named, wanted, key="key", min_words=0)
    assert {r.key for r in drawn.collect()} == {r.key for r in ranked.filter("rank IS NOT NULL").collect()}
    assert sorted(r.rank for r in ranked.filter("rank IS NOT NULL").collect()) == list(range(1, len(docs) // 10 + 1))
    with pytest.raises(ValueError, match="uint16"):
        resampling.resample(frame, wanted, buckets=70_000)


def test_counts_over_many_blocks(spark, monkeypatch):
    docs, _ = corpus(200)
    monkeypatch.setattr(resampling, "BLOCK", 100)
    frame = spark.createDataFrame(docs, "key long, text string")
    streams = frame.mapInArrow(resampling._pack((1, 1), 1000), "keys array<long>, first long, n_words array<long>, sizes array<long>, stream binary")
    want = Counter(zlib.crc32(g.encode()) % 1000 for _, x in docs for g in features(x, (1, 1))[1])
    assert {r.bucket: r.n for r in resampling.bucket_counts(streams).collect()} == want
    assert streams.count() > 50
