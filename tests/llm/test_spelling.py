import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling
from tidemark.llm.storage import Workspace


def counts(docs, noise=None):
    found = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(words, ratio=10):
    form, out = {}, []
    for w, n in words.items():
        close = sorted((-words[x], x) for x in words if near(w, x))
        form[w] = close[0][1] if close and -close[0][0] >= ratio * n else None
        out.append((w, form[w], n, len(close), words[form[w]] if form[w] else None))

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, f, root(w), n, k, m) for w, f, n, k, m in out}


def words_of(seed, n=500):
    """Words of few letters and many repeats of them, with variants of variants."""
    rng = random.Random(seed)
    words = {}
    for _ in range(n // 10):
        w = "".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 7, 8, 12])))
        weight = rng.choice([100, 1000, 100_000])
        for _ in range(10):
            words[w] = max(1, weight)
            i = rng.randrange(len(w) + 1)
            w, weight = rng.choice([w[:i] + rng.choice("abéß") + w[i:], w[:i] + w[i + 1 :] or "a", w[:i] + rng.choice("abé") + w[i + 1 :]]), weight // rng.choice([1, 9, 10, 11, 30])
    for size in (63, 64, 65, 66, 300):  # around the letters that travel with their hashes
        w = "".join(rng.choice("ab") for _ in range(size))
        words |= {w: 1000, w[:30] + w[31:]: 100, w[:40] + "c" + w[40:]: 99, w[:50] + "z" + w[51:]: 5, w + "b": 100, w[1:]: 7}
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed):
    words = words_of(seed)
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(5))
    assert {tuple(r) for r in got.collect()} == brute(words)
    assert got.count() == len(words)


def test_words_of_texts(spark):
    rng = random.Random(4)
    words = ["Größenwahn", "Garantie", "ANFANG", "ÉCOLIER", "mÀnnlich", "vielleicht", "abcdefg", "x" * 200, "a×b÷cdefgh", "İstanbul", "naïveté"]
    docs = [(i, rng.choice([" ", "-", "1", "…"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 80])))) for i in range(120)]
    docs += [(None, "vielleicht vielleicht Garantie"), (None, None), (200, ""), (201, None), (202, "abcdefg " * 50_000), (202, "abcdefg"), (202, "abcdefg")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, word int, n int")
    for noise in (None, 31, 2):
        want = counts(docs, noise)
        assert {r.word: r.n for r in spelling.count_words(frame, noise=noise).collect()} == want
        assert {tuple(r) for r in spelling.variants(spelling.count_words(frame, noise=noise)).collect()} == brute(want)
    assert spelling.variants(spelling.count_words(frame.limit(0), noise=31)).count() == 0


def test_a_task_hands_on_what_it_holds(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 10)
    docs = [(i, " ".join(f"abcdefg{chr(97 + i % 26)}{chr(97 + j)}" for j in range(20))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.count_words(frame).collect()} == counts(docs)


def test_pairs_stand_once_and_fits(spark):
    words = words_of(7, 200)
    pairs = spelling.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long"), Workspace(spark, "test")).collect()
    got = Counter(frozenset((r.a, r.b)) for r in pairs)
    assert set(got.values()) == {1}
    assert set(got) == {frozenset((a, b)) for a in words for b in words if near(a, b)}
