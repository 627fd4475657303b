"""Spelling variant grouping (op 12) by a symmetric-delete join.

1. Words are counted: a task sums its own batches in a table of bounded size before anything is dealt out, so a very frequent word is a few rows.
2. Every word emits itself and its distinct single deletions, as 64-bit hashes of the strings, in time and rows linear in its length. A deletion
   carries the run of places that give the same string: two words of one length differ in one letter exactly if the same deletion comes from a common
   place, and a word is another one's deletion exactly if its own hash meets that. So the equi-join on hash, length and place gives hardly anything but
   true pairs, each once, and no pair of two words that merely share a deletion.
3. What met is verified on the words themselves: distance exactly one. Words of up to ``CARRIED`` letters travel with their hashes; longer ones, whose
   deletions would be as long as they are many, are fetched for the pairs that met.
4. A word's near words are aggregated in both directions: how many, and the one of largest count. Those that are ``RATIO`` times as frequent become its form.
5. Forms are followed to their last one by squaring the map, in written rounds: counts grow by ``RATIO`` a step, so few steps are needed.

A hash's bucket holds words that are alike but for one letter, so it is bounded by alphabet and length, however many rows the texts have.

Edge cases: null texts and texts without long words give nothing; null words aren't words; repeated rows of a word add up in ``count_words``, and in ``variants`` a word
must stand once. Equal counts go to the smaller word by code points. Very long runs are words like others. Empty tables give an empty one. Other columns
of the input, of whatever names, don't reach the operator.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import Workspace, prepare
from tidemark.llm.words import mix

#: Letters and occurrences of a word, how many times as frequent a form is, and of how many words of a text one loses a letter.
MIN_CHARS, MIN_COUNT, RATIO, NOISE = 7, 2, 10, 31
#: Words that a task counts before it hands them on, and letters of a word that travels with its hashes.
HELD, CARRIED = 100_000, 64

_BASE, _SELF = np.uint64(0x9E3779B97F4A7C15), -1


def _runs(min_chars: int) -> re.Pattern:
    return re.compile("[a-zÀ-ÿ]{%d,}" % min_chars)


def _garbled(run: str, start: int, noise: int) -> str:
    """The run without the letter that its hash names, if it names one; start is the checksum of what stands before it."""
    h = zlib.crc32(run.encode(), start)
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(min_chars: int, noise: int | None):
    """Batches of key and text to word and n, summed over the task as far as HELD words go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, held = _runs(min_chars), Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                found = Counter(runs.findall(text.as_py().encode().lower().decode())) if text.is_valid else ()
                if noise and found:
                    start = zlib.crc32(f"{key.as_py() or ''}:".encode())
                    for own, n in found.items():
                        own = _garbled(own, start, noise)
                        if len(own) >= min_chars:
                            held[own] += n
                elif found:
                    held.update(found)
                if len(held) >= HELD:
                    yield rows()
        yield rows()

    return run


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, noise: int | None = None) -> DataFrame:
    """word and n of the words of all whole texts: runs of a-z and U+00C0 to U+00FF, A-Z in lower case.

    With ``noise``, one of so many of a text's different words loses one letter, as told by the CRC-32 of key and word: misspellings that a rerun makes again.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").alias("text"))
    counted = docs.mapInArrow(_count(min_chars, noise), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _hashes(letters: np.ndarray) -> tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray]:
    """The word's hash, and of its distinct deletions the hash, the first and the last place that gives it."""
    n = len(letters)
    values = mix(letters.astype(np.uint64), np.full(n, _BASE))
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
    # polynomials: a letter's value times the base to the power of how many letters stand before it
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:n], dtype=np.uint64)])
    # what stands after a deleted letter moves to one power less
    moved = np.concatenate([np.cumsum((values[1:] * powers[: n - 1])[::-1], dtype=np.uint64)[::-1], np.zeros(1, np.uint64)])
    first = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]]))
    last = np.append(first[1:], n) - 1
    finish = lambda h, size: mix(h, np.full(len(h), size, np.uint64))
    return finish(before[n:], n)[0], finish(before[first] + moved[first], n - 1), first, last


_EMITTED = "key long, length int, low int, high int, id long, n long, word string"


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word itself (places SELF) and one for each distinct deletion; id is the word's own hash."""
    for batch in batches:
        keys, sizes, lows, highs, ids, lengths = [], [], [], [], [], []
        words = batch.column("word").to_pylist()
        for word in words:
            letters = np.frombuffer(word.encode("utf-32-le"), np.uint32)
            own, deleted, first, last = _hashes(letters)
            keys += [np.array([own]), deleted]
            lows += [[_SELF], first]
            highs += [[_SELF], last]
            ids.append(own)
            sizes.append(len(deleted) + 1)
            lengths.append(len(letters))
        at = np.repeat(np.arange(len(words)), sizes)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        lengths = np.array(lengths, np.int32)
        carried = pa.array([w if n <= CARRIED else None for w, n in zip(words, lengths, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(join(keys, np.uint64).view(np.int64)),
                pa.array(lengths[at]),
                pa.array(join(lows, np.int32)),
                pa.array(join(highs, np.int32)),
                pa.array(np.array(ids, np.uint64).view(np.int64)[at]),
                batch.column("n").take(pa.array(at)),
                carried.take(pa.array(at)),
            ],
            names=[c.split()[0] for c in _EMITTED.split(", ")],
        )


def _one_apart(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame, work: Workspace) -> DataFrame:
    """a, n_a, b, n_b: all pairs of words at distance one, each once, b the longer one or the one of the larger hash."""
    emitted = work.write(words.mapInArrow(_emit, _EMITTED), "deletions")
    a, b = (emitted.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("length", "low", "high", "id", "n", "word"))) for x in "ab")
    replaced = (F.col("length_a") == F.col("length_b")) & (F.col("id_a") < F.col("id_b")) & (F.greatest("low_a", "low_b") <= F.least("high_a", "high_b")) & (F.col("low_a") >= 0)
    deleted = (F.col("low_a") == _SELF) & (F.col("low_b") >= 0) & (F.col("length_b") == F.col("length_a") + 1)
    met = work.write(a.join(b, "key").filter(replaced | deleted).select("id_a", "n_a", "word_a", "id_b", "n_b", "word_b"), "met")
    pair = [F.col("word_a").alias("a"), "n_a", F.col("word_b").alias("b"), "n_b"]
    short = met.filter("word_a IS NOT NULL AND word_b IS NOT NULL").select(*pair)
    # words of one hash are all fetched, so that none is taken for another
    long_words = work.write(words.filter(F.length("word") >= CARRIED).mapInArrow(_named, "id long, word string, n long"), "long")
    one, two = (long_words.select(F.col("id").alias(f"id_{x}"), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    open_ = met.filter("word_a IS NULL OR word_b IS NULL").select("id_a", "id_b").distinct()
    long_ = open_.join(one, "id_a").join(two, "id_b").select(*pair)
    return short.unionByName(long_).filter(_one_apart(F.col("a"), F.col("b")))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [_hashes(np.frombuffer(w.encode("utf-32-le"), np.uint32))[0] for w in batch.column("word").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.uint64).view(np.int64)), batch.column("word"), batch.column("n")], names=["id", "word", "n"])


def _roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """word and root of all words that have a form (word, form)."""
    up = work.write(forms.select("word", F.col("form").alias("root")), "roots-0")
    rounds = 0
    while True:
        far = up.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        more = up.join(far, "root", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("moved"))
        rounds += 1
        more = work.write(more, f"roots-{rounds}")
        work.drop(f"roots-{rounds - 1}")
        up = more.select("word", "root")
        if more.filter("moved").isEmpty():
            return up


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of words (word, n): word must be unique."""
    spark = words.sparkSession
    prepare(spark)
    work = Workspace(spark, "spelling")
    words = work.write(words.filter("word <> ''").select("word", "n"), "words")
    pairs = near_pairs(words, work)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n"))))
    best = F.min(F.struct((-F.col("x.n")).alias("n"), F.col("x.near").alias("near")))
    found = pairs.select(both.alias("x")).groupBy("x.word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    known = words.join(found, "word", "left").withColumn("_formed", -F.col("_best.n") >= ratio * F.col("n"))
    known = work.write(known.select("word", F.when(F.col("_formed"), F.col("_best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_formed"), -F.col("_best.n")).alias("form_n")), "known")
    work.drop("deletions", "met", "long", "words")
    roots = _roots(known.filter("form IS NOT NULL"), work)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(count_words(docs, noise=NOISE))


SQL = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+') AS ws FROM documents),
r AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(ws) AS w FROM d) WHERE length(w) >= {MIN_CHARS} GROUP BY doc_id, w),
x AS (SELECT w, k, hex(encode(doc_id || ':' || w)) AS hx FROM r),
h AS (SELECT w, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM x, crc),
g AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM g WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
e AS (SELECT word, n, word AS kept, 0 AS place FROM v UNION ALL SELECT word, n, substr(word, 1, i - 1) || substr(word, i + 1), i FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT DISTINCT a.word AS word, b.word AS near, b.n AS near_n FROM e a JOIN e b ON a.kept = b.kept AND a.word <> b.word AND (a.place = b.place OR a.place = 0 OR b.place = 0)),
f AS (SELECT word, count(*) AS n_near, max(near_n) AS best FROM p GROUP BY word),
m AS (SELECT v.word, v.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN best >= {RATIO} * v.n THEN best END AS form_n, CASE WHEN best >= {RATIO} * v.n THEN (SELECT min(near) FROM p WHERE p.word = v.word AND near_n = best) END AS form FROM v LEFT JOIN f USING (word)),
o AS (SELECT word, word AS root, 0 AS hop FROM m UNION ALL SELECT o.word, m.form, hop + 1 FROM o JOIN m ON m.word = o.root WHERE m.form IS NOT NULL),
t AS (SELECT word, arg_max(root, hop) AS root FROM o GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM m JOIN t USING (word)
"""
