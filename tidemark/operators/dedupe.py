"""Relations between facts: comparison, neighbours by SimHash, groups and merges."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import types as ty

from tidemark.functions import text as tx

RATIO, SUBSET, SAME_NUMBERS, SIMILAR = 0.45, 0.9, 0.45, 0.82
#: Bits of the six parts of a fingerprint, and how many of them make a key.
PARTS, KEY_PARTS = (11, 11, 11, 11, 10, 10), 3

_FNV_START, _FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def fnv1a64(word: bytes) -> int:
    """FNV-1a: xor with a byte, then times the prime, modulo 2**64."""
    value = 0xCBF29CE484222325
    for byte in word:
        value = (value ^ byte) * 0x100000001B3 % 2**64
    return value


def _fnv(words: list[bytes]) -> np.ndarray:
    """FNV-1a of many words: all words' n-th bytes at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    starts, value = np.cumsum(sizes) - sizes, np.full(len(words), _FNV_START)
    for i in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > i)
        value[on] = (value[on] ^ flat[starts[on] + i]) * _FNV_PRIME
    return value


#: Tokens whose bits are held at one time.
_TOKENS = 200_000


def simhashes(rows: list[np.ndarray]) -> np.ndarray:
    """64-bit SimHash of each row's tokens as a signed number; 0 without tokens. Each different word of a batch is hashed once."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    out, at = np.zeros(len(rows), np.uint64), 0
    ends = np.cumsum(sizes)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOKENS, "right")))
        full = np.flatnonzero(sizes[at:stop]) + at
        if len(full):
            number, words = pd.factorize(np.concatenate([np.asarray(rows[i], object) for i in full]))
            hashes = _fnv([w.encode() for w in words]).astype("<u8")
            # a byte for each bit, eight to a number: differences of running sums over 255 tokens at most carry nothing over
            bits = np.unpackbits(hashes[:, None].view(np.uint8), axis=1, bitorder="little").view(np.uint64)
            sums = np.zeros((len(number) + 1, 8), np.uint64)
            np.cumsum(bits[number], axis=0, out=sums[1:])
            n, cuts = sizes[full], -(-sizes[full] // 255)
            first, last = np.cumsum(n) - n, np.cumsum(cuts)
            starts = np.repeat(first, cuts) + 255 * (np.arange(last[-1]) - np.repeat(last - cuts, cuts))
            ones = np.diff(sums[np.append(starts, len(number))], axis=0).view(np.uint8)
            ones = np.add.reduceat(ones, last - cuts, axis=0, dtype=np.int64)
            out[full] = np.bitwise_or.reduce(np.where(2 * ones > n[:, None], powers, np.uint64(0)), axis=1)
        at = stop
    return out.view(np.int64)


def simhash(tokens: list[str]) -> int:
    return int(simhashes([tokens])[0])


@F.pandas_udf(ty.LONG)
def simhash64(normalized: pd.Series) -> pd.Series:
    """SimHash of a normalised text's index tokens; hashes and votes are taken a batch at a time."""
    return pd.Series(simhashes([tx.tokens_of(t) for t in normalized]))


def simhash_bucket(h: Column) -> Column:
    """The top 16 bits."""
    return F.shiftrightunsigned(h, 48).cast("int")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def compare(df: DataFrame, old: str, new: str) -> DataFrame:
    """df with action (duplicate, conflict, unrelated), keep and similarity of two answers; the first rule that holds decides."""
    a, b = tx.comparable(F.col(old)), tx.comparable(F.col(new))
    df = df.withColumns({"_a": a, "_b": b, "_na": F.array_sort(F.array_distinct(tx.numbers_in(F.col(old)))), "_nb": F.array_sort(F.array_distinct(tx.numbers_in(F.col(new))))})
    df = df.withColumns({"_ga": tx.bigrams(F.col("_a")), "_gb": tx.bigrams(F.col("_b"))})
    la, lb = F.length("_a"), F.length("_b")
    both = F.size(F.array_intersect("_ga", "_gb"))
    empty = (F.size("_ga") == 0) | (F.size("_gb") == 0)
    score = F.when(empty, F.when(F.size("_ga") == F.size("_gb"), 1.0).otherwise(0.0)).otherwise(F.round(2 * both / (F.size("_ga") + F.size("_gb")), 4))
    share = F.when(empty, 0.0).otherwise(F.round(both / F.when(la <= lb, F.size("_ga")).otherwise(F.size("_gb")), 4))
    numbered = (F.size("_na") > 0) & (F.size("_nb") > 0)
    short, long_ = F.least(la, lb), F.greatest(la, lb)
    within = F.when(la >= lb, F.contains("_a", "_b")).otherwise(F.contains("_b", "_a"))
    keep = F.when(la >= lb, "existing").otherwise("candidate")
    df = df.withColumns({"_s": score, "_c": share})
    rule = (
        F.when((F.col("_a") == F.col("_b")), "same")
        .when(numbered & (F.col("_na") != F.col("_nb")), "numbers")
        .when((short > 0) & (short >= RATIO * long_) & within, "contained")
        .when((short >= 2) & (short >= RATIO * long_) & (F.col("_c") >= SUBSET), "subset")
        .when(numbered & F.exists("_na", lambda n: F.length(n) >= 2) & (F.col("_s") >= SAME_NUMBERS), "same_numbers")
        .when(F.col("_s") >= SIMILAR, "similar")
        .otherwise("unrelated")
    )
    df = df.withColumns({"rule": rule, "similarity": F.col("_s")})
    action = F.when(F.col("rule") == "numbers", "conflict").when(F.col("rule") == "unrelated", "unrelated").otherwise("duplicate")
    kept = F.when(F.col("rule") == "same", "existing").when(action != "duplicate", "both").otherwise(keep)
    return df.withColumns({"action": action, "keep": kept}).drop("_a", "_b", "_na", "_nb", "_ga", "_gb", "_s", "_c")


def _key_masks() -> list[int]:
    """The bits of each choice of three parts, as signed numbers. A part takes every sixth bit: texts share keys of neighbouring bits far more often."""
    parts = [sum(1 << len(PARTS) * j + i for j in range(n)) for i, n in enumerate(PARTS)]
    masks = [sum(chosen) for chosen in combinations(parts, KEY_PARTS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def simhash_neighbours(rows: DataFrame, others: DataFrame, key: str = "id", h: str = "simhash", limit: int | None = None, distance: int = 3) -> DataFrame:
    """key, other and distance: the rows of ``others`` within the distance, 3 at most, whose top 16 bits differ by two at most.

    With a limit, the nearest ones only, and their rank.
    Of six parts three are equal where three bits differ, so rows meet in an equi-join on one of twenty tables, whose keys are the 31 to 33 bits of three
    parts: rows that merely share a key are few, however many rows there are. A pair with several equal keys counts at the first.
    """
    if distance > len(PARTS) - KEY_PARTS:
        raise ValueError(f"keys of {KEY_PARTS} of {len(PARTS)} parts find distances up to {len(PARTS) - KEY_PARTS}")
    masks = _key_masks()
    keys = lambda c: F.posexplode(F.array(*[c.bitwiseAND(F.lit(m)) for m in masks])).alias("_i", "_b")
    probe = rows.select(F.col(key), F.col(h).alias("_h"), keys(F.col(h)))
    index = others.select(F.col(key).alias("other"), F.col(h).alias("_g"), keys(F.col(h)))
    both = F.col("_h").bitwiseXOR(F.col("_g"))
    first = F.array_position(F.array(*[both.bitwiseAND(F.lit(m)) == 0 for m in masks]), True) == F.col("_i") + 1
    # the planner takes the keys for one row a fact, so it would send twenty times what it means to through the driver
    near = probe.join(index.hint("merge"), ["_i", "_b"]).filter((F.col(key) != F.col("other")) & (hamming(F.col("_h"), F.col("_g")) <= distance) & first)
    near = near.filter(F.bit_count(F.shiftrightunsigned(both, 48)) <= 2).withColumn("distance", hamming(F.col("_h"), F.col("_g")))
    if limit is None:
        return near.select(key, "other", "distance")
    w = Window.partitionBy(key).orderBy("distance", F.desc("other"))
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(key, "other", "distance", "rank")


def duplicate_groups(facts: DataFrame, key: str = "id", title: str = "title", answer: str = "answer", block: int = 200) -> DataFrame:
    """Pairs of one title whose answers are duplicates or in conflict.

    Exact copies of an answer are one member, compared once. A title's members are compared in blocks, so a task holds two
    blocks at most, whatever the title's size.
    """
    members = facts.groupBy(tx.comparable(F.col(title)).alias("_t"), F.col(answer).alias("_answer")).agg(F.min(key).alias("id"))
    spread = members.groupBy("_t").agg(F.count("*").alias("_n")).filter("_n > 1").withColumn("_parts", F.ceil(F.col("_n") / block).cast("int"))
    cut = members.join(spread, "_t").withColumn("_p", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    left = cut.select("_t", "_p", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_q"), F.col("id").alias("a"), F.col("_answer").alias("_old"))
    right = cut.select("_t", F.col("_p").alias("_q"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_p"), F.col("id").alias("b"), F.col("_answer").alias("_new"))
    return compare(left.join(right, ["_t", "_p", "_q"]).filter("a < b"), "_old", "_new").filter("action <> 'unrelated'").select("a", "b", "action", "keep", "similarity", "rule")


def merge_report(pairs: DataFrame, facts: DataFrame, key: str = "id") -> DataFrame:
    """Which of each duplicate pair stays: higher confidence, then the longer answer, then the smaller id."""
    one = facts.select(F.col(key).alias("a"), F.struct(F.col("confidence"), F.length("answer").alias("n")).alias("_x"))
    two = facts.select(F.col(key).alias("b"), F.struct(F.col("confidence"), F.length("answer").alias("n")).alias("_y"))
    both = pairs.filter("action = 'duplicate'").join(one, "a").join(two, "b")
    first = F.col("_x") >= F.col("_y")
    return both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("keeper"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("superseded"))


def find_duplicate(candidates: DataFrame, facts: DataFrame, same_title: int = 6) -> DataFrame:
    """For each candidate (cid, title, answer, simhash) the fact that it repeats, or the first conflict of its title.

    Facts of the same title come first, the most trusted ones; then SimHash neighbours of other titles, which only count as duplicates.
    """
    titled = facts.select("id", tx.comparable(F.col("title")).alias("_t"), F.col("answer").alias("_old"), "confidence", F.coalesce("updated_at", F.lit("")).alias("_u"))
    asked = candidates.select("cid", tx.comparable(F.col("title")).alias("_t"), F.col("answer").alias("_new"))
    w = Window.partitionBy("cid").orderBy(F.desc("confidence"), F.desc("_u"), "id")
    own = asked.join(titled.hint("merge"), "_t").withColumn("_seq", F.row_number().over(w)).filter(F.col("_seq") <= same_title)
    near = simhash_neighbours(candidates.select(F.col("cid").alias("id"), "simhash"), facts.select("id", "simhash"), limit=20)
    near = near.select(F.col("id").alias("cid"), F.col("other").alias("id"), (F.col("rank") + 1000).alias("_seq"))
    near = near.join(titled.select("id", "_old", F.col("_t").alias("_u2")).hint("merge"), "id").join(asked.select("cid", "_new", "_t").hint("merge"), "cid").filter("_t <> _u2")
    every = compare(own.select("cid", "id", "_seq", "_old", "_new").unionByName(near.select("cid", "id", "_seq", "_old", "_new")), "_old", "_new")
    every = every.filter((F.col("action") == "duplicate") | ((F.col("action") == "conflict") & (F.col("_seq") <= 1000)))
    order = Window.partitionBy("cid").orderBy(F.col("action") != "duplicate", "_seq")
    return every.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("cid", "id", "action", "keep", "rule")


_KEPT = ["seq", "title", "answer", "tags", "source_url", "confidence", "merged"]


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First fit in the given order: a row joins the first keeper of its title that it repeats. Rows come by title and order."""
    from tidemark.operators.facts_py import Answer, Keepers

    title, rows, kept = None, [], Keepers()
    for batch in batches:
        done: list[dict] = []
        for row in batch.to_dict("records"):
            if row["_t"] != title:
                done += rows
                title, rows, kept = row["_t"], [], Keepers()
            new = Answer(row["answer"])
            at = kept.first_repeated_by(new)
            if at is None:
                kept.add(new)
                rows.append(row | {"tags": _with_sources(row["tags"], row["sources"])})
            else:
                k = rows[at]
                k["answer"], k["confidence"] = kept.merge(at, new), max(k["confidence"], row["confidence"])
                k["tags"] = _with_sources(k["tags"], [row["own"], *row["sources"]])
                k["merged"] += 1 + row["merged"]
        yield pd.DataFrame(done, columns=_KEPT)
    yield pd.DataFrame(rows, columns=_KEPT)


def _with_sources(tags: str | None, sources: list[str]) -> str:
    for source in sources:
        mark = f"并入:{source}"
        if mark not in (tags or ""):
            tags = f"{tags or ''} {mark}".strip()
    return tags


def merge_seed_facts(facts: DataFrame, sequence: str = "seq") -> DataFrame:
    """Facts of one title are folded in order; the order is a column, so the result is the same at any parallelism.

    Exact repeats of title and answer are one row before the fold, by sums that are made before rows are dealt out: the first of them, the highest confidence,
    and the sources of the others in order of their first place. So a task folds a title's different answers, however often each stands.
    """
    source = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("source_url", F.lit("")), r"^https?://([^/]+)", 1), F.lit("")), F.lit("重复"))
    rows = facts.withColumns({"_t": tx.comparable(F.col("title")), "_source": source}).select("_t", "_source", F.col(sequence).alias("seq"), "title", "answer", "tags", "source_url", "confidence")
    first = F.struct("seq", "title", "tags", "source_url", F.col("_source").alias("own"))
    per_source = rows.groupBy("_t", "answer", "_source").agg(F.min(first).alias("x"), F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    again = F.struct(F.col("x.seq").alias("seq"), F.col("_source").alias("source"), F.col("n").alias("n"))
    once = per_source.groupBy("_t", "answer").agg(F.min("x").alias("x"), F.max("confidence").alias("confidence"), (F.sum("n") - 1).cast("int").alias("merged"), F.array_sort(F.collect_list(again)).alias("_again"))
    # the first row's own source counts among the merged ones only if another row has it too
    others = F.filter("_again", lambda s: (s["source"] != F.col("x.own")) | (s["n"] > 1))
    ready = once.select("_t", "x.seq", "x.title", "answer", "x.tags", "x.source_url", "x.own", F.transform(others, lambda s: s["source"]).alias("sources"), "confidence", "merged")
    ordered = ready.repartition("_t").sortWithinPartitions("_t", "seq")
    return ordered.mapInPandas(_fold, "seq long, title string, answer string, tags string, source_url string, confidence double, merged int")


def merge_into(existing: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """Facts with confirmations merged in: joined answer, higher confidence, a tag for the other domain."""
    joined = existing.join(other.select(key, F.col("answer").alias("_answer"), F.col("source_url").alias("_url"), F.col("confidence").alias("_c")), key, "left")
    domain = F.regexp_extract(F.coalesce("_url", F.lit("")), r"^https?://([^/]+)", 1)
    tags = F.when((domain != "") & F.col("_answer").isNotNull(), tx.ensure_extra_tag(F.col("tags"), F.concat(F.lit("并入:"), domain))).otherwise(F.col("tags"))
    return joined.withColumns({"answer": F.when(F.col("_answer").isNull(), F.col("answer")).otherwise(tx.merge_answers(F.col("answer"), F.col("_answer"))), "confidence": F.greatest("confidence", F.coalesce("_c", F.lit(0.0))), "tags": tags}).drop("_answer", "_url", "_c")


def credit_multi_source(facts: DataFrame, confirmations: DataFrame, key: str = "id", bonus: float = 0.08) -> DataFrame:
    """Facts that another page confirms get the bonus once, up to 1."""
    seen = confirmations.join(facts.select(key, F.col("source_url").alias("_own")), key).filter(F.col("url") != F.col("_own")).select(key).distinct().withColumn("_hit", F.lit(True))
    out = facts.join(seen, key, "left")
    new = F.col("_hit").isNotNull() & ~F.contains(F.coalesce("tags", F.lit("")), F.lit("多源确认"))
    return out.withColumns({"confidence": F.when(new, F.round(F.least(F.lit(1.0), F.col("confidence") + bonus), 4)).otherwise(F.col("confidence")), "tags": F.when(new, tx.ensure_extra_tag(F.col("tags"), F.lit("多源确认"))).otherwise(F.col("tags"))}).drop("_hit")


def decide_tier(candidates: DataFrame, similar: DataFrame) -> DataFrame:
    """cid, target and decision by the tier of the best similar fact: higher supersedes, lower is skipped, equal needs a model."""
    from tidemark.functions.urls import source_tier

    w = Window.partitionBy("cid").orderBy(F.desc("_tier"), F.desc(F.coalesce("updated_at", F.lit(""))), "id")
    best = similar.withColumn("_tier", source_tier(F.col("source_type"))).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    own = candidates.select("cid", source_tier(F.col("source_type")).alias("_own"))
    verdict = F.when(F.col("_own") > F.col("_tier"), "supersede").when(F.col("_own") < F.col("_tier"), "skip_lower_tier").otherwise("model")
    return best.join(own, "cid").select("cid", F.col("id").alias("target"), verdict.alias("decision"))
