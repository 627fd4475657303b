"""Audits, reports and evaluation metrics over documents and facts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as tx
from tidemark.functions import types as ty
from tidemark.operators import names
from tidemark.operators.steps import settle

#: Groups of bigrams over which copies' multisets are summed (a power of two), texts of a block, and rows of a tile of two blocks.
SUMS, BLOCK, TILE = 32, 8192, 128
#: Characters of a template's head, and white space as the surveyed audit takes it.
HEAD, SPACE = 40, tx.WHITE + "\x1c\x1d\x1e\x1f"


def stats(rows: DataFrame, by: str) -> DataFrame:
    """Rows, active rows and characters of each value of by."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("n_active"))


def kb_report(facts: DataFrame) -> DataFrame:
    """One row of counts, missing fields, confidence and length statistics."""
    blank = lambda c: F.count_if(F.coalesce(F.btrim(c), F.lit("")) == "")
    return facts.agg(
        F.count("*").alias("facts"),
        F.count_distinct("source_type").alias("tiers"),
        F.count_distinct("domain").alias("domains"),
        blank("source_url").alias("missing_url"),
        blank("tags").alias("missing_tag"),
        F.count_distinct("confidence").alias("confidence_unique"),
        F.round(F.count_if(F.col("confidence") >= 0.9) / F.greatest(F.count("*"), F.lit(1)), 4).alias("confidence_high_ratio"),
        F.round(F.percentile("confidence", F.lit(0.5)), 4).alias("confidence_median"),
        F.min(F.length("answer")).alias("shortest"),
        F.max(F.length("answer")).alias("longest"),
        F.count_if(F.size(tx.numbers_in(F.col("answer"))) > 0).alias("numeric_facts"),
    )


def confidence_bands(facts: DataFrame) -> DataFrame:
    """Facts by confidence, floored to one decimal."""
    return facts.groupBy(F.round(F.floor(F.col("confidence") * 10 + 1e-9) / 10, 1).alias("band")).agg(F.count("*").alias("n"))


def report_conflicts(facts: DataFrame, title: str = "title", answer: str = "answer", units: str = "点|秒|级|次|天|%|钻") -> DataFrame:
    """Titles whose facts give different values for one unit."""
    found = F.regexp_extract_all(F.col(answer), F.lit(rf"([0-9]+(?:\.[0-9]+)?\s*(?:{units}))"), 1)
    rows = facts.select(F.col(title).alias("title"), "id", F.explode(F.array_distinct(found)).alias("_m"))
    rows = rows.select("title", "id", F.regexp_extract("_m", rf"({units})$", 1).alias("unit"), F.regexp_extract("_m", r"^([0-9.]+)", 1).alias("value"))
    sets = rows.groupBy("title", "unit", "id").agg(F.array_join(F.array_sort(F.collect_set("value")), "/").alias("values"))
    return sets.groupBy("title", "unit").agg(F.count_distinct("values").alias("n_values"), F.array_join(F.array_sort(F.collect_set("values")), "|").alias("values")).filter("n_values > 1")


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's different pairs of characters as numbers, in order, and how often each stands."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique(points[:-1] << np.uint64(21) | points[1:], return_counts=True)


@F.pandas_udf(ty.struct(sums=T.BinaryType(), codes=T.BinaryType(), counts=T.BinaryType()))
def _bag(texts: pd.Series) -> pd.DataFrame:
    """The bigram multiset, and its sizes over ``SUMS`` groups of bigrams."""

    def one(text: str) -> tuple[bytes, bytes, bytes]:
        codes, counts = _codes(text)
        group = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SUMS.bit_length() + 1)
        sums = np.bincount(group.astype(np.int64), counts, SUMS).astype(np.int32)
        return sums.tobytes(), codes.tobytes(), counts.astype(np.int32).tobytes()

    return pd.DataFrame(list(map(one, texts)), columns=["sums", "codes", "counts"])


@F.pandas_udf(ty.LONG)
def _shared(codes_a: pd.Series, counts_a: pd.Series, codes_b: pd.Series, counts_b: pd.Series) -> pd.Series:
    """How many bigrams two multisets share."""

    def one(x: bytes, m: bytes, y: bytes, n: bytes) -> int:
        _, i, j = np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True, return_indices=True)
        return int(np.minimum(np.frombuffer(m, np.int32)[i], np.frombuffer(n, np.int32)[j]).sum())

    return pd.Series([one(*x) for x in zip(codes_a, counts_a, codes_b, counts_b, strict=True)], dtype="int64")


def _close(left: pd.DataFrame, right: pd.DataFrame, apart: float) -> pd.DataFrame:
    """Pairs of two blocks whose multisets' sizes over groups differ by no more than ``apart`` of both sizes, tile by tile."""
    vectors = lambda x: np.frombuffer(b"".join(x["sums"]), np.int32).reshape(len(x), SUMS)
    sign = np.where(np.arange(SUMS) % 2, 1, -1)
    # both are sorted by one signed sum, so that a tile meets just the rows that can come near it
    right = right.assign(_f=vectors(right) @ sign).sort_values("_f")
    left = left.assign(_f=vectors(left) @ sign).sort_values("_f")
    x, y, f, g = vectors(left), vectors(right), left["_f"].to_numpy(), right["_f"].to_numpy()
    n, m, ids, others = left["n"].to_numpy(), right["n"].to_numpy(), left["rep"].to_numpy(), right["rep"].to_numpy()
    most, found = int(apart * (n.max() + m.max())) + 1, []
    for at in range(0, len(x), TILE):
        to = min(at + TILE, len(x))
        start, stop = np.searchsorted(g, f[at] - most, "left"), np.searchsorted(g, f[to - 1] + most, "right")
        for low in range(start, stop, 16 * TILE):
            high = min(low + 16 * TILE, stop)
            gap = np.zeros((to - at, high - low), np.int32)
            for k in range(SUMS):
                gap += np.abs(x[at:to, k, None] - y[None, low:high, k])
            i, j = np.nonzero(gap <= apart * (n[at:to, None] + m[None, low:high]))
            found.append((ids[at + i], others[low + j]))
    pairs = pd.DataFrame({"a": np.concatenate([i for i, _ in found] or [ids[:0]]), "b": np.concatenate([j for _, j in found] or [ids[:0]])})
    return pairs[pairs["a"] != pairs["b"]]


def _body(text: Column) -> Column:
    """What a text says, without a template's head of up to 40 characters that ends in a colon, and without the white space around it."""
    wide, narrow = F.instr(text, "："), F.instr(text, ":")
    tail = F.when(wide.between(1, HEAD + 1), F.substr(text, wide + 1)).when(narrow.between(1, HEAD + 1), F.substr(text, narrow + 1)).otherwise(text)
    return F.btrim(F.coalesce(tail, F.lit("")), F.lit(SPACE))


def _pool(rows: DataFrame, key: str, group: str, text: str, min_chars: int) -> DataFrame:
    """id, g, t, the text's characters but white space, and their hash: the rows whose bodies are long enough."""
    pool = rows.select(F.col(key).alias("id"), F.col(group).alias("g"), _body(F.col(text)).alias("_body")).filter(F.length("_body") >= min_chars)
    pool = pool.select("id", "g", F.translate("_body", SPACE, "").alias("t")).filter(F.length("t") > 1)
    return pool.withColumn("same", F.sha2(F.col("t").cast("binary"), 256))


def copies(rows: DataFrame, key: str, group: str, text: str, least: float = 0.99, min_chars: int = 40) -> DataFrame:
    """Pairs of different groups whose bigram multisets have a Dice of ``least`` or more (A): id_a, id_b and dice.

    A text is its body of ``min_chars`` or more, see ``_body``, and its bigrams are those without white space. Rows without a group are a group.
    Of a group's rows of one text the one with the least key stands in pairs; ``copy_members`` gives the others.

    A Dice of d bounds what two multisets differ in, so it bounds the ratio of their sizes as well as the difference of any
    sums over groups of bigrams. Texts are dealt out by classes of size as wide as that ratio, in blocks of ``BLOCK``; blocks of one class or of neighbours are
    held against each other by their sums, and what these leave is compared in full.
    """
    pool = _pool(rows, key, group, text, min_chars)
    # numbers of their own, as keys may be null or stand for several texts
    bags = pool.groupBy("same").agg(F.first("t").alias("t")).select("same", F.monotonically_increasing_id().alias("rep"), (F.length("t") - 1).alias("n"), F.explode(F.array(_bag(F.col("t")))).alias("bag"))
    bags = settle(bags.select("same", "rep", "n", "bag.*"), "bags")
    apart = 1 - least + 0.0001  # the Dice is rounded
    width = math.log((1 + apart) / (1 - apart))
    sized = bags.select("rep", "n", "sums", F.floor(F.log(F.col("n")) / width).cast("int").alias("c"))
    parts = sized.groupBy("c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))  # some thousand classes at most
    dealt = sized.join(F.broadcast(parts), "c").withColumn("p", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    above = parts.select((F.col("c") - 1).alias("c"), F.col("parts").alias("_above"))
    below = parts.select((F.col("c") + 1).alias("c"), F.col("parts").alias("_below"))
    dealt = dealt.join(F.broadcast(above), "c", "left").join(F.broadcast(below), "c", "left")
    cell = lambda c, step, p, q: F.struct(c.alias("c"), F.lit(step).alias("step"), p.alias("p"), q.alias("q"))
    blocks = lambda n, use: F.transform(F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), use)
    c, p = F.col("c"), F.col("p")
    as_left = F.concat(F.transform(F.sequence(p, F.col("parts") - 1), lambda q: cell(c, 0, p, q)), blocks(F.col("_above"), lambda q: cell(c, 1, p, q)))
    as_right = F.concat(F.transform(F.sequence(F.lit(0), p), lambda q: cell(c, 0, q, p)), blocks(F.col("_below"), lambda q: cell(c - 1, 1, q, p)))
    cells = ["c", "step", "p", "q"]
    left = dealt.select("rep", "n", "sums", F.explode(as_left).alias("_x")).select("rep", "n", "sums", "_x.*")
    right = dealt.select("rep", "n", "sums", F.explode(as_right).alias("_x")).select(*[F.col(x).alias(x) for x in ("rep", "n", "sums")], "_x.*")
    kind = bags.schema["rep"].dataType.simpleString()
    close = left.groupBy(cells).cogroup(right.groupBy(cells)).applyInPandas(lambda x, y: _close(x, y, apart) if len(x) and len(y) else pd.DataFrame({"a": [], "b": []}), f"a {kind}, b {kind}")
    near = settle(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-copies")
    side = lambda x: bags.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("codes").alias(f"x{x}"), F.col("counts").alias(f"k{x}"))
    both = near.join(side("a"), "a").join(side("b"), "b").withColumn("m", _shared("xa", "ka", "xb", "kb"))
    scored = both.withColumn("dice", F.round(2 * F.col("m") / (F.col("na") + F.col("nb")), 4)).filter(F.col("dice") >= least).select("a", "b", "dice")
    classes = scored.unionByName(bags.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("dice")))
    members = pool.groupBy("same", "g").agg(F.min("id").alias("id")).join(bags.select("same", "rep"), "same")
    one, two = members.select(F.col("rep").alias("a"), F.col("g").alias("ga"), F.col("id").alias("id_a")), members.select(F.col("rep").alias("b"), F.col("g").alias("gb"), F.col("id").alias("id_b"))
    turned = F.col("id_a") > F.col("id_b")
    once = (F.col("a") != F.col("b")) | F.coalesce(F.col("ga") < F.col("gb"), F.col("ga").isNull())
    return classes.join(one, "a").join(two, "b").filter(~F.col("ga").eqNullSafe(F.col("gb")) & once).select(F.when(turned, F.col("id_b")).otherwise(F.col("id_a")).alias("id_a"), F.when(turned, F.col("id_a")).otherwise(F.col("id_b")).alias("id_b"), "dice")


def copy_members(rows: DataFrame, pairs: DataFrame, key: str, group: str, text: str, min_chars: int = 40) -> DataFrame:
    """first and id: the other rows of a group's text, each with the one that stands for it in pairs of ``copies``.

    A pair holds for each row of its one side with each of the other, so pairs and members tell all of them without a row for each.
    """
    pool = _pool(rows, key, group, text, min_chars).select("id", "g", "same")
    firsts = pool.groupBy("same", "g").agg(F.min("id").alias("first"))
    shown = pairs.select(F.explode(F.array("id_a", "id_b")).alias("first")).distinct()
    firsts = firsts.join(shown, "first", "left_semi").withColumnRenamed("same", "_s").withColumnRenamed("g", "_g")
    met = (F.col("same") == F.col("_s")) & F.col("g").eqNullSafe(F.col("_g"))
    return pool.join(firsts, met).filter(~F.col("id").eqNullSafe(F.col("first"))).select("first", "id")


def misattributed(rows: DataFrame, entities: DataFrame, key: str, own: str, text: str, least: int = 2) -> DataFrame:
    """Rows that never name their own entity but another one (name), of two characters or more, ``least`` times or more (B)."""
    open_ = rows.filter((F.col(own) != "") & ~F.contains(F.col(text), F.col(own)))
    hits = names.mentions(open_, entities.select("name").filter(F.length("name") >= 2), key, text)
    return hits.filter(F.col("n") >= least).select(key, F.col("name").alias("other"), "n").distinct()


def placeholder(answer: Column) -> Column:
    """Shorter than two characters, punctuation alone, or a bare per cent (C)."""
    body = F.btrim(F.coalesce(answer, F.lit("")))
    return (F.length(body) < 2) | ~body.rlike(r"(?U)\w") | body.rlike(r"^[0-9.]+\s*%$")


def duplicate_bodies(rows: DataFrame, title: str, text: str, min_chars: int = 8) -> DataFrame:
    """Texts that stand under several titles (D)."""
    body = tx.comparable(F.col(text))
    return rows.select(body.alias("body"), F.col(title).alias("_t")).filter(F.length("body") >= min_chars).groupBy("body").agg(F.count_distinct("_t").alias("titles"), F.count("*").alias("n")).filter("titles > 1")


def collisions(rows: DataFrame, entity: str, field: str, value: str) -> DataFrame:
    """Values of a field that should be one entity's but are several's (F)."""
    return rows.groupBy(F.col(field).alias("field"), F.col(value).alias("value")).agg(F.count_distinct(entity).alias("entities")).filter("entities > 1")


def gap_judge(points: DataFrame, corpus: DataFrame, key: str, text: str, corpus_text: str, least: float = 0.6) -> DataFrame:
    """Points by the share of their bigrams that the corpus has, and the numbers that it lacks; supported if neither falls short."""
    norm = lambda c: tx.comparable(F.col(c))
    have = corpus.select(F.explode(F.array_distinct(tx.pairs_of(norm(corpus_text)))).alias("x")).distinct().withColumn("_hit", F.lit(1))
    asked = points.select(key, F.explode(tx.bigrams(norm(text))).alias("x"))
    share = asked.join(have, "x", "left").groupBy(key).agg(F.round(F.avg(F.coalesce("_hit", F.lit(0))), 4).alias("share"))
    known = corpus.select(F.explode(tx.gap_numbers(F.col(corpus_text))).alias("n")).distinct().withColumn("_hit", F.lit(1))
    wanted = points.select(key, F.explode(tx.gap_numbers(F.col(text))).alias("n"))
    lacking = wanted.join(known, "n", "left").groupBy(key).agg(F.count_if(F.col("_hit").isNull()).alias("missing_numbers"))
    out = points.select(key).join(share, key, "left").join(lacking, key, "left").select(key, F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("missing_numbers", F.lit(0)).alias("missing_numbers"))
    return out.withColumn("supported", (F.col("share") >= least) & (F.col("missing_numbers") == 0))


def field_profile(pairs: DataFrame, page: str = "page", key: str = "key", value: str = "value") -> DataFrame:
    """Per field: pages, different values, the most common one (of equal ones the least) and its share."""
    counts = pairs.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(key, value).agg(F.count("*").alias("n"))
    out = counts.groupBy(key).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_values"), F.max(F.struct("n", F.col(value).alias("v"))).alias("_top"))
    return out.select(key, "n_rows", "n_values", F.col("_top.v").alias("top_value"), F.round(F.col("_top.n") / F.col("n_rows"), 4).alias("top_share"))


def constant_fields(pairs: DataFrame, min_pages: int = 4, share: float = 0.8, **columns) -> DataFrame:
    """Fields that nearly all pages fill alike: a template's default."""
    return field_profile(pairs, **columns).filter((F.col("n_rows") >= min_pages) & (F.col("top_share") >= share))


def compare_sources(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 0.01) -> DataFrame:
    """Two sources' numbers side by side: key, both values, ratio and verdict."""
    both = a.select(key, F.col(value).alias("left_value")).join(b.select(key, F.col(value).alias("right_value")), key, "full")
    ratio = F.round(F.col("left_value") / F.nullif("right_value", F.lit(0)), 4)
    verdict = F.when(F.col("left_value").isNull(), "right_only").when(F.col("right_value").isNull(), "left_only").when(F.abs(ratio - 1) <= tolerance, "same").otherwise("different")
    return both.select(key, "left_value", "right_value", ratio.alias("ratio"), verdict.alias("verdict"))


def source_hit(expected: Column, actual: Column) -> Column:
    return F.arrays_overlap(expected, actual)


def missing_sources(required: Column, actual: Column) -> Column:
    return F.array_except(required, actual)


def eval_metrics(cases: DataFrame) -> DataFrame:
    """One row: cases by kind, and means over those that have a value. cases: answerable, kb_gap, hit, missing, coverage, latency."""
    scored = F.col("answerable") & ~F.col("kb_gap")
    mean = lambda c: F.round(F.avg(F.when(scored, F.col(c).cast("double"))), 4)
    return cases.agg(
        F.count("*").alias("cases"),
        F.count_if(scored).alias("scored"),
        F.count_if(F.col("kb_gap")).alias("gaps"),
        F.count_if(~F.col("answerable")).alias("refusals"),
        mean("hit").alias("hit_rate"),
        mean("coverage").alias("coverage"),
        F.round(F.avg("latency"), 4).alias("latency"),
        F.count_if(scored & F.col("hit") & (F.col("missing") == 0)).alias("passed"),
    )
