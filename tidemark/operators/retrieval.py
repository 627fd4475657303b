"""Retrieval end to end: facts and chunks of a question, phrases, evidence, and the regression run over cases."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import audit, search
from tidemark.operators.text_index import TextIndex

# Least numbers of facts and chunks, and how a request to a model is asked again.
FACTS, CHUNKS, LEAST_FACTS, LEAST_CHUNKS = 2, 1, 4, 6
WAIT, LONGEST_WAIT, JITTER = 1.5, 60.0, 0.5


def retrieve(facts: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = 8, floor: float = 0.0, qkey: str = "question_id", fact_index: TextIndex | None = None, chunk_index: TextIndex | None = None) -> DataFrame:
    """qkey, kind, key, relevance and pos of the best facts and chunks of each question at the floor or above.

    facts and chunks as ``search`` takes them, with keys of one type; half as many facts as asked for, four at least, and six chunks at least.
    """
    found = found_facts(facts, questions, k, qkey, fact_index).unionByName(found_chunks(chunks, questions, k, qkey, chunk_index))
    return search.relevance_floor(found, floor)


def found_facts(facts: DataFrame, questions: DataFrame, k: int = 8, qkey: str = "question_id", index: TextIndex | None = None) -> DataFrame:
    """The facts' part of ``retrieve``, without the floor."""
    found = search.search_facts(facts, questions, max(LEAST_FACTS, k // FACTS), qkey=qkey, index=index)
    return found.select(qkey, F.lit("fact").alias("kind"), F.col("id").alias("key"), "relevance", "pos")


def found_chunks(chunks: DataFrame, questions: DataFrame, k: int = 8, qkey: str = "question_id", index: TextIndex | None = None) -> DataFrame:
    """The chunks' part of ``retrieve``, without the floor."""
    found = search.search_chunks(chunks, questions, max(LEAST_CHUNKS, k // CHUNKS), qkey=qkey, index=index)
    return found.select(qkey, F.lit("chunk").alias("kind"), F.col("chunk_id").alias("key"), "relevance", F.col("rank").alias("pos"))


def best_score(hits: DataFrame, qkey: str = "question_id") -> DataFrame:
    return hits.groupBy(qkey).agg(F.round(F.max(F.coalesce("relevance", F.lit(0.0))), 4).alias("best_score"), F.count("*").alias("hits"))


def phrase_hits(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text", name: str = "phrase") -> DataFrame:
    """key, phrase and n: how often a phrase's words stand one after the other.

    Words are runs of letters and digits in lower case, so marks part words on both sides. Positions of a word meet positions of the phrase in
    an equi-join on the word; a place counts where all of them have the same start.
    """
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    asked = phrases.select(F.col(name).alias("phrase"), words(F.col(name)).alias("_w")).filter(F.size("_w") > 0).distinct()
    terms = asked.select("phrase", F.size("_w").alias("_n"), F.posexplode("_w").alias("_j", "term"))
    places = docs.select(key, F.posexplode(words(F.col(text))).alias("_i", "term"))
    met = places.join(terms, "term").groupBy(key, "phrase", "_n", (F.col("_i") - F.col("_j")).alias("_start")).agg(F.count("*").alias("_m"))
    return met.filter("_m = _n").groupBy(key, "phrase").agg(F.count("*").alias("n"))


def paused_expectations(cases: DataFrame, paused: DataFrame, key: str = "case_id") -> DataFrame:
    """key and the paused sources that a case depends on: any required one, or else all expected ones.

    cases: key, expected and required (arrays of URLs); paused: url.
    """
    urls = lambda c: cases.select(key, F.explode(c).alias("url"))
    off = paused.select("url").distinct().withColumn("_off", F.lit(True))
    required = urls("required").join(off, "url").groupBy(key).agg(F.array_sort(F.collect_set("url")).alias("_r"))
    expected = urls("expected").join(off, "url", "left").groupBy(key).agg(F.bool_and(F.coalesce("_off", F.lit(False))).alias("_all"), F.array_sort(F.collect_set("url")).alias("_e"))
    both = cases.select(key).join(required, key, "left").join(expected, key, "left")
    named = F.when(F.col("_r").isNotNull(), F.col("_r")).when(F.col("_all"), F.col("_e"))
    return both.select(key, named.alias("paused_sources")).filter("paused_sources IS NOT NULL")


def run_retrieval(cases: DataFrame, evidence: DataFrame, paused: DataFrame, key: str = "case_id") -> DataFrame:
    """key, passed, missing and deferred of each case: passed if an expected source is in the evidence and no required one lacks.

    cases: key, expected, required; evidence: key, url. Cases that depend on paused sources are deferred.
    """
    urls = evidence.filter(F.coalesce("url", F.lit("")) != "").groupBy(key).agg(F.collect_set("url").alias("_u"))
    put_off = paused_expectations(cases, paused, key).select(key, F.lit(True).alias("_d"))
    out = cases.join(urls, key, "left").join(put_off, key, "left").withColumn("_u", F.coalesce("_u", F.array().cast("array<string>")))
    missing = audit.missing_sources(F.col("required"), F.col("_u"))
    passed = audit.source_hit(F.col("expected"), F.col("_u")) & (F.size(missing) == 0)
    return out.select(key, F.coalesce("_d", F.lit(False)).alias("deferred"), passed.alias("passed"), F.array_join(F.array_sort(missing), ",").alias("missing"))


def warnings(errors: Column, missing: Column) -> Column:
    """A retrieval's warnings: errors of the web, and compared subjects without evidence."""
    told = F.when(F.size(missing) > 0, F.array(F.concat(F.lit("本次证据未覆盖"), F.array_join(missing, "、"), F.lit("的所问字段。")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.coalesce(errors, F.array().cast("array<string>")), told)


def system_prompt(template: str, rule: str, plain: str, swaps: dict[str, str], cite: bool = True) -> str:
    """The prompt with the rule on citations, or without any mention of them."""
    text = template.replace("{cite_rule}", rule if cite else plain)
    for old, new in ({} if cite else swaps).items():
        text = text.replace(old, new)
    return text


def retry_wait(attempt: Column, retry_after: Column, key: Column) -> Column:
    """Seconds before a model is asked again; the jitter is made of the key, so it's the same on every run."""
    jitter = F.pmod(F.xxhash64(key, attempt), F.lit(1000)) / 1000 * JITTER
    return F.least(F.lit(LONGEST_WAIT), F.greatest(F.lit(WAIT) * F.pow(F.lit(2.0), attempt), F.coalesce(retry_after, F.lit(0.0))) + jitter)


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


def embed(rows: DataFrame, embedder: Embedder, key: str, text: str, size: int = 64) -> DataFrame:
    """key and embedding of each row's text, asked for in batches; an answer of another length than its batch is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size]
                got = embedder.embed([t or "" for t in part[text]])
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                yield pd.DataFrame({key: part[key], "embedding": got})

    return rows.select(key, text).mapInPandas(run, T.StructType([rows.schema[key], T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
