"""What needs a network or a model, as interfaces with offline defaults, and the rules around it as columns."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.urls import SEARCH_ORDER, baseline_block

# Seconds that a robots answer holds, and statuses.
ROBOTS_TTL = {"ok": 1800, "missing": 21600, "error": 300}
RETRY_STATUS = (408, 425, 429, 500, 502, 503, 504, 567)


class Fetcher(Protocol):
    def fetch(self, url: str) -> tuple[int, bytes]: ...


class Searcher(Protocol):
    def search(self, query: str) -> Sequence[dict]: ...


class Model(Protocol):
    def complete(self, prompt: str) -> str: ...


class Offline:
    """Answers nothing: no page, no result, no text."""

    def fetch(self, url: str) -> tuple[int, bytes]:
        return 0, b""

    def search(self, query: str) -> Sequence[dict]:
        return ()

    def complete(self, prompt: str) -> str:
        return ""


def provider_order(primary: Column, fallbacks: Sequence[str]) -> Column:
    """The chosen provider, then the free ones, each once."""
    return F.array_distinct(F.filter(F.concat(F.array(primary), F.array(*[F.lit(f) for f in fallbacks])), lambda p: F.coalesce(p, F.lit("")) != ""))


def search_dedupe(results: DataFrame, query: str = "query", url: str = "url", sequence: str = "seq") -> DataFrame:
    """Results without repeats of a URL (fragment and last slash apart), by source and place."""
    key = F.regexp_replace(F.split(F.col(url), "#")[0], "/+$", "")
    order = F.coalesce(*[F.when(F.col("source_type") == k, v) for k, v in SEARCH_ORDER.items()], F.lit(3))
    first = results.withColumn("_key", key).withColumn("_r", F.row_number().over(Window.partitionBy(query, "_key").orderBy(sequence))).filter("_r = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(order, sequence))).drop("_key", "_r")


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number or an HTTP date."""
    text = F.btrim(F.coalesce(value, F.lit("")))
    number = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.cast("double"))
    date = F.try_to_timestamp(F.regexp_extract(text, r"^\w{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.coalesce(number, (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"), F.lit(0.0)), F.lit(0.0))


def cooldown_until(status: Column, retry: Column, now: Column, until: Column, least: float = 60.0, statuses: Sequence[int] = (429, 503, 567)) -> Column:
    """A host's pause after a refusal; a pause never gets shorter."""
    return F.when(status.isin(*statuses), F.greatest(until, now + F.greatest(F.lit(least), retry))).otherwise(until)


def cooldown_left(until: Column, now: Column) -> Column:
    return F.greatest(until - now, F.lit(0.0))


def robots_stale(state: Column, age: Column) -> Column:
    """A robots answer of this state and age is to be asked for again."""
    return age >= F.coalesce(*[F.when(state == k, v) for k, v in ROBOTS_TTL.items()], F.lit(0))


def robots_allows(state: Column, allowed: Column) -> Column:
    """An error refuses, no file allows."""
    return F.when(state == "ok", allowed).otherwise(state == "missing")


def fetch_gate(url: Column, blocked: Column, until: Column, now: Column, state: Column, allowed: Column) -> Column:
    """struct(reason, again, wait): why a page isn't asked for, whether it may be later, and in how many seconds.

    A request is saved wherever one can be: the block list first, then sites that are never read, a pause, and last the robots answer.
    """
    left = cooldown_left(until, now)
    reason = F.when(blocked, "blocked").when(baseline_block(url) != "", "baseline").when(left > 0, "cooling").when(~robots_allows(state, allowed), "robots").otherwise("")
    again = (reason == "cooling") | ((reason == "robots") & (state == "error"))
    return F.struct(reason.alias("reason"), again.alias("again"), F.when(reason == "cooling", left).otherwise(0.0).alias("wait"))


def host_interval(host: Column, slow: Sequence[str], usual: float, slow_interval: float) -> Column:
    return F.when(F.exists(F.array(*[F.lit(s) for s in slow]), lambda s: F.contains(host, s)), slow_interval).otherwise(usual)


def retryable(status: Column) -> Column:
    return F.coalesce(status, F.lit(0)).isin(0, *RETRY_STATUS)


def batches(rows: DataFrame, by: str, order: str, size: str, max_rows: int = 4, max_chars: int = 6000) -> DataFrame:
    """batch of each row by greedy filling: a new one after max_rows rows; a row over the characters that are left is left out."""
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, size))).alias("_x"))
    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = s["n"] >= max_rows
        n, chars, batch = F.when(new, 0).otherwise(s["n"]), F.when(new, F.lit(0).cast("long")).otherwise(s["chars"]), F.when(new, s["batch"] + 1).otherwise(s["batch"])
        fits = chars + x[size] <= max_chars
        return F.struct(batch.alias("batch"), (n + 1).alias("n"), F.when(fits, chars + x[size]).otherwise(chars).alias("chars"), F.concat(s["out"], F.array(F.when(fits, batch))).alias("out"))

    done = listed.withColumn("_b", F.aggregate("_x", zero, step)["out"])
    return done.select(by, F.explode(F.arrays_zip("_x", "_b")).alias("z")).select(by, F.col(f"z._x.{order}").alias(order), F.col("z._b").alias("batch"))
