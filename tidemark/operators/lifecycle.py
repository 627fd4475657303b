"""Documents and facts over time: upsert, replacement, revocation. Tables are immutable; each operator gives the new state.

Keyed merges are full outer joins on the key, with the newest row of each key taken before by an aggregate, so a key with
many versions in a batch is one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is greatest by order and then by its values."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in rest])).alias("_x")).select(key, *[F.col(f"_x._{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: str = "url", content: str = "content_hash") -> DataFrame:
    """All rows of both, new values first, and change: insert, update (other content), touch or keep."""
    columns = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*columns).alias("_a"))
    b = new.select(key, F.struct(*columns).alias("_b"))
    both = a.join(b, key, "full")
    change = F.when(F.col("_b").isNull(), "keep").when(F.col("_a").isNull(), "insert").when(F.col(f"_a.{content}").eqNullSafe(F.col(f"_b.{content}")), "touch").otherwise("update")
    value = F.coalesce("_b", "_a")
    return both.select(key, *[value[c].alias(c) for c in columns], change.alias("change"))


def supersede_changed(facts: DataFrame, changed: DataFrame, url: str = "source_url") -> DataFrame:
    """Facts of changed pages are superseded, but those entered by hand or from an interface."""
    hit = changed.select(F.col("url").alias(url)).distinct().withColumn("_hit", F.lit(True))
    gone = F.col("_hit").isNotNull() & ~F.coalesce("extraction", F.lit("")).isin("manual", "api") & F.col("status").isin("active", "conflict")
    return facts.join(hit, url, "left").withColumn("status", F.when(gone, "superseded").otherwise(F.col("status"))).drop("_hit")


def replace_chunks(chunks: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """The chunks of all other documents, and the fresh ones."""
    return chunks.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def revoke_source(rows: DataFrame, source: Column) -> DataFrame:
    """Rows of the source are revoked; the rest stay."""
    return rows.withColumn("status", F.when(source, "revoked").otherwise(F.col("status")))


def apply_revocations(rows: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the registry names are revoked."""
    named = registry.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return rows.join(named, keys, "left").withColumn("status", F.when(F.col("_hit").isNotNull(), "revoked").otherwise(F.col("status"))).drop("_hit")


def without_revoked(rows: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(registry.select(*keys).distinct(), keys, "left_anti")


def supersede(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: id of the old fact and the id that takes its place."""
    out = facts.join(pairs.select(F.col("old").alias("id"), F.col("new").alias("_new")), "id", "left")
    return out.withColumn("status", F.when(F.col("_new").isNotNull(), "superseded").otherwise(F.col("status"))).withColumn("superseded_by", F.col("_new")).drop("_new")


def merge_state(state: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, the steps' done versions; of two the higher."""
    every = state.select(key, "step", "version").unionByName(done.select(key, "step", "version"))
    return every.groupBy(key, "step").agg(F.max("version").alias("version"))


def pending(docs: DataFrame, state: DataFrame, step: str, version: int, key: str = "doc_id") -> DataFrame:
    """Documents whose step isn't done in this version."""
    return docs.join(state.filter((F.col("step") == step) & (F.col("version") >= version)).select(key), key, "left_anti")


def overlay(rows: DataFrame, manual: DataFrame, key: str) -> DataFrame:
    """Entered values go over stored ones, key by key; applying it twice is applying it once."""
    columns = [c for c in rows.columns if c != key]
    return rows.join(manual.select(key, *[F.col(c).alias(f"_{c}") for c in columns if c in manual.columns]), key, "full").select(key, *[(F.coalesce(f"_{c}", c) if c in manual.columns else F.col(c)).alias(c) for c in columns])
