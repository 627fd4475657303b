"""Voting across sources: per slot, one candidate of each domain, and a verdict.

Counts per (slot, domain) are taken with max_by before anything is dealt out by slot, so a slot or a domain with a large share
of the facts costs a row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import urls
from tidemark.functions import versions as vs

# Tags and patterns of the vote.
NARRATIVE_TAG, MULTI_TAG, CONFLICT_TAG, FIELD_TAG = "叙事来源", "多源确认", "多源冲突", "数值字段存疑（施工期，未跨源比对）"
NUMERIC_FIELD = "生命|生命值|攻击|攻击力|防御|防御力|暴击|爆伤|伤害|抗性|速度|数值|加成|上限|初始"
BONUS, MIN_DOMAINS = 0.08, 2


def merged_domains(tags: Column) -> Column:
    """Domains that a merge has left in the tags."""
    found = F.regexp_extract_all(F.coalesce(tags, F.lit("")), F.lit(r"并入[:：]\s*([A-Za-z0-9._\-]+)"), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda h: F.coalesce(F.nullif(urls.domain_of(h), F.lit("")), F.lower(h))), lambda h: h != ""))


def narrative_fact(tags: Column) -> Column:
    return F.contains(F.coalesce(tags, F.lit("")), F.lit(NARRATIVE_TAG))


def numeric_field(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(NUMERIC_FIELD)


def under_construction(domain: Column, domains: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | F.contains(domain, F.lit(d))
    return out


def no_vote(tags: Column, title: Column, domain: Column, construction: tuple[str, ...] = ()) -> Column:
    """Why a fact doesn't vote; empty if it does."""
    return F.when(narrative_fact(tags), "narrative").when(numeric_field(title) & under_construction(domain, construction), "construction").otherwise("")


def candidates(facts: DataFrame, include_revoked: bool = False, construction: tuple[str, ...] = ()) -> DataFrame:
    """A ballot for each fact and domain. facts: id, slot, title, answer, source_url, confidence, version, effective_from, tags, status, seq (order)."""
    status = F.coalesce("status", F.lit(""))
    on = facts.filter((F.coalesce("slot", F.lit("")) != "") & (status != "superseded") & tx.value_like(F.col("answer")))
    on = on if include_revoked else on.filter(status != "revoked")
    domain = urls.domain_of(F.col("source_url"))
    on = on.withColumn("_own", domain).filter(no_vote(F.col("tags"), F.col("title"), F.col("_own"), construction) == "")
    own = F.when(F.col("_own") != "", F.array("_own")).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(own, merged_domains(F.col("tags"))))
    return on.select(
        "slot",
        "id",
        "title",
        "answer",
        "seq",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("version", F.lit("")).alias("version"),
        F.substring(F.coalesce("effective_from", F.lit("")), 1, 10).alias("effective"),
        tx.signature(tx.numbers_signed(F.col("answer"))).alias("signature"),
        F.explode(every).alias("domain"),
    )


def vote(ballots: DataFrame, min_domains: int = MIN_DOMAINS) -> DataFrame:
    """slot, verdict, n_domains, domains, n_facts, fact_ids, n_values and n_versions."""
    ballots = ballots.withColumn("_key", vs.version_key(F.col("version")))
    order = F.struct("confidence", F.col("_key").alias("v"), "effective", (-F.col("seq")).alias("s"))
    row = F.struct("id", "signature", "version", "effective")
    picked = ballots.groupBy("slot", "domain").agg(F.max_by(row, order).alias("x")).select("slot", "domain", "x.*")
    version = F.concat_ws("@", F.coalesce(F.nullif("effective", F.lit("")), F.lit("-")), F.coalesce(F.nullif("version", F.lit("")), F.lit("-")))
    out = picked.withColumn("_v", version).groupBy("slot").agg(
        F.count("*").alias("n_domains"),
        F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"),
        F.array_sort(F.collect_set("id")).alias("_ids"),
        F.count_distinct("signature").alias("n_values"),
        F.count_distinct("_v").alias("n_versions"),
    )
    verdict = F.when(F.col("n_domains") < min_domains, "single").when(F.col("n_versions") > 1, "versioned").when(F.col("n_values") == 1, "multi").otherwise("conflict")
    return out.select("slot", verdict.alias("verdict"), "n_domains", "domains", F.size("_ids").cast("long").alias("n_facts"), F.array_join(F.transform("_ids", lambda i: i.cast("string")), ",").alias("fact_ids"), "n_values", "n_versions")


def summary(verdicts: DataFrame) -> DataFrame:
    """One row: slots and how many have each verdict."""
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return verdicts.agg(F.count("*").alias("slots"), *[count(v) for v in ("multi", "conflict", "versioned", "single")])


def apply_votes(facts: DataFrame, verdicts: DataFrame, ballots: DataFrame) -> DataFrame:
    """Facts of agreeing slots get the bonus and tag once; those of conflicting ones the status and tag. Nothing is overwritten."""
    voted = ballots.select("slot", "id").distinct().join(verdicts.select("slot", "verdict"), "slot").filter(F.col("verdict").isin("multi", "conflict")).select("id", "verdict")
    out = facts.join(voted, "id", "left")
    multi = (F.col("verdict") == "multi") & ~F.contains(F.coalesce("tags", F.lit("")), F.lit(MULTI_TAG))
    conflict = F.col("verdict") == "conflict"
    tags = F.when(multi, tx.ensure_tag(F.col("tags"), F.lit(MULTI_TAG))).when(conflict, tx.ensure_tag(F.col("tags"), F.lit(CONFLICT_TAG))).otherwise(F.col("tags"))
    confidence = F.when(multi, F.round(F.least(F.lit(1.0), F.col("confidence") + BONUS), 4)).otherwise(F.col("confidence"))
    status = F.when(conflict & (F.col("status") == "active"), "conflict").otherwise(F.col("status"))
    return out.withColumns({"tags": tags, "confidence": confidence, "status": status}).drop("verdict")


def reconcile(facts: DataFrame, **options) -> DataFrame:
    """The whole base after a vote."""
    ballots = candidates(facts, **options)
    return apply_votes(facts, vote(ballots), ballots)
