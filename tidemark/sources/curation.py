"""Source rules that are data: a catalogue, paused sources, retired texts, revocation registries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import urls

CATALOG = T.StructType([T.StructField(n, T.StringType()) for n in ("source_id", "kind", "url", "source_type", "source_class")] + [T.StructField("enabled", T.BooleanType())])
KINDS = ("page", "list", "mw_allpages", "mw_api", "characters")


def catalog(spark: SparkSession, rows: Sequence[tuple], include_disabled: bool = False) -> DataFrame:
    """Declared sources; a row without class is data."""
    df = spark.createDataFrame(list(rows), CATALOG).withColumn("source_class", F.coalesce("source_class", F.lit("data")))
    return df if include_disabled else df.filter("enabled")


def dispatch(sources: DataFrame, readers: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame | None:
    """The pages of all sources, each kind by its reader; the readers' kinds are few and fixed."""
    out = None
    for kind, read in readers.items():
        if kind not in KINDS:
            raise ValueError(f"no source kind {kind}")
        pages = read(sources.filter(F.col("kind") == kind))
        out = pages if out is None else out.unionByName(pages, allowMissingColumns=True)
    return out


def paused(url: Column, tags: Column, host: str, prefix: str) -> Column:
    """The host's pages below the prefix, and facts that were merged from it."""
    path = F.regexp_replace(urls.path_of(url), "/+$", "")
    here = (F.regexp_replace(urls.host_of(url), r"\.$", "") == host) & ((path == prefix) | path.startswith(prefix + "/"))
    mark = F.coalesce(tags, F.lit("")).rlike(r"(?i)并入:\s*" + host.replace(".", r"\.") + r"(?=[\s|,，;；]|$)")
    return here | mark


def strip_footer(url: Column, text: Column, host: str, footer: str) -> Column:
    """A known footer and what follows it, on one host."""
    at = F.regexp_instr(text, F.lit(footer))
    return F.when((urls.host_of(url) == host) & (at > 0), F.rtrim(F.substr(text, F.lit(1), at - 1))).otherwise(text)


def strip_banner(url: Column, text: Column, pages: Sequence[str], banner: str) -> Column:
    """The first place of a retired banner, on some pages."""
    at = F.instr(text, banner)
    rest = F.substr(text, at + len(banner))
    return F.when(urls.canonical_url(url).isin(*pages) & (at > 0), F.concat(F.substr(text, F.lit(1), at - 1), F.lit("\n"), rest)).otherwise(text)


def revoked_reason(rows: DataFrame, registry: DataFrame, url: str = "url") -> DataFrame:
    """rows with the registry's reason for their canonical URL, or nothing."""
    named = registry.groupBy(F.col("url").alias("_u")).agg(F.min("reason").alias("revoked_reason"))
    return rows.withColumn("_u", urls.canonical_url(F.col(url))).join(named, "_u", "left").withColumn("revoked_reason", F.coalesce("revoked_reason", F.lit(""))).drop("_u")


def redirect_gate(start: Column, end: Column, blocked: Column) -> Column:
    """Why a redirect isn't followed: another host that is private or blocked."""
    moved = urls.host_of(start) != urls.host_of(end)
    return F.when(moved & urls.is_private(urls.host_of(end)), "private").when(moved & blocked, "blocked").otherwise("")
