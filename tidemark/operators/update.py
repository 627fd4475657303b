"""A topic's pages to documents, chunks, facts and a run's figures, as one change of all tables.

A page is fetched (it has a text of ``MIN_TEXT`` characters), refused by the gates or stored; one whose content is stored already changes nothing. A changed
page replaces its document and chunks, and its earlier facts are superseded, but those that its tables still give and those entered by hand.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import chunking, tables, trust, urls
from tidemark.operators import lifecycle, quality_gate
from tidemark.operators.steps import settle
from tidemark.sources import snapshot

# A fixed value: characters of a page below which a fetch counts as failed.
MIN_TEXT = 200

SCHEMAS = {
    "documents": "url string, title string, topic string, source_type string, published string, content_hash string, text string",
    "chunks": "url string, ord int, text string",
    "facts": "id string, url string, topic string, title string, answer string, tags string, extraction string, confidence double, status string",
    "runs": "topic string, run long, fetched long, failed long, skipped_by_policy long, filtered long, pages long, skipped long, chunks long, facts_added long",
}
KEYS = {"documents": ["url"], "chunks": ["url"], "facts": ["id"], "runs": ["topic", "run"]}


def judged(pages: DataFrame, documents: DataFrame, refused: Column | None = None, official: Sequence[str] = (), wiki: Sequence[str] = ()) -> DataFrame:
    """Each URL's last page (by seq) with what becomes of it: failed, policy, filtered, touch, insert or update.

    pages: topic, url, title, text, published, seq; nulls count as empty, and a page without URL as failed. refused: URLs that aren't to be read;
    official, wiki: hosts by which a page's source is classed.
    """
    full = pages.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("topic", "url", "title", "text", "published")], "seq")
    full = lifecycle.latest(full, "url", "seq")
    short = (F.col("url") == "") | (F.length("text") < MIN_TEXT)
    page = quality_gate.validate_page(full, "title", "text").withColumn("content_hash", F.md5(F.col("cleaned_text").cast("binary")))
    known = documents.select("url", F.col("content_hash").alias("_stored"))
    both = page.join(known, "url", "left")
    policy = F.coalesce(refused, F.lit(False)) if refused is not None else F.lit(False)
    what = F.when(policy, "policy").when(short, "failed").when(~F.col("ok"), "filtered").when(F.col("_stored").isNull(), "insert")
    what = what.when(F.col("_stored") == F.col("content_hash"), "touch").otherwise("update")
    return both.select("topic", "url", "title", "published", F.col("cleaned_text").alias("text"), "content_hash", urls.classify_source(F.col("url"), official, wiki).alias("source_type"), what.alias("what"))


def page_facts(pages: DataFrame) -> DataFrame:
    """The facts of pages' tables in the shape of the table of facts; a fact that a page gives twice is one."""
    score = trust.trust(F.col("source_type"), F.lit("table"), trust.consistency(F.lit(1), F.lit(False)), F.lit(0.6))
    found = tables.table_facts(pages.withColumnRenamed("title", "page_title"), "text", "page_title")
    key = snapshot.fingerprint(F.concat_ws("\x1f", "url", "fact_title", "fact_answer"))
    rows = found.select(key.alias("id"), "url", "topic", F.col("fact_title").alias("title"), F.col("fact_answer").alias("answer"), F.col("fact_tags").alias("tags"), F.lit("table").alias("extraction"), score.alias("confidence"), F.lit("active").alias("status"))
    return rows.dropDuplicates(["id"])


def changes(stored: Mapping[str, DataFrame], pages: DataFrame, run: int, refused: Column | None = None, official: Sequence[str] = (), wiki: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The rows that a run over pages puts into each table; see the module. stored: documents and facts as they are."""
    page = settle(judged(pages, stored["documents"], refused, official, wiki), "pages")
    new = page.filter(F.col("what").isin("insert", "update"))
    chunks = settle(new.select("topic", "url", F.posexplode(chunking.chunk_text(F.col("text"))).alias("ord", "_c")), "chunks")
    given = settle(page_facts(new), "facts")
    old = stored["facts"].join(page.filter("what = 'update'").select("url"), "url", "left_semi")
    old = old.filter(~F.coalesce("extraction", F.lit("")).isin("manual", "api") & F.col("status").isin("active", "conflict"))
    old = old.join(given.select("id"), "id", "left_anti").withColumn("status", F.lit("superseded"))
    known = stored["facts"].filter("status = 'active'").select("id")
    added = given.join(known, "id", "left_anti").groupBy("topic").agg(F.count("*").alias("facts_added"))
    n = lambda *kinds: F.count_if(F.col("what").isin(*kinds))
    runs = page.groupBy("topic").agg(
        n("filtered", "touch", "insert", "update").alias("fetched"), n("failed").alias("failed"), n("policy").alias("skipped_by_policy"),
        n("filtered").alias("filtered"), n("insert", "update").alias("pages"), n("touch").alias("skipped"),
    )
    runs = runs.join(chunks.groupBy("topic").agg(F.count("*").alias("chunks")), "topic", "left").join(added, "topic", "left")
    runs = runs.na.fill(0, ["chunks", "facts_added"]).withColumn("run", F.lit(run).cast("long"))
    return {
        "documents": new.select("url", "title", "topic", "source_type", "published", "content_hash", "text"),
        "chunks": chunks.select("url", "ord", F.col("_c").alias("text")),
        "facts": given.unionByName(old),
        "runs": runs,
    }
