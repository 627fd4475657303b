"""Line dedup (op 3): lines that stand on too large a share of their host's pages are dropped.

A line is a \\n-split part of a text, compared without the white space around it. For each host: the pages that contain
the line, each page once, divided by the host's pages. Above ``RATIO``, and on ``MIN_PAGES`` pages or more of a host with
``MIN_HOST_PAGES`` or more, it is boilerplate, and all its places on that host go. Only built-in functions are used.

Shuffles carry a 16-byte hash of the line (MD5), the host and a 16-byte key of the row, never texts: counts are summed
before they are dealt out, so that a host or a line with a third of all rows is a few rows per task. The join of places
with boilerplate lines is a plain equi-join whose hot keys Spark can split. Texts move once, where they are joined
with their own places to drop.

Edge cases: a null host is no site, so its rows stay as they are; null and empty texts stay too. Blank lines never count
and are never dropped. A row's key is made of its id, host and text: equal rows count as a page each and lose the same
lines. Input columns, of any names, keep their names and values; only the text changes, and the two counts replace input columns of their
names (``counts=None`` adds none). An empty table gives an empty one. A text of very many lines is one row's arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO, MIN_PAGES, MIN_HOST_PAGES = 0.02, 5, 20
SPACE = " \t\n\x0b\x0c\r"


def _split(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _digest(x: Column) -> Column:
    return F.unhex(F.md5(x.cast("binary")))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int, min_host_pages: int) -> DataFrame:
    """_host and _hash of the boilerplate lines of pages, which has the columns _host and _text."""
    sited = pages.filter(F.col("_host").isNotNull())
    once = F.array_distinct(F.transform(_split("_text"), lambda x: F.btrim(x, F.lit(SPACE))))
    lines = sited.select("_host", F.explode(once).alias("_line")).filter("_line <> ''")
    seen = lines.groupBy("_host", _digest(F.col("_line")).alias("_hash")).agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    hosts = sited.groupBy("_host").agg(F.count("*").alias("total")).filter(F.col("total") >= min_host_pages)
    return seen.join(hosts, "_host").filter(F.col("n") > ratio * F.col("total")).select("_host", "_hash")


def drop_lines(docs: DataFrame, host: Column, key: str = "doc_id", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, min_host_pages: int = MIN_HOST_PAGES, counts: tuple[str, str] | None = ("_n_lines", "_n_dropped")) -> DataFrame:
    """docs with the remaining lines as text, and two columns of counts, lines and dropped lines, of the given names.

    The columns of docs may have any names; they are one struct beside the columns of the steps.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    pages = docs.select(row, host.cast("string").alias("_host"), F.col(f"`{key}`").cast("string").alias("_key"), F.col(f"`{text}`").alias("_text"))
    known = boilerplate(pages, ratio, min_pages, min_host_pages)
    named = F.concat_ws("\x00", F.coalesce("_key", F.lit("")), F.coalesce("_host", F.lit("")), F.coalesce("_text", F.lit("")))
    pages = pages.withColumn("_page", _digest(named))
    places = pages.filter(F.col("_host").isNotNull()).select("_page", "_host", F.posexplode(_split("_text")).alias("_at", "_line"))
    places = places.withColumn("_line", F.btrim("_line", F.lit(SPACE))).filter("_line <> ''").select("_page", "_host", "_at", _digest(F.col("_line")).alias("_hash"))
    gone = places.join(known, ["_host", "_hash"], "left_semi").groupBy("_page").agg(F.collect_set("_at").alias("_gone"))
    joined = pages.select("_page", "_row").join(gone, "_page", "left").withColumn("_lines", _split(f"_row.`{text}`"))
    n = F.size("_lines")
    left = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone")), lambda i: F.get("_lines", i))
    own = F.col(f"_row.`{text}`")
    changed = F.when(F.col("_gone").isNull(), own).otherwise(F.array_join(left, "\n"))
    joined = joined.withColumn("_new", F.struct(changed.alias("text"), n.cast("long").alias("lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("dropped")))
    numbers = () if counts is None else (F.col("_new.lines").alias(counts[0]), F.col("_new.dropped").alias(counts[1]))
    kept = [F.col("_new.text").alias(c) if c.lower() == text.lower() else F.col(f"_row.`{c}`") for c in docs.columns if counts is None or c not in counts]
    return joined.select(*kept, *numbers)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = drop_lines(docs, F.col("source"))
    return out.select("doc_id", F.col("source").alias("host"), F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
p AS (SELECT rid, host, unnest(range(len(lines))) AS place, unnest(lines) AS raw FROM d),
t AS (SELECT rid, host, place, raw, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM p),
n AS (SELECT host, line, count(DISTINCT rid) AS n FROM t WHERE line <> '' AND host IS NOT NULL GROUP BY host, line),
h AS (SELECT host, count(*) AS total FROM d GROUP BY host),
b AS (SELECT host, line FROM n JOIN h USING (host) WHERE n >= {MIN_PAGES} AND total >= {MIN_HOST_PAGES} AND n > {RATIO} * total),
k AS (SELECT t.*, b.line IS NOT NULL AS gone FROM t LEFT JOIN b USING (host, line)),
s AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (NOT gone), '') AS text FROM k GROUP BY rid)
SELECT d.doc_id, d.host, s.n_lines, s.n_dropped, CASE WHEN s.n_dropped = 0 THEN d.text ELSE s.text END AS text FROM d JOIN s USING (rid)
"""
