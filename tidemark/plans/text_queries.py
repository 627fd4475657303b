"""Queries on texts: cleaning, gates, tokens, chunks, fingerprints, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import chunking, grounding, tables, urls, wikitext
from tidemark.functions import text as tx
from tidemark.operators import dedupe, quality_gate, search
from tidemark.operators.steps import settle
from tidemark.operators.text_index import TextIndex
from tidemark.plans.catalog import register
from tidemark.plans.relations import documents, facts, spread, table, with_facts
from tidemark.sources import pages as web


def squash_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(translate({c}, chr(160) || '　', '  ')), '[ \t\f\v]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"


TOKENS = rf"regexp_extract_all({{0}}, '[A-Za-z][A-Za-z0-9_+#.\-]*|[0-9]+(?:\.[0-9]+)?%?')"
COMPARE = r"""lower(regexp_replace({0}, '[\s　 ，。、；：！？“”‘’（）【】《》「」『』…—·,.;:!?"''()\[\]<>/\\|~`^&*+=_-]+', '', 'g'))"""


@register("normalize", f"SELECT doc_id, {squash_sql('text')} AS norm FROM documents")
def normalize(spark, d):
    return documents(spark, d).select("doc_id", tx.normalize(F.col("text")).alias("norm"))


@register("tidy", r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents)
SELECT doc_id, trim(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), chr(10)), ' ' || chr(10)) AS tidy FROM a""")
def tidy(spark, d):
    return documents(spark, d).select("doc_id", tx.tidy(F.col("text")).alias("tidy"))


@register("clean_inline", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]{1,200}>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\f\r\v]+', ' ', 'g'), ' ') AS inline FROM pages""")
def clean_inline(spark, d):
    return table(spark, d, "pages").select("page_id", tx.clean_inline(F.col("html")).alias("inline"))


@register("strip_html_snippet", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&quot;', '"'), '[ \t\n\f\r\v]+', ' ', 'g'), ' ') AS snippet FROM pages""")
def snippet(spark, d):
    return table(spark, d, "pages").select("page_id", tx.snippet(F.col("html")).alias("snippet"))


@register("summarize", r"""WITH a AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\f\r\v]+', ' ', 'g'), ' ') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 160 THEN t ELSE substring(t, 1, 159) || '…' END AS summary FROM a""")
def summarize(spark, d):
    return documents(spark, d).select("doc_id", tx.summarize(F.col("text")).alias("summary"))


@register("tokenize", f"""WITH a AS (SELECT doc_id, {TOKENS.format(squash_sql('text'))} AS t FROM documents)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens FROM a""")
def tokenize(spark, d):
    df = documents(spark, d).select("doc_id", F.explode(F.array(tx.normalize(F.col("text")))).alias("n"))  # generators of one row: each step once
    df = df.select("doc_id", F.explode(F.array(tx.tokenize(F.col("n")))).alias("t"))
    return df.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@register("tokenize_query", f"""WITH a AS (SELECT item_id, {TOKENS.format(squash_sql('text'))} AS t FROM benchmark),
b AS (SELECT item_id, w, min(i) AS i FROM (SELECT item_id, unnest(t) AS w, unnest(range(len(t))) AS i FROM a) GROUP BY ALL)
SELECT item_id, string_agg(w, ' ' ORDER BY i) AS tokens, string_agg('"' || w || '"', ' OR ' ORDER BY i) AS fts_expression FROM b GROUP BY item_id""")
def tokenize_query(spark, d):
    df = table(spark, d, "benchmark").withColumn("n", tx.normalize(F.col("text"))).withColumn("t", tx.tokenize_query(F.col("n")))
    return df.select("item_id", F.array_join("t", " ").alias("tokens"), tx.match_expression(F.col("t")).alias("fts_expression"))


@register("hard_split", """WITH a AS (SELECT doc_id, unnest(range(0, CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i, text FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS i, substring(text, CAST(i * 500 + 1 AS BIGINT), 500) AS piece FROM a""")
def hard_split(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(tx.hard_split(F.col("text"), 500)).alias("i", "piece"))


@register("chunk_text")
def chunk_text(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(chunking.chunk_text(F.col("text"))).alias("ord", "text"))


@register("info_density", r"""SELECT doc_id, round(length(regexp_replace(text, '[\s　，。、；：！？…—－·（）()\[\]【】《》<>"''`,.;:!?\-_/\\|~@#$%^&*+=]+', '', 'g')) / greatest(length(text), 1), 6) AS density FROM documents""")
def info_density(spark, d):
    return documents(spark, d).select("doc_id", F.round(tx.info_density(F.col("text")), 6).alias("density"))


@register("validate_page", r"""WITH a AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), '^\s*[\-—=*·.]{3,}\s*$|^\s*[0-9]+\s*/\s*[0-9]+\s*$')) AS kept, string_split(text, chr(10)) AS every FROM documents),
b AS (SELECT doc_id, trim(regexp_replace(array_to_string(kept, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t, len(every) - len(kept) AS removed FROM a),
c AS (SELECT *, length(regexp_replace(t, '[\s　，。、；：！？…—－·（）()\[\]【】《》<>"''`,.;:!?\-_/\\|~@#$%^&*+=]+', '', 'g')) / greatest(length(t), 1) AS dens,
  list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS l FROM b)
SELECT doc_id, CAST(removed AS INTEGER) AS removed_lines, round(dens, 3) AS info_density, length(t) AS n_clean,
  CASE WHEN length(t) < 150 THEN 'short' WHEN coalesce(len(list_filter(l, lambda x: regexp_matches(x, '^\s*\|.*\|\s*$'))) / nullif(len(l), 0), 0) < 0.25 AND dens < 0.35 THEN 'density' ELSE '' END AS reason FROM c""")
def validate_page(spark, d):
    df = quality_gate.validate_page(documents(spark, d).withColumn("title", F.lit("")), "title", "text")
    return df.select("doc_id", "removed_lines", "info_density", F.length("cleaned_text").cast("long").alias("n_clean"), "reason")


@register("theme_mismatch", "SELECT doc_id, NOT (contains(text, 'the') OR contains(text, 'der')) AS mismatch FROM documents")
def theme_mismatch(spark, d):
    return documents(spark, d).select("doc_id", quality_gate.theme_mismatch(F.lit(""), F.col("text"), F.array(F.lit("the"), F.lit("der"))).alias("mismatch"))


@register("table_density", r"""WITH a AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)
SELECT doc_id, round(coalesce(len(list_filter(l, lambda x: regexp_matches(x, '^\s*\|.*\|\s*$'))) / nullif(len(l), 0), 0), 6) AS density FROM a""")
def table_density(spark, d):
    return documents(spark, d).select("doc_id", F.round(tables.density(F.col("text")), 6).alias("density"))


@register("dedupe_normalize", f"SELECT doc_id, {COMPARE.format('text')} AS norm FROM documents")
def dedupe_normalize(spark, d):
    return documents(spark, d).select("doc_id", tx.comparable(F.col("text")).alias("norm"))


@register("numbers_in", r"""WITH a AS (SELECT doc_id, regexp_extract_all(replace(text, ',', ''), '[0-9]+(?:\.[0-9]+)?') AS n FROM documents)
SELECT doc_id, array_to_string(list_transform(n, lambda x: CASE WHEN contains(x, '.') THEN rtrim(rtrim(x, '0'), '.') ELSE x END), ' ') AS numbers FROM a""")
def numbers_in(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(tx.numbers_in(F.col("text")), " ").alias("numbers"))


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}), 2)), lambda i: substring({0}, CAST(i AS BIGINT), 2)))"


@register("bigram_dice", f"""WITH a AS (SELECT b.item_id, d.doc_id, {COMPARE.format('b.text')} AS x, {COMPARE.format('d.text')} AS y FROM benchmark b JOIN documents d ON b.item_id = d.doc_id),
g AS (SELECT *, {_GRAMS.format('x')} AS gx, {_GRAMS.format('y')} AS gy FROM a)
SELECT item_id, CAST(round(2 * len(list_intersect(gx, gy)) / (len(gx) + len(gy)), 4) AS DOUBLE) AS dice,
  CAST(round(len(list_intersect(gx, gy)) / CASE WHEN length(x) <= length(y) THEN len(gx) ELSE len(gy) END, 4) AS DOUBLE) AS containment FROM g""")
def bigram_dice(spark, d):
    both = table(spark, d, "benchmark").join(documents(spark, d).select("doc_id", F.col("text").alias("other")), F.col("item_id") == F.col("doc_id"))
    return both.select("item_id", tx.dice(F.col("text"), F.col("other")).alias("dice"), tx.containment(F.col("text"), F.col("other")).alias("containment"))


_COMPARED = """p AS (SELECT p_partkey AS k, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS v, p_name AS n, p_type AS t, p_size AS z FROM part),
c AS (SELECT k, v, CASE v WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n || ' 12 units' WHEN 3 THEN n || ' is 1,200' WHEN 4 THEN t || ' ' || n WHEN 5 THEN n || ' ' || t || ' ' || (z + 10) ELSE n END AS x,
  CASE v WHEN 0 THEN upper(n) || '!' WHEN 1 THEN t WHEN 2 THEN n || ' 15 units' WHEN 3 THEN n || ' costs 1200.0' WHEN 4 THEN n WHEN 5 THEN t || ' ' || (z + 10) || ' of ' || substring(n, 1, 6) WHEN 6 THEN '' ELSE n || substring(t, 1, 3) END AS y FROM p)"""


@register("compare", rf"""WITH {_COMPARED},
s AS (SELECT *, {COMPARE.format('x')} AS a, {COMPARE.format('y')} AS b,
  list_sort(list_distinct(list_transform(regexp_extract_all(replace(x, ',', ''), '[0-9]+(?:\.[0-9]+)?'), lambda i: CASE WHEN contains(i, '.') THEN rtrim(rtrim(i, '0'), '.') ELSE i END))) AS na,
  list_sort(list_distinct(list_transform(regexp_extract_all(replace(y, ',', ''), '[0-9]+(?:\.[0-9]+)?'), lambda i: CASE WHEN contains(i, '.') THEN rtrim(rtrim(i, '0'), '.') ELSE i END))) AS nb FROM c),
g AS (SELECT *, CASE WHEN a = '' THEN [] ELSE {_GRAMS.format('a')} END AS ga, CASE WHEN b = '' THEN [] ELSE {_GRAMS.format('b')} END AS gb FROM s),
m AS (SELECT *, len(list_intersect(ga, gb)) AS met, length(a) AS la, length(b) AS lb FROM g),
r AS (SELECT *, CASE WHEN len(ga) = 0 OR len(gb) = 0 THEN CASE WHEN len(ga) = len(gb) THEN 1.0 ELSE 0.0 END ELSE round(2 * met / (len(ga) + len(gb)), 4) END AS score,
  CASE WHEN len(ga) = 0 OR len(gb) = 0 THEN 0.0 ELSE round(met / CASE WHEN la <= lb THEN len(ga) ELSE len(gb) END, 4) END AS share, len(na) > 0 AND len(nb) > 0 AS numbered,
  least(la, lb) AS short, greatest(la, lb) AS long FROM m),
v AS (SELECT *, CASE WHEN a = b THEN 'same' WHEN numbered AND na <> nb THEN 'numbers' WHEN short > 0 AND short >= 0.45 * long AND (contains(a, b) OR contains(b, a)) THEN 'contained'
  WHEN short >= 2 AND short >= 0.45 * long AND share >= 0.9 THEN 'subset' WHEN numbered AND len(list_filter(na, lambda i: length(i) >= 2)) > 0 AND score >= 0.45 THEN 'same_numbers' WHEN score >= 0.82 THEN 'similar' ELSE 'unrelated' END AS rule FROM r)
SELECT k, v, rule, CASE rule WHEN 'numbers' THEN 'conflict' WHEN 'unrelated' THEN 'unrelated' ELSE 'duplicate' END AS action,
  CASE WHEN rule = 'same' THEN 'existing' WHEN rule IN ('numbers', 'unrelated') THEN 'both' WHEN la >= lb THEN 'existing' ELSE 'candidate' END AS keep, CAST(score AS DOUBLE) AS similarity FROM v""")
def compare(spark, d):
    """Eight pairs of answers for each part, from its words: each rule decides some."""
    part = spread(table(spark, d, "part")).select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), F.col("p_type").alias("t"), (F.col("p_size") + 10).cast("string").alias("z"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("v"))
    n, t, z = F.col("n"), F.col("t"), F.col("z")
    pick = lambda *cases: F.get(F.array(*cases), F.col("v"))
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    old = pick(n, n, text(n, " 12 units"), text(n, " is 1,200"), text(t, " ", n), text(n, " ", t, " ", z), n, n)
    new = pick(text(F.upper(n), "!"), t, text(n, " 15 units"), text(n, " costs 1200.0"), n, text(t, " ", z, " of ", F.substring(n, 1, 6)), F.lit(""), text(n, F.substring(t, 1, 3)))
    pairs = part.select("k", "v", old.alias("x"), new.alias("y"))
    return dedupe.compare(pairs, "x", "y").select("k", "v", "rule", "action", "keep", F.col("similarity").cast("double").alias("similarity"))


@register("value_like", r"""WITH v AS (SELECT p_partkey AS k, unnest([0, 1, 2, 3, 4]) AS v, p_name AS n, p_size AS z, p_type AS t FROM part)
SELECT k, v, CASE v WHEN 0 THEN z >= 10 WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS value_like, CASE v WHEN 0 THEN z || '' WHEN 1 THEN CAST(1000 + z AS VARCHAR) WHEN 2 THEN '' WHEN 3 THEN z || '|12.5' ELSE CAST(z + 100 AS VARCHAR) END AS signature FROM v""")
def value_like(spark, d):
    """Bare numbers, numbers with thousands marks, none, several, and numbers in a sentence."""
    z = F.col("p_size").cast("string")
    thousand = F.format_number(F.col("p_size") + 1000, 0)
    values = F.array(z, F.concat(thousand, F.lit(" USD")), F.col("p_type"), F.concat(F.lit("12.50 / "), z), F.concat((F.col("p_size") + 100).cast("string"), F.lit(" of these were sold in the summer")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.posexplode(values).alias("v", "answer"))
    return rows.select("k", "v", tx.value_like(F.col("answer")).alias("value_like"), tx.signature(tx.numbers_signed(F.col("answer"))).alias("signature"))


SIMHASH = f"""WITH t AS (SELECT doc_id, unnest({TOKENS.format(squash_sql('text'))}) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*) AS k FROM t GROUP BY ALL),
words AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM tf),
h AS (SELECT w, list_reduce(list_transform(range(1, length(x) // 2 + 1), lambda i: CAST(('0x' || substring(x, CAST(2 * i - 1 AS BIGINT), 2)) AS INTEGER)::HUGEINT), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616, 14695981039346656037::HUGEINT) AS f FROM words),
bits AS (SELECT doc_id, i, sum(CASE WHEN (f // CAST(power(2::DOUBLE, i) AS HUGEINT)) % 2 = 1 THEN k ELSE -k END) AS v FROM tf JOIN h USING (w), range(64) r(i) GROUP BY ALL),
u AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN CAST(power(2::DOUBLE, i) AS HUGEINT) ELSE 0 END) AS s FROM bits GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN coalesce(s, 0) >= 9223372036854775808 THEN s - 18446744073709551616 ELSE coalesce(s, 0) END AS BIGINT) AS simhash FROM documents d LEFT JOIN u USING (doc_id)"""


@register("simhash64", SIMHASH)
def simhash64(spark, d):
    return documents(spark, d).select("doc_id", dedupe.simhash64(tx.normalize(F.col("text"))).alias("simhash"))


@register("simhash_neighbours", """WITH hashed AS (SELECT * FROM (SIMHASH) WHERE simhash <> 0), r AS (SELECT simhash, min(doc_id) AS id FROM hashed GROUP BY simhash),
p AS (SELECT a.id, b.id AS other, bit_count(xor(a.simhash, b.simhash)) AS distance, xor(a.simhash, b.simhash) AS x FROM r a JOIN r b ON a.id <> b.id)
SELECT id, other, CAST(distance AS INTEGER) AS distance, false AS member FROM p WHERE distance <= 3 AND bit_count((x >> 48) & 65535) <= 2
UNION ALL SELECT doc_id, id, 0, true FROM hashed JOIN r USING (simhash) WHERE doc_id <> id""".replace("SIMHASH", SIMHASH))
def simhash_neighbours(spark, d):
    """Pairs of different fingerprints by their smallest documents, and as members the other documents with that document's fingerprint."""
    hashed = settle(simhash64(spark, d).filter("simhash <> 0"), "simhashes")
    rows = hashed.groupBy("simhash").agg(F.min("doc_id").alias("id"))
    pairs = dedupe.simhash_neighbours(rows, rows).withColumn("member", F.lit(False))
    members = hashed.join(rows, "simhash").filter("doc_id <> id").select(F.col("doc_id").alias("id"), F.col("id").alias("other"), F.lit(0).alias("distance"), F.lit(True).alias("member"))
    return pairs.unionByName(members)


@register("grounded", f"""WITH s AS (SELECT doc_id, text, trim(regexp_replace(text, '[ \t\n\f\r\v]+', ' ', 'g'), ' ') AS t FROM documents),
u AS (SELECT doc_id, CASE WHEN length(t) <= 800 THEN t ELSE substring(t, 1, 799) || '…' END AS text FROM s)
SELECT doc_id, CAST(length({COMPARE.format('text')}) AS INTEGER) AS run, length({COMPARE.format('text')}) >= 6 AS grounded FROM u""")
def grounded(spark, d):
    """Each document's first 800 characters as an answer, against its whole text: runs far beyond what short answers need."""
    both = documents(spark, d).select("doc_id", tx.summarize(F.col("text"), 800).alias("answer"), F.col("text").alias("source"))
    return both.select("doc_id", grounding.longest_common_run("answer", "source").alias("run"), grounding.grounded("answer", "source").alias("grounded"))


@register("longest_common_run")
def longest_common_run(spark, d):
    """Benchmark items against the document of the same number."""
    both = table(spark, d, "benchmark").join(documents(spark, d).select("doc_id", F.col("text").alias("source")), F.col("item_id") == F.col("doc_id"))
    return both.select("item_id", grounding.longest_common_run("text", "source").alias("run"), grounding.grounded("text", "source").alias("grounded"))


@register("host_of", r"""SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\.', '') AS domain,
  lower(regexp_replace(split_part(url, '#', 1), '/+$', '')) AS page_key, CASE WHEN contains(url, 'wiki') THEN 'wiki' WHEN regexp_matches(url, '^https?://([^/?#]*\.)?example\.org(/|$)') THEN 'official' ELSE 'community' END AS source_type FROM pages""")
def host_of(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.host_of(u).alias("host"), urls.domain_of(u).alias("domain"), urls.page_key(u).alias("page_key"), urls.classify_source(u, ("example.org",), ("wiki.example",)).alias("source_type"))


@register("canonical_url", r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS canonical FROM pages""")
def canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@register("source_key")
def source_key(spark, d):
    return table(spark, d, "pages").select("page_id", urls.source_key(F.col("url")).alias("key"))


@register("is_blocked", r"""SELECT page_id, url FROM pages WHERE NOT regexp_matches(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '(^|\.)example\.net$')""")
def is_blocked(spark, d):
    """Pages of no blocked host: the host's suffixes meet the list in an equi-join."""
    pages = table(spark, d, "pages").select("page_id", "url", urls.host_of(F.col("url")).alias("_h"))
    blocked = spark.createDataFrame([("example.net",)], "suffix string")
    parts = F.split("_h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hit = pages.select("page_id", F.explode(suffixes).alias("suffix")).join(blocked, "suffix", "left_semi")
    return pages.join(hit, "page_id", "left_anti").select("page_id", "url")


@register("html_extract")
def html_extract(spark, d):
    return web.read_pages(table(spark, d, "pages")).select("page_id", "title", "text", "published")


@register("extract_links")
def extract_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(web.extract_links(F.col("html"), F.col("url"))).alias("seq", "l")).select("page_id", "seq", F.col("l.url").alias("link"), F.col("l.title").alias("title"))


@register("crawl_frontier")
def crawl_frontier(spark, d):
    links = extract_links(spark, d).join(table(spark, d, "pages").select("page_id", "url"), "page_id").select("url", F.col("link").alias("to"))
    return web.crawl(table(spark, d, "pages").select("url"), links)


@register("template_fields", """SELECT p_partkey, unnest(['name', 'brand', 'size', 'note']) AS field, unnest([p_name, p_brand, CAST(p_size AS VARCHAR), p_type]) AS value FROM part""")
def template_fields(spark, d):
    """A part's row as a template, and its fields read back."""
    part = spread(table(spark, d, "part"))
    text = F.concat(F.lit("{{part|name=[["), F.col("p_name"), F.lit("]]|brand='''"), F.col("p_brand"), F.lit("'''|size="), F.col("p_size").cast("string"), F.lit("|note={{n|"), F.col("p_type"), F.lit("}}}}"))
    return wikitext.template_fields(part.select("p_partkey", text.alias("wikitext")), "p_partkey", "wikitext", ["part"]).select("p_partkey", "field", "value")


@register("constant_fields", """WITH f AS (SELECT 'size' AS key, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT 'brand', p_brand FROM part UNION ALL SELECT 'kind', 'part' FROM part),
c AS (SELECT key, value, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT key, sum(n) AS n_rows, count(*) AS n_values, arg_max(value, (n, value)) AS top_value, max(n) AS m FROM c GROUP BY key)
SELECT key, CAST(n_rows AS BIGINT) AS n_rows, n_values, top_value, round(m / n_rows, 4) AS top_share FROM t WHERE n_rows >= 4 AND round(m / n_rows, 4) >= 0.8""")
def constant_fields(spark, d):
    from tidemark.operators import audit

    part = table(spark, d, "part")
    pairs = part.select(F.explode(F.array(F.struct(F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value")), F.struct(F.lit("brand").alias("key"), F.col("p_brand").alias("value")), F.struct(F.lit("kind").alias("key"), F.lit("part").alias("value")))).alias("x")).select("x.*")
    return audit.constant_fields(pairs)


@register("table_facts", """SELECT p_partkey, substring(p_name, 1, 24) || '（parts）' AS fact_title, 'parts 中「' || substring(p_name, 1, 24) || '」的详细信息：brand：' || p_brand || '；kind：' || p_type || '。' AS fact_answer FROM part""")
def table_facts(spark, d):
    """A part's row as a markdown table, and its fact."""
    part = table(spark, d, "part")
    text = F.concat(F.lit("| name | brand | kind |\n|---|---|---|\n| "), F.col("p_name"), F.lit(" | "), F.col("p_brand"), F.lit(" | "), F.col("p_type"), F.lit(" |"))
    return tables.table_facts(part.select("p_partkey", text.alias("text"), F.lit("parts").alias("page")), "text", "page").select("p_partkey", "fact_title", "fact_answer")


# --- retrieval -----------------------------------------------------------------------------------------------


_KEPT: dict[tuple, TextIndex] = {}


def kept_index(spark, d, name, source, rows):
    """The index of a table, built when it is first asked and again when the table's files have changed; rows() gives key, tokens and text."""
    state = table(spark, d, source).select("_metadata.file_path", "_metadata.file_modification_time").agg(F.count("*"), F.count_distinct("file_path"), F.max("file_modification_time")).first()
    key = (spark.sparkContext.applicationId, name, d, *state)
    if key not in _KEPT or not _KEPT[key].segments():  # the shared folder may have been cleared
        _KEPT[key] = search.new_index(rows())
    return _KEPT[key]


def chunk_index(spark, d):
    def rows():
        df = documents(spark, d).select("doc_id", F.explode(F.array(tx.normalize(F.col("text")))).alias("text"))
        return df.select(F.col("doc_id").alias("key"), tx.tokenize(F.col("text")).alias("tokens"), "text")

    return kept_index(spark, d, "chunks", "documents", rows)


def _chunks(spark, d):
    """The documents as chunks; their normalised texts are those that the index has stored."""
    known = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "source")
    df = chunk_index(spark, d).rows().join(known, "key")
    return df.select(F.col("key").alias("chunk_id"), F.col("text").alias("text_norm"), F.lit("").alias("title_norm"), F.when(F.col("source") == "src1", "official").otherwise("community").alias("source_type"))


def _questions(spark, d):
    return table(spark, d, "benchmark").withColumn("n", tx.normalize(F.col("text"))).select(F.col("item_id").alias("question_id"), F.col("n").alias("question_norm"), tx.tokenize_query(F.col("n")).alias("tokens"))


_BM25 = f"""docs AS (SELECT doc_id, source, {squash_sql('text')} AS t FROM documents),
tok AS (SELECT doc_id, unnest({TOKENS.format('t')}) AS term FROM docs),
len AS (SELECT docs.doc_id, len({TOKENS.format('t')}) AS len FROM docs),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM len),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT item_id AS question_id, list_distinct({TOKENS.format(squash_sql('text'))}) AS qt FROM benchmark),
qt AS (SELECT question_id, unnest(qt) AS term FROM q),
bm AS (SELECT question_id, post.doc_id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS bm
  FROM qt JOIN df USING (term) JOIN post USING (term) JOIN len ON len.doc_id = post.doc_id, st GROUP BY ALL),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm, doc_id) AS r FROM bm) WHERE r <= 40)"""


@register("bm25", f"WITH {_BM25} SELECT question_id, doc_id AS chunk_id, bm FROM pool WHERE r <= 10")
def bm25(spark, d):
    asked = _questions(spark, d).select("question_id", F.explode("tokens").alias("term"))
    return chunk_index(spark, d).top(asked, 10).withColumnRenamed("key", "chunk_id")


@register("index_follow", "WITH " + _BM25.replace("docs AS (SELECT doc_id, source,", "documents2 AS (SELECT doc_id, source, CASE WHEN lang = 'de' THEN text || ' the license of ' || source ELSE text END AS text FROM documents WHERE lang <> 'fr'),\ndocs AS (SELECT doc_id, source,").replace("AS t FROM documents)", "AS t FROM documents2)") + " SELECT question_id, doc_id AS chunk_id, bm FROM pool WHERE r <= 10")
def index_follow(spark, d):
    """Answers after the French documents are deleted and the German ones are changed: the index takes in what has changed."""
    tokens = tx.tokenize(F.col("text"))

    def rows(docs):
        return docs.select(F.col("doc_id").alias("key"), F.explode(F.array(tx.normalize(F.col("text")))).alias("text"))

    docs = documents(spark, d)
    index = search.new_index(rows(docs).withColumn("tokens", tokens))
    changed = F.when(F.col("lang") == "de", F.concat("text", F.lit(" the license of "), "source")).otherwise(F.col("text"))
    index.follow(rows(docs.filter("lang <> 'fr'").withColumn("text", changed)), tokens)
    asked = _questions(spark, d).select("question_id", F.explode("tokens").alias("term"))
    return index.top(asked, 10).withColumnRenamed("key", "chunk_id")


SEARCH_CHUNKS = f"""{_BM25},
sc AS (SELECT pool.question_id, pool.doc_id, bm, len(list_filter(qt, lambda x: contains(t, x))) / greatest(len(qt), 1) AS cov, CASE WHEN source = 'src1' THEN 0.12 ELSE 0 END AS bonus
  FROM pool JOIN q USING (question_id) JOIN docs ON docs.doc_id = pool.doc_id),
rel AS (SELECT *, round(least(1, cov * 0.62 + bonus) * CASE WHEN bm = 0 THEN 1 ELSE 1 - 0.5 / (1 + greatest(-bm, 0)) END, 4) AS relevance FROM sc),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY relevance DESC, bm, doc_id) AS rank FROM rel)"""


@register("search_chunks", f"WITH {SEARCH_CHUNKS} SELECT question_id, doc_id AS chunk_id, CAST(relevance AS DOUBLE) AS relevance, round(cov, 4) AS coverage, CAST(rank AS INTEGER) AS rank, bm FROM best WHERE rank <= 10")
def search_chunks(spark, d):
    return search.search_chunks(_chunks(spark, d), _questions(spark, d), 10, index=chunk_index(spark, d))


@register("build_evidence", f"""WITH {SEARCH_CHUNKS}, b AS (SELECT question_id, best.doc_id, rank, trim(docs.t, ' ') AS t FROM best JOIN docs ON docs.doc_id = best.doc_id WHERE rank <= 10 AND relevance >= 0.05 AND length(trim(docs.t, ' ')) > 0),
c AS (SELECT *, 12000 - coalesce(sum(length(t)) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM b)
SELECT question_id, doc_id AS chunk_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank) AS INTEGER) AS index, substring(t, 1, CAST(room AS BIGINT)) AS text FROM c WHERE room > 200""")
def build_evidence(spark, d):
    chunks = _chunks(spark, d)
    hits = settle(search.relevance_floor(search.search_chunks(chunks, _questions(spark, d), 10, index=chunk_index(spark, d)), 0.05), "hits")
    chunks = chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    items = hits.join(chunks.select("chunk_id", F.col("text_norm").alias("text")), "chunk_id")
    return search.evidence(items, "question_id", "rank").select("question_id", "chunk_id", "index", "text")


@register("cosine_topk", """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS relevance FROM q, embeddings WHERE query_id <> vec_id)
SELECT query_id, vec_id, relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, vec_id) AS r FROM s WHERE relevance > 0) WHERE r <= 10""")
def cosine_topk(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return search.cosine_topk(vectors, vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10).select("query_id", "vec_id", "relevance")


_FACT_TOKENS = "regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9_+#.-]*|[0-9]+(?:[.][0-9]+)?%?')"


@register("search_facts", with_facts(f"""f AS (SELECT *, lower(title) AS tn, lower(title) || ' ' || lower(tags) || ' ' || lower(answer) AS hay, {_FACT_TOKENS.format("lower(title) || ' ' || lower(answer)")} AS tok FROM facts WHERE status = 'active'),
q AS (SELECT p_partkey AS qid, 'price of part' || p_partkey AS qn, ['price', 'of', 'part' || p_partkey] AS qt FROM part WHERE p_partkey % 20 = 0),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tok) AS term FROM f) GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len(tok)) AS avg_len FROM f), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT qid, post.id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tok) / avg_len))), 6) AS bm
  FROM (SELECT qid, unnest(qt) AS term FROM q) JOIN df USING (term) JOIN post USING (term) JOIN f ON f.id = post.id, st GROUP BY ALL),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm, id) AS r FROM bm) WHERE r <= 32),
sc AS (SELECT pool.qid, pool.id, bm, slot, version, effective_from, split_part(tn, '·', 1) AS entity, len(list_filter(qt, lambda x: contains(hay, x))) / 3 AS cover, len(list_filter(qt, lambda x: contains(tn, x))) / 3 AS in_title,
  CASE WHEN contains(qn, split_part(tn, '·', 1)) THEN 1.0 ELSE 0.0 END AS hit, confidence FROM pool JOIN f ON f.id = pool.id JOIN q ON q.qid = pool.qid),
ra AS (SELECT *, round(cover * 0.75 + confidence * 0.25, 4) AS relevance FROM sc), rb AS (SELECT *, round(relevance + 0.35 * least(1, in_title) + 0.5 * hit, 6) AS rank_raw FROM ra),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hit DESC, rank_raw DESC, round(bm, 4), id) AS pos FROM rb),
w AS (SELECT *, row_number() OVER (PARTITION BY qid, slot ORDER BY pos) AS k, row_number() OVER (PARTITION BY qid, slot ORDER BY effective_from DESC, version DESC, pos) AS j FROM o),
m AS (SELECT a.qid, a.id, a.relevance, a.rank_raw, a.entity, a.hit, b.pos FROM w a JOIN w b ON a.qid = b.qid AND a.slot = b.slot AND a.j = b.k),
e AS (SELECT *, hit > 0 AND row_number() OVER (PARTITION BY qid, entity, hit > 0 ORDER BY pos) = 1 AS ahead FROM m)
SELECT qid AS question_id, id, CAST(relevance AS DOUBLE) AS relevance, CAST(rank_raw AS DOUBLE) AS rank_raw, CAST(pos AS INTEGER) AS pos FROM (SELECT qid, id, relevance, rank_raw, row_number() OVER (PARTITION BY qid ORDER BY ahead DESC, pos) AS pos FROM e) WHERE pos <= 8"""))
def search_facts(spark, d):
    asked = table(spark, d, "part").filter("p_partkey % 20 = 0").withColumn("n", F.concat(F.lit("price of part"), F.col("p_partkey").cast("string")))
    asked = asked.select(F.col("p_partkey").alias("question_id"), F.col("n").alias("question_norm"), tx.tokenize_query(F.col("n")).alias("tokens"))
    return search.search_facts(asked_facts(spark, d), asked, 8, index=fact_index(spark, d))


def asked_facts(spark, d):
    """The active facts as a search takes them."""
    f = facts(spark, d).filter("status = 'active'").withColumn("title_norm", tx.squash(F.col("title")))
    return f.select("id", "title", "title_norm", F.concat_ws(" ", "title_norm", F.lower("tags"), F.lower("answer")).alias("haystack"), "confidence", "version", "effective_from", F.col("slot").alias("slot_key"))


def fact_index(spark, d):
    def rows():
        f = facts(spark, d).filter("status = 'active'").withColumn("title_norm", tx.squash(F.col("title")))
        tokens = tx.tokenize(F.concat_ws(" ", "title_norm", F.lower("answer")))
        return f.select(F.col("id").alias("key"), tokens.alias("tokens"), F.concat_ws(" ", "title_norm", F.lower("tags"), F.lower("answer")).alias("text"))

    return kept_index(spark, d, "facts", "lineitem", rows)


@register("fact_fallback", with_facts("""f AS (SELECT *, lower(title) || ' ' || lower(tags) || ' ' || lower(answer) AS hay FROM facts WHERE status = 'active'), q AS (SELECT p_partkey AS question_id, 'art' || p_partkey AS part FROM part WHERE p_partkey % 20 = 0),
m AS (SELECT question_id, id, confidence, slot, version, effective_from, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, id) AS pos FROM q JOIN f ON contains(hay, part)),
w AS (SELECT *, row_number() OVER (PARTITION BY question_id, slot ORDER BY pos) AS k, row_number() OVER (PARTITION BY question_id, slot ORDER BY effective_from DESC, version DESC, pos) AS j FROM m WHERE pos <= 32)
SELECT a.question_id, a.id, CAST(round(0.75 + a.confidence * 0.25, 4) AS DOUBLE) AS relevance, CAST(b.pos AS INTEGER) AS pos FROM w a JOIN w b ON a.question_id = b.question_id AND a.slot = b.slot AND a.j = b.k WHERE b.pos <= 8"""))
def fact_fallback(spark, d):
    """Questions whose word no fact has, as it is a part of one: the facts that contain it, the most trusted first."""
    asked = table(spark, d, "part").filter("p_partkey % 20 = 0")
    asked = asked.select(F.col("p_partkey").alias("question_id"), F.concat(F.lit("art"), F.col("p_partkey").cast("string")).alias("question_norm")).withColumn("tokens", F.array("question_norm"))
    return search.search_facts(asked_facts(spark, d), asked, 8, index=fact_index(spark, d)).select("question_id", "id", "relevance", "pos")


@register("mentioned_entities", rf"""WITH u AS (SELECT conv_id || '-' || turn AS question_id, {squash_sql('text')} AS low FROM conversations WHERE role = 'user'),
names AS (SELECT DISTINCT lower(regexp_extract(text, '^([\p{{L}}\p{{N}}_]+ [\p{{L}}\p{{N}}_]+)', 1)) AS name FROM documents),
m AS (SELECT question_id, list(struct_pack(e := strpos(low, name) + length(name), at := strpos(low, name), names := [name]) ORDER BY strpos(low, name), -length(name), name) AS hits FROM u JOIN names ON length(name) >= 2 AND contains(low, name) GROUP BY question_id)
SELECT question_id, array_to_string(list_reduce(hits, lambda s, h: CASE WHEN h.at >= s.e THEN struct_pack(e := h.e, at := h.at, names := s.names || h.names) ELSE s END).names, '|') AS entities FROM m""")
def mentioned_entities(spark, d):
    asked = table(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), tx.normalize(F.col("text")).alias("question_norm"))
    known = documents(spark, d).select(F.lower(F.regexp_extract("text", r"^([\p{L}\p{N}_]+ [\p{L}\p{N}_]+)", 1)).alias("name")).distinct()
    return search.mentioned_entities(asked, known).select("question_id", F.array_join("entities", "|").alias("entities"))
