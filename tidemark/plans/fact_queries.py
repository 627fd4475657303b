"""Queries on facts: trust, versions, votes, merges, lifecycle, audits, the topic queue, evaluation and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import trust, urls, wikitext
from tidemark.functions import versions as vs
from tidemark.operators import answers, audit, dedupe, lifecycle, names, search, topics, vote
from tidemark.operators.steps import scratch, settle
from tidemark.plans.catalog import register
from tidemark.plans.relations import documents, facts, table, with_facts
from tidemark.sources import providers
from tidemark.streaming import events as ev
from tidemark.streaming import queue

AS_OF = "1998-12-01 00:00:00"

# --- scans -----------------------------------------------------------------------------------------------------


@register("scan_documents_page", "SELECT doc_id, source, n_chars FROM documents WHERE contains(text, 'the') ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 10")
def scan_documents_page(spark, d):
    df = table(spark, d, "documents").filter(F.contains("text", F.lit("the"))).select("doc_id", "source", "n_chars")
    return df.orderBy(F.desc("n_chars"), "doc_id").offset(10).limit(50)


@register("scan_facts_page", with_facts("SELECT id, title, confidence FROM facts WHERE status = 'active' ORDER BY confidence DESC, id LIMIT 100"))
def scan_facts_page(spark, d):
    return facts(spark, d).filter("status = 'active'").orderBy(F.desc("confidence"), "id").limit(100).select("id", "title", "confidence")


@register("title_lookup", with_facts("SELECT title, id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY confidence DESC, published DESC, id) AS r FROM facts) WHERE r <= 3"))
def title_lookup(spark, d):
    return search.top(facts(spark, d).select("id", "title", "confidence", "published"), "title", 3, F.desc("confidence"), F.desc("published"), F.asc("id")).select("title", "id", "confidence")


@register("point_lookup", with_facts("SELECT f.id, f.title, f.answer, p_brand FROM facts f JOIN part ON f.title = 'part' || p_partkey || '·price' WHERE p_partkey = 7"))
def point_lookup(spark, d):
    part = table(spark, d, "part").filter("p_partkey = 7").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string"), F.lit("·price")).alias("title"), "p_brand")
    return facts(spark, d).join(part, "title").select("id", "title", "answer", "p_brand")


@register("sample_facts", with_facts("SELECT id, title FROM facts WHERE length(title) BETWEEN 9 AND 12 ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 50"))
def sample_facts(spark, d):
    """A sample by hash order: the same rows on any cluster."""
    return facts(spark, d).filter(F.length("title").between(9, 12)).orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(50).select("id", "title")


@register("stats", with_facts("SELECT source_type, count(*) AS n, count(*) FILTER (status = 'active') AS n_active FROM facts GROUP BY 1"))
def stats(spark, d):
    return audit.stats(facts(spark, d), "source_type")


# --- trust and versions ------------------------------------------------------------------------------------------

_TRUST = f"""a AS (SELECT *, CASE WHEN published >= TIMESTAMP '{AS_OF}' - INTERVAL 183 DAY THEN 1.0 WHEN published >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY THEN 0.7 ELSE 0.4 END AS fresh,
  CASE source_type WHEN 'official' THEN 1.0 WHEN 'wiki' THEN 0.75 ELSE 0.5 END AS src, CASE extraction WHEN 'api' THEN 1.0 WHEN 'table' THEN 0.85 ELSE 0.6 END AS ext, CASE WHEN status = 'superseded' THEN 0.2 ELSE 0.6 END AS agree FROM facts),
t AS (SELECT *, CAST(round(greatest(0.05, least(1.0, 0.45 * src + 0.25 * ext + 0.2 * agree + 0.1 * fresh)), 4) AS DOUBLE) AS trust FROM a)"""


def _trusted(spark, d):
    f = facts(spark, d)
    fresh = trust.freshness(F.col("published").cast("timestamp"), F.lit(AS_OF).cast("timestamp"), trust.time_sensitive(F.col("title"), F.col("answer")))
    return f.withColumns({"fresh": fresh, "agree": trust.consistency(F.lit(1), F.col("status") == "superseded")})


@register("trust_score", with_facts(f"{_TRUST} SELECT id, trust, CAST(fresh AS DOUBLE) AS fresh FROM t"))
def trust_score(spark, d):
    return _trusted(spark, d).select("id", trust.trust(F.col("source_type"), F.col("extraction"), F.col("agree"), F.col("fresh")).alias("trust"), "fresh")


@register("trust_penalised", with_facts(f"{_TRUST} SELECT id, CAST(round(greatest(0.05, least(1.0, trust * 0.6)), 4) AS DOUBLE) AS trust FROM t"))
def trust_penalised(spark, d):
    return _trusted(spark, d).select("id", trust.trust(F.col("source_type"), F.col("extraction"), F.col("agree"), F.col("fresh"), F.lit(0.6)).alias("trust"))


@register("trust_tag", with_facts(f"""{_TRUST} SELECT id, format('提取:{{}} 可信度:{{:.2f}}(来源{{:.2f}}/提取{{:.2f}}/一致{{:.2f}}/时效{{:.2f}})', extraction, trust, CAST(src AS DOUBLE), CAST(ext AS DOUBLE), CAST(agree AS DOUBLE), CAST(fresh AS DOUBLE)) AS tag FROM t"""))
def trust_tag(spark, d):
    return _trusted(spark, d).select("id", trust.trust_tag(F.col("source_type"), F.col("extraction"), F.col("agree"), F.col("fresh")).alias("tag"))


@register("date_parse", "SELECT o_orderkey, epoch_ms(o_orderdate) // 1000 AS seconds FROM orders")
def date_parse(spark, d):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", F.unix_timestamp(trust.parse_date(text)).alias("seconds"))


@register("extract_version", "SELECT p_partkey, '1.' || greatest(p_size % 12, 3) AS version, [1, greatest(p_size % 12, 3)] AS version_key FROM part")
def extract_version(spark, d):
    part = table(spark, d, "part")
    text = F.concat(F.lit("版本1."), (F.col("p_size") % 12).cast("string"), F.lit("，后续1.3版本，伤害12.50%"))
    out = part.select("p_partkey", vs.extract_version(text).alias("version"))
    return out.withColumn("version_key", vs.version_key(F.col("version")))


@register("extract_date_info", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN year(o_orderdate) >= 2000 THEN 'effective' ELSE 'effective' END AS kind FROM (SELECT o_orderkey, o_orderdate + INTERVAL 20 YEAR AS o_orderdate FROM orders)""")
def extract_date_info(spark, d):
    day = F.col("o_orderdate") + F.expr("INTERVAL 20 YEAR")
    text = F.concat(F.lit("将于"), F.date_format(day, "yyyy年M月d日"), F.lit("版本更新后开启"))
    return table(spark, d, "orders").select("o_orderkey", vs.extract_date_info(F.lit("x"), text, F.lit("")).alias("i")).select("o_orderkey", "i.date", "i.kind")


@register("url_date", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d') AS published FROM orders")
def url_date(spark, d):
    day = F.col("o_orderdate") + F.expr("INTERVAL 20 YEAR")
    return table(spark, d, "orders").select("o_orderkey", urls.url_date(F.concat(F.lit("https://a.example/"), F.date_format(day, "yyyyMMdd"), F.lit("/1.html"))).alias("published"))


@register("question_date", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d') AS asked, strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d') AS start FROM orders")
def question_date(spark, d):
    day = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 20 YEAR"), "yyyy年M月d日")
    return table(spark, d, "orders").select("o_orderkey", vs.question_date(F.concat(day, F.lit("可以用吗？"))).alias("asked"), vs.explicit_start(F.concat(F.lit("自"), day, F.lit("起生效")), F.lit("")).alias("start"))


@register("slot_key", with_facts("SELECT id, split_part(title, '·', 1) AS entity, slot FROM facts"))
def slot_key(spark, d):
    f = facts(spark, d).withColumn("entity", vs.entity_of(F.col("title")))
    return f.select("id", "entity", vs.slot_key(F.col("entity"), F.col("title")).alias("slot"))


@register("newest_in_slot", with_facts("""r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY id) AS k, row_number() OVER (PARTITION BY slot ORDER BY effective_from DESC, version DESC, id) AS j FROM facts)
SELECT a.id, b.id AS pos FROM r a JOIN r b ON a.slot = b.slot AND a.j = b.k"""))
def newest_in_slot(spark, d):
    """All facts as one list in order of id; a question's pool is such a list."""
    f = facts(spark, d).select("id", F.col("id").alias("pos"), F.col("slot").alias("slot_key"), "version", "effective_from", F.lit(1).alias("q"))
    return search.newest_in_slot(f, "q").select("id", "pos")


# --- votes and merges --------------------------------------------------------------------------------------------

_VOTE = """ok AS (SELECT * FROM facts WHERE status NOT IN ('superseded', 'revoked')),
b AS (SELECT *, regexp_replace(regexp_extract(source_url, '^https?://([^/]*)', 1), '^www\\.', '') AS domain FROM ok
  UNION ALL SELECT *, regexp_extract(tags, '并入:([a-z0-9.]+)', 1) AS domain FROM ok WHERE contains(tags, '并入:')),
w AS (SELECT slot, domain, id, version, effective_from, regexp_extract(answer, '[0-9]+') AS sig, row_number() OVER (PARTITION BY slot, domain ORDER BY confidence DESC, version DESC, effective_from DESC, seq) AS r FROM b),
g AS (SELECT slot, count(*) AS n_domains, string_agg(domain, ',' ORDER BY domain) AS domains, count(DISTINCT id) AS n_facts, string_agg(DISTINCT CAST(id AS VARCHAR), ',') AS ids, list_sort(list_distinct(list(id))) AS idl,
  count(DISTINCT sig) AS n_values, count(DISTINCT effective_from || '@' || version) AS n_versions FROM w WHERE r = 1 GROUP BY slot),
v AS (SELECT *, CASE WHEN n_domains < 2 THEN 'single' WHEN n_versions > 1 THEN 'versioned' WHEN n_values = 1 THEN 'multi' ELSE 'conflict' END AS verdict FROM g)"""


@register("vote", with_facts(f"{_VOTE} SELECT slot, verdict, n_domains, domains, n_facts, array_to_string(idl, ',') AS fact_ids, n_values, n_versions FROM v"))
def vote_query(spark, d):
    return vote.vote(vote.candidates(facts(spark, d)))


@register("vote_summary", with_facts(f"{_VOTE} SELECT count(*) AS slots, count(*) FILTER (verdict = 'multi') AS multi, count(*) FILTER (verdict = 'conflict') AS conflict, count(*) FILTER (verdict = 'versioned') AS versioned, count(*) FILTER (verdict = 'single') AS single FROM v"))
def vote_summary(spark, d):
    return vote.summary(vote.vote(vote.candidates(facts(spark, d))))


@register("reconcile", with_facts(f"""{_VOTE}, hit AS (SELECT DISTINCT b.id, v.verdict FROM b JOIN v USING (slot) WHERE v.verdict IN ('multi', 'conflict'))
SELECT f.id, CASE WHEN verdict = 'conflict' AND status = 'active' THEN 'conflict' ELSE status END AS status, CASE WHEN verdict = 'multi' THEN round(least(1.0, confidence + 0.08), 4) ELSE confidence END AS confidence,
  CASE verdict WHEN 'multi' THEN tags || ' | 多源确认' WHEN 'conflict' THEN tags || ' | 多源冲突' ELSE tags END AS tags FROM facts f LEFT JOIN hit USING (id)"""))
def reconcile(spark, d):
    return vote.reconcile(facts(spark, d)).select("id", "status", "confidence", "tags")


@register("duplicate_groups", with_facts("""m AS (SELECT title, answer, min(id) AS id FROM facts GROUP BY ALL)
SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, 'conflict' AS action FROM m x JOIN m y ON x.title = y.title AND x.id < y.id AND x.answer <> y.answer"""))
def duplicate_groups(spark, d):
    return dedupe.duplicate_groups(facts(spark, d)).select("a", "b", "action")


@register("merge_seed_facts", with_facts(r"""h AS (SELECT *, regexp_extract(source_url, '^https?://([^/]+)', 1) AS host, row_number() OVER (PARTITION BY title, answer ORDER BY seq) AS i FROM facts),
p AS (SELECT title, answer, host, min(seq) AS first, count(*) AS n, min(i) = 1 AS own FROM h GROUP BY ALL),
m AS (SELECT title, answer, count(*) - 1 AS merged, max(confidence) AS confidence, arg_min(tags, seq) AS tags FROM facts GROUP BY ALL),
t AS (SELECT title, answer, coalesce(string_agg(' 并入:' || host, '' ORDER BY first) FILTER (NOT own OR n > 1), '') AS marks FROM p GROUP BY ALL)
SELECT title, answer, CAST(merged AS BIGINT) AS merged, CAST(confidence AS DOUBLE) AS confidence, tags || marks AS tags FROM m JOIN t USING (title, answer)"""))
def merge_seed_facts(spark, d):
    """Answers of one title differ in their numbers, so each is kept; their repeats are merged."""
    out = dedupe.merge_seed_facts(facts(spark, d))
    return out.select("title", "answer", F.col("merged").cast("long").alias("merged"), "confidence", "tags")


@register("credit_multi_source", with_facts("""c AS (SELECT DISTINCT f.id FROM facts f JOIN (SELECT DISTINCT id - id % 10 AS o FROM facts WHERE id % 10 = 5) x ON f.id - f.id % 10 = x.o)
SELECT f.id, CASE WHEN c.id IS NOT NULL THEN round(least(1.0, confidence + 0.08), 4) ELSE confidence END AS confidence FROM facts f LEFT JOIN c USING (id)"""))
def credit_multi_source(spark, d):
    f = facts(spark, d)
    base = lambda c: c - c % 10
    seen = f.filter("id % 10 = 5").select(base(F.col("id")).alias("o")).distinct()
    hits = f.select("id", base(F.col("id")).alias("o")).join(seen, "o").select("id", F.lit("https://other.example/").alias("url"))
    return dedupe.credit_multi_source(f, hits).select("id", "confidence")


@register("decide_tier", with_facts("""c AS (SELECT p_partkey AS cid, 'part' || p_partkey || '·price' AS title, CASE p_size % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'wiki' WHEN 2 THEN 'manual' ELSE 'community' END AS st FROM part),
s AS (SELECT cid, st, f.id, f.source_type, f.published FROM c JOIN facts f ON f.title = c.title),
t AS (SELECT *, CASE source_type WHEN 'official' THEN 3 WHEN 'wiki' THEN 2 ELSE 1 END AS old, CASE WHEN st IN ('official', 'manual') THEN 3 WHEN st = 'wiki' THEN 2 ELSE 1 END AS new FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY old DESC, published DESC, id) AS r FROM t)
SELECT cid, id AS target, CASE WHEN new > old THEN 'supersede' WHEN new < old THEN 'skip_lower_tier' ELSE 'model' END AS decision FROM r WHERE r = 1"""))
def decide_tier(spark, d):
    """A candidate for each part's price against all facts of that title."""
    kind = F.col("p_size") % 4
    c = table(spark, d, "part").select(F.col("p_partkey").alias("cid"), F.concat(F.lit("part"), F.col("p_partkey").cast("string"), F.lit("·price")).alias("title"), F.when(kind == 0, "official").when(kind == 1, "wiki").when(kind == 2, "manual").otherwise("community").alias("source_type"))
    s = c.select("cid", "title").join(facts(spark, d).select("id", "title", "source_type", F.col("published").cast("string").alias("updated_at")), "title")
    return dedupe.decide_tier(c, s)


# --- lifecycle -----------------------------------------------------------------------------------------------------

_SPLIT = "1996-01-01"


def _versions(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("content_hash"), F.round("o_totalprice", 2).alias("price"), "o_orderdate")
    old, new = orders.filter(F.col("o_orderdate") < _SPLIT), orders.filter(F.col("o_orderdate") >= _SPLIT)
    return tuple(lifecycle.latest(x.drop("o_orderdate"), "url", "k") for x in (old, new))


_UP = f"""v AS (SELECT o_custkey AS url, o_orderkey AS k, o_orderstatus AS content_hash, round(o_totalprice, 2) AS price, o_orderdate < TIMESTAMP '{_SPLIT}' AS old FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY url, old ORDER BY k DESC) AS r FROM v), a AS (SELECT * FROM l WHERE r = 1 AND old), b AS (SELECT * FROM l WHERE r = 1 AND NOT old),
u AS (SELECT coalesce(a.url, b.url) AS url, coalesce(b.k, a.k) AS k, coalesce(b.content_hash, a.content_hash) AS content_hash, coalesce(b.price, a.price) AS price,
  CASE WHEN b.url IS NULL THEN 'keep' WHEN a.url IS NULL THEN 'insert' WHEN a.content_hash = b.content_hash THEN 'touch' ELSE 'update' END AS change FROM a FULL JOIN b ON a.url = b.url)"""


@register("upsert_document", f"WITH {_UP} SELECT * FROM u")
def upsert_document(spark, d):
    return lifecycle.upsert(*_versions(spark, d))


@register("supersede_changed", with_facts(f"""{_UP}, ch AS (SELECT DISTINCT 'https://www.s' || (url % 7) || '.example.com/p/' || url AS u FROM u WHERE change = 'update')
SELECT id, CASE WHEN ch.u IS NOT NULL AND extraction NOT IN ('manual', 'api') AND status IN ('active', 'conflict') THEN 'superseded' ELSE status END AS status FROM facts LEFT JOIN ch ON source_url = ch.u"""))
def supersede_changed(spark, d):
    changed = lifecycle.upsert(*_versions(spark, d)).filter("change = 'update'")
    pages = changed.select(F.concat(F.lit("https://www.s"), (F.col("url") % 7).cast("string"), F.lit(".example.com/p/"), F.col("url").cast("string")).alias("url"))
    return lifecycle.supersede_changed(facts(spark, d), pages).select("id", "status")


@register("revoke_source", with_facts("SELECT status, count(*) AS n FROM (SELECT CASE WHEN contains(source_url, 's3.example.com') THEN 'revoked' ELSE status END AS status FROM facts) GROUP BY 1"))
def revoke_source(spark, d):
    f = lifecycle.revoke_source(facts(spark, d), urls.host_matches(urls.host_of(F.col("source_url")), "s3.example.com"))
    return f.groupBy("status").agg(F.count("*").alias("n"))


@register("without_revoked", with_facts("SELECT id FROM facts WHERE (source_url, title) NOT IN (SELECT source_url, title FROM facts WHERE id % 10 = 6)"))
def without_revoked(spark, d):
    f = facts(spark, d)
    return lifecycle.without_revoked(f, f.filter("id % 10 = 6"), ["source_url", "title"]).select("id")


@register("extraction_state", "SELECT o_orderkey AS doc_id FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 3 >= 2)")
def extraction_state(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus")
    state = docs.filter("o_orderstatus = 'F'").select("doc_id", F.lit("table").alias("step"), (F.col("doc_id") % 3).alias("version"))
    return lifecycle.pending(docs, lifecycle.merge_state(state, state), "table", 2).select("doc_id")


@register("manual_overlay", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'manual' ELSE p_brand END AS p_brand, p_size FROM part")
def manual_overlay(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return lifecycle.overlay(part, part.filter("p_partkey % 10 = 0").select("p_partkey", F.lit("manual").alias("p_brand")), "p_partkey")


# --- audits and evaluation -----------------------------------------------------------------------------------------


@register("kb_report", with_facts(r"""SELECT count(*) AS facts, count(DISTINCT source_type) AS tiers, count(DISTINCT regexp_replace(regexp_extract(source_url, '^https?://([^/]*)', 1), '^www\.', '')) AS domains, count(*) FILTER (source_url = '') AS missing_url, count(*) FILTER (tags = '') AS missing_tag,
  count(DISTINCT confidence) AS confidence_unique, round(count(*) FILTER (confidence >= 0.9) / count(*), 4) AS confidence_high_ratio, round(median(confidence), 4) AS confidence_median, CAST(min(length(answer)) AS INTEGER) AS shortest, CAST(max(length(answer)) AS INTEGER) AS longest, count(*) AS numeric_facts FROM facts"""))
def kb_report(spark, d):
    return audit.kb_report(facts(spark, d).withColumn("domain", urls.domain_of(F.col("source_url"))))


@register("confidence_bands", with_facts("SELECT round(floor(confidence * 10 + 1e-9) / 10, 1) AS band, count(*) AS n FROM facts GROUP BY 1"))
def confidence_bands(spark, d):
    return audit.confidence_bands(facts(spark, d))


@register("report_conflicts", with_facts("""v AS (SELECT title, id, regexp_extract(answer, '[0-9]+') AS value FROM facts), g AS (SELECT title, count(DISTINCT value) AS n_values, string_agg(DISTINCT value, '|' ORDER BY value) AS values FROM v GROUP BY title)
SELECT title, '点' AS unit, n_values, values FROM g WHERE n_values > 1"""))
def report_conflicts(spark, d):
    return audit.report_conflicts(facts(spark, d).withColumn("answer", F.regexp_replace("answer", " USD", "点")))


@register("audit_copies")
def audit_copies(spark, d):
    """Pairs of texts that two sources share, and (member) a source's other documents of a text in a pair, each with the one that stands for them."""
    docs = documents(spark, d)
    pairs = settle(audit.copies(docs, "doc_id", "source", "text"), "copies")
    members = audit.copy_members(docs, pairs, "doc_id", "source", "text").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("dice"), F.lit("member").alias("kind"))
    return pairs.withColumn("kind", F.lit("pair")).unionByName(members)


@register("audit_placeholder", r"SELECT doc_id FROM documents WHERE length(trim(text)) < 2")
def audit_placeholder(spark, d):
    return documents(spark, d).filter(audit.placeholder(F.col("text"))).select("doc_id")


@register("audit_duplicate", r"""WITH a AS (SELECT source, lower(regexp_replace(text, '[\s　 ，。、；：！？“”‘’（）【】《》「」『』…—·,.;:!?"''()\[\]<>/\\|~`^&*+=_-]+', '', 'g')) AS body FROM documents)
SELECT md5(body) AS body_md5, count(DISTINCT source) AS titles, count(*) AS n FROM a WHERE length(body) >= 8 GROUP BY body HAVING count(DISTINCT source) > 1""")
def audit_duplicate(spark, d):
    return audit.duplicate_bodies(documents(spark, d), "source", "text").select(F.md5(F.col("body").cast("binary")).alias("body_md5"), "titles", "n")


@register("audit_collision", "SELECT 'price' AS field, p_retailprice AS value, count(DISTINCT p_partkey) AS entities FROM part GROUP BY 2 HAVING count(DISTINCT p_partkey) > 1")
def audit_collision(spark, d):
    return audit.collisions(table(spark, d, "part").withColumn("f", F.lit("price")), "p_partkey", "f", "p_retailprice")


@register("audit_foreign", "SELECT doc_id, array_to_string(list_filter(['idiot', 'moron', 'trash'], lambda n: contains(text, n)), ',') AS names FROM documents WHERE contains(text, 'idiot') OR contains(text, 'moron') OR contains(text, 'trash')")
def audit_foreign(spark, d):
    foreign = spark.createDataFrame([(n,) for n in ("idiot", "moron", "trash")], "name string")
    return names.present(documents(spark, d), foreign, "doc_id", "text").select("doc_id", F.array_join("names", ",").alias("names"))


_GAP = r"""lower(regexp_replace(text, '[\s　 ，。、；：！？“”‘’（）【】《》「」『』…—·,.;:!?"''()\[\]<>/\\|~`^&*+=_-]+', '', 'g'))"""
_GAP_NUMBERS = r"""list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g'), '[0-9]+(?:\.[0-9]+)?'), lambda x: CASE WHEN contains(x, '.') THEN rtrim(rtrim(x, '0'), '.') ELSE x END))"""


@register("gap_judge", rf"""WITH src AS (SELECT 'b' || item_id AS id, text FROM benchmark UNION ALL SELECT 'p' || p_partkey, p_name || ' costs ' || p_size || ',000 and ' || (p_partkey % 50) || '.50 or ' || p_partkey || '77 zqxj' FROM part),
p AS (SELECT id, {_GAP} AS t, {_GAP_NUMBERS} AS n FROM src), c AS (SELECT {_GAP} AS t, {_GAP_NUMBERS} AS n FROM documents),
h AS (SELECT DISTINCT substring(t, i, 2) AS x FROM (SELECT t, unnest(range(1, length(t))) AS i FROM c)), a AS (SELECT DISTINCT id, substring(t, i, 2) AS x FROM (SELECT id, t, unnest(range(1, length(t))) AS i FROM p)),
s AS (SELECT id, round(avg(CASE WHEN h.x IS NULL THEN 0 ELSE 1 END), 4) AS share FROM a LEFT JOIN h USING (x) GROUP BY id),
k AS (SELECT DISTINCT unnest(n) AS x FROM c), m AS (SELECT id, count(*) FILTER (k.x IS NULL) AS missing FROM (SELECT id, unnest(n) AS x FROM p) w LEFT JOIN k USING (x) GROUP BY id)
SELECT id, share, CAST(coalesce(missing, 0) AS BIGINT) AS missing_numbers, share >= 0.6 AND coalesce(missing, 0) = 0 AS supported FROM s LEFT JOIN m USING (id)""")
def gap_judge(spark, d):
    """Benchmark items, and made-up statements with numbers, against all documents."""
    k = F.col("p_partkey").cast("string")
    stated = F.concat(F.col("p_name"), F.lit(" costs "), F.col("p_size").cast("string"), F.lit(",000 and "), (F.col("p_partkey") % 50).cast("string"), F.lit(".50 or "), k, F.lit("77 zqxj"))
    points = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text").union(table(spark, d, "part").select(F.concat(F.lit("p"), k), stated))
    return audit.gap_judge(points, documents(spark, d), "id", "text", "text")


@register("compare_sources", """WITH a AS (SELECT p_partkey AS k, p_retailprice AS v FROM part), b AS (SELECT l_partkey AS k, max(l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value, round(a.v / nullif(b.v, 0), 4) AS ratio, CASE WHEN a.v IS NULL THEN 'right_only' WHEN b.v IS NULL THEN 'left_only' WHEN abs(round(a.v / b.v, 4) - 1) <= 0.01 THEN 'same' ELSE 'different' END AS verdict FROM a FULL JOIN b ON a.k = b.k""")
def compare_sources(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_extendedprice").alias("v"))
    return audit.compare_sources(a, b, "k", "v")


@register("eval_metrics", """SELECT count(*) AS cases, count(*) FILTER (o_orderstatus <> 'P' AND o_custkey % 7 <> 0) AS scored, count(*) FILTER (o_custkey % 7 = 0) AS gaps, count(*) FILTER (o_orderstatus = 'P') AS refusals,
  round(avg(CASE WHEN o_orderstatus <> 'P' AND o_custkey % 7 <> 0 THEN CAST(o_orderstatus = 'F' AS INTEGER)::DOUBLE END), 4) AS hit_rate, round(avg(CASE WHEN o_orderstatus <> 'P' AND o_custkey % 7 <> 0 THEN (o_custkey % 10) / 10 END), 4) AS coverage, round(avg(o_orderkey % 100), 4) AS latency,
  count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 7 <> 0 AND o_orderkey % 4 = 0) AS passed FROM orders""")
def eval_metrics(spark, d):
    o = table(spark, d, "orders")
    return audit.eval_metrics(o.select((F.col("o_orderstatus") != "P").alias("answerable"), (F.col("o_custkey") % 7 == 0).alias("kb_gap"), (F.col("o_orderstatus") == "F").alias("hit"), (F.col("o_orderkey") % 4).alias("missing"), ((F.col("o_custkey") % 10) / 10).alias("coverage"), (F.col("o_orderkey") % 100).alias("latency")))


# --- queue, conversations, providers ---------------------------------------------------------------------------------

_QUEUE = """q AS (SELECT c_name AS topic, CASE WHEN c_custkey % 4 = 0 THEN 'chat' ELSE 'auto' END AS origin, CAST(c_nationkey % 5 AS INTEGER) AS priority, CAST(c_custkey % 9 AS INTEGER) AS hits, CASE WHEN c_custkey % 5 = 0 THEN '2024' ELSE '' END AS last_run, CAST(c_custkey % 6 AS INTEGER) AS retry_count, CAST(c_custkey % 100 AS DOUBLE) AS next_retry_at FROM customer)"""


def _queue(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(F.col("c_name").alias("topic"), F.when(k % 4 == 0, "chat").otherwise("auto").alias("origin"), (F.col("c_nationkey") % 5).cast("int").alias("priority"), (k % 9).cast("int").alias("hits"), F.when(k % 5 == 0, "2024").otherwise("").alias("last_run"), (k % 6).cast("int").alias("retry_count"), (k % 100).cast("double").alias("next_retry_at"))


@register("enqueue_topic", f"""WITH {_QUEUE}, n AS (SELECT c_name AS topic, min(1 + o_orderkey % 3) AS p, arg_min('o' || (o_orderkey % 2), o_orderkey) AS o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT topic, CASE WHEN n.topic IS NOT NULL AND last_run <> '' THEN n.o ELSE origin END AS origin, CAST(coalesce(least(priority, n.p), priority) AS INTEGER) AS priority, CASE WHEN n.topic IS NOT NULL THEN '' ELSE last_run END AS last_run FROM q LEFT JOIN n USING (topic)""")
def enqueue_topic(spark, d):
    new = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    new = new.select(F.col("c_name").alias("topic"), F.concat(F.lit("o"), (F.col("o_orderkey") % 2).cast("string")).alias("origin"), (1 + F.col("o_orderkey") % 3).cast("int").alias("priority"), F.col("o_orderkey").alias("seq"))
    return topics.enqueue(_queue(spark, d), new).select("topic", "origin", "priority", "last_run")


@register("dequeue_topics", f"WITH {_QUEUE} SELECT topic FROM q WHERE last_run = '' AND next_retry_at <= 50 AND origin <> 'chat' ORDER BY priority, hits DESC, topic LIMIT 20")
def dequeue_topics(spark, d):
    return topics.dequeue(_queue(spark, d), 50, 20, include_chat=False).select("topic")


@register("defer_topic", f"WITH {_QUEUE} SELECT topic, CASE WHEN hits = 3 THEN retry_count + 1 ELSE retry_count END AS retry_count, CASE WHEN hits = 3 THEN 1000 + greatest(least(3600, 300 * power(2, least(retry_count, 4))), 400) ELSE next_retry_at END AS next_retry_at FROM q")
def defer_topic(spark, d):
    q = _queue(spark, d)
    return topics.defer(q, q.filter("hits = 3"), 1000, 400).select("topic", "retry_count", "next_retry_at")


@register("mark_topic_run", f"WITH {_QUEUE} SELECT topic, CASE WHEN hits = 3 THEN 4 ELSE hits END AS hits, CASE WHEN hits = 3 THEN '2025' ELSE last_run END AS last_run, CASE WHEN hits = 3 THEN 0 ELSE retry_count END AS retry_count FROM q")
def mark_topic_run(spark, d):
    q = _queue(spark, d)
    return topics.mark_run(q, q.filter("hits = 3"), "2025").select("topic", "hits", "last_run", "retry_count")


@register("next_retry", f"WITH {_QUEUE} SELECT min(next_retry_at) AS next_retry_at FROM q WHERE last_run = '' AND retry_count > 0")
def next_retry(spark, d):
    return topics.next_retry(_queue(spark, d))


@register("topic_timers", """WITH e AS (SELECT 'user' || user_id AS topic, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'purchase' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS code FROM events),
l AS (SELECT topic, max(ms) FILTER (code = 2) AS ended FROM e GROUP BY 1), o AS (SELECT e.* FROM e JOIN l USING (topic) WHERE code < 2 AND (ended IS NULL OR ms > ended)),
g AS (SELECT topic, max(ms) AS ms, arg_max(code, (ms, code)) AS last, count(*) FILTER (code = 1) AS n FROM o GROUP BY 1),
t AS (SELECT topic, n, CAST(ms + CASE last WHEN 1 THEN least(3600, 300 * power(2, least(n - 1, 4))) * 1000 ELSE 0 END AS BIGINT) AS at_ms FROM g), w AS (SELECT max(ms) - 600000 AS mark FROM e)
SELECT topic, 'due' AS event, at_ms, CAST(n AS INTEGER) AS retry_count FROM t, w WHERE at_ms <= mark
UNION ALL SELECT topic, 'expired', at_ms + 604800000, CAST(n AS INTEGER) FROM t, w WHERE at_ms + 604800000 <= mark""")
def topic_timers(spark, d):
    """All events as a stream of a queue: errors are failures, purchases end a topic; what the last watermark has passed is due."""
    path, folder = f"{d}/events.parquet", scratch(spark, "timers")
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")  # a stream's path is a folder or a pattern
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail").otherwise("ask")
    due = queue.due_topics(events.select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("topic"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind")))
    with queue.timers(spark):
        ev.run_once(due, lambda df, _: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/stream")
    out = spark.read.schema(due.schema).parquet(f"{folder}/out")
    return out.select("topic", "event", F.unix_millis("at").alias("at_ms"), "retry_count")


@register("throttle", "SELECT event_id AS id, CAST(round(max(epoch_us(ts) / 1000000 - n * 0.5) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + n * 0.5, 6) AS DOUBLE) AS go_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) - 1 AS n FROM events)")
def throttle(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("host"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"))
    return topics.throttle(e, 0.5).select("id", "go_at")


@register("page_budget")
def page_budget(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 13).alias("wanted"))
    return topics.page_budgets(runs, 60)


@register("search_dedupe", r"""WITH k AS (SELECT page_id AS seq, url, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS q, regexp_replace(split_part(url, '#', 1), '/+$', '') AS key FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY q, key ORDER BY seq) AS r FROM k) SELECT q AS query, url, CAST(row_number() OVER (PARTITION BY q ORDER BY seq) AS INTEGER) AS rank FROM f WHERE r = 1""")
def search_dedupe(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("seq"), "url", urls.host_of(F.col("url")).alias("query"), F.lit("wiki").alias("source_type"))
    return providers.search_dedupe(p).select("query", "url", "rank")


@register("followup", """SELECT c_custkey AS conv_id, CAST(2 AS BIGINT) AS turn, CASE c_custkey % 3 WHEN 0 THEN lower(c_name) || '的生日呢' ELSE '它的生日呢' END AS question, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '你指的是' || lower(c_name) || '、other' || c_custkey || 'x中的哪一个？' ELSE '你指的是哪位角色或哪个对象？请告诉我名称。' END AS clarify FROM customer""")
def followup(spark, d):
    """A question that leans on the one before it: that names one thing, two, or none."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    other = F.concat(F.lit("other"), k.cast("string"), F.lit("x"))
    first = F.when(k % 3 == 0, F.concat(F.lit("tell of "), F.col("c_name"))).when(k % 3 == 1, F.concat(F.col("c_name"), F.lit(" or "), other)).otherwise("tell of anyone")
    turns = c.select(k.alias("conv_id"), F.explode(F.array(F.struct(F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), first.alias("text")), F.struct(F.lit(2).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("它的生日呢").alias("text")))).alias("x")).select("conv_id", "x.*")
    known = c.select(F.lower("c_name").alias("name")).union(c.select(other))
    return answers.followups(turns, known).filter("turn = 2")


@register("api_facts", "SELECT p_partkey, 'part' || p_partkey || '·brand' AS title, 'part' || p_partkey || ' 的brand为：' || p_brand AS answer FROM part WHERE length(p_brand) >= 2")
def api_facts(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("e"), F.lit("brand").alias("f"), F.col("p_brand").alias("v"))
    return wikitext.api_facts(part, "e", "f", "v", "parts").select("p_partkey", "title", "answer")


@register("ensure_tag", with_facts("SELECT id, CASE WHEN tags = 'price' THEN tags ELSE tags END || ' | new' AS a, CASE WHEN contains(tags, '并入') THEN tags ELSE tags || ' | 并入' END AS b FROM facts"))
def ensure_tag(spark, d):
    return facts(spark, d).select("id", tx.ensure_tag(tx.ensure_tag(F.col("tags"), F.lit("price")), F.lit("new")).alias("a"), tx.ensure_extra_tag(F.col("tags"), F.lit("并入")).alias("b"))


# --- events --------------------------------------------------------------------------------------------------------


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@register("tumbling_window", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, d):
    return ev.tumbling(_events(spark, d)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("sliding_window", "SELECT CAST(time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events, range(2) r(k) GROUP BY ALL")
def sliding_window(spark, d):
    return ev.sliding(_events(spark, d)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("session_window", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS session_start, CAST(max(ts) + INTERVAL 30 MINUTE AS TIMESTAMP) AS session_end, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_window(spark, d):
    out = ev.sessions(_events(spark, d))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
