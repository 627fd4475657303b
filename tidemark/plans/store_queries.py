"""Queries on the store: changes, observations, extraction and decisions, retrieval runs, topics and logs. Inputs are made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import versions as vs
from tidemark.operators import answers, audit, dedupe, ingest, lifecycle, names, retrieval, search, store, topics, update, vote
from tidemark.operators.steps import scratch
from tidemark.plans import text_queries as tq
from tidemark.plans.catalog import register
from tidemark.plans.relations import documents, facts, table, with_facts
from tidemark.plans.source_queries import _cat
from tidemark.sources import snapshot
from tidemark.streaming import events as ev
from tidemark.streaming.commits import Tables


def _part(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("*", _cat("part", k).alias("title"), (k % 10).alias("m"))


# --- documents, chunks, facts ------------------------------------------------------------------------------------


def _pieces(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(tx.hard_split(F.col("text"), 500)).alias("ord", "text"))


@register("scan_chunks", """WITH a AS (SELECT doc_id, unnest(range(0, CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i, text FROM documents WHERE source = 'src1')
SELECT doc_id, CAST(i AS INTEGER) AS ord, substring(text, CAST(i * 500 + 1 AS BIGINT), 500) AS text FROM a""")
def scan_chunks(spark, d):
    return store.chunks_of(_pieces(spark, d), documents(spark, d).filter("source = 'src1'"))


@register("replace_chunks", """WITH a AS (SELECT doc_id, unnest(range(0, CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i, text, lang FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS ord, substring(text, CAST(i * 500 + 1 AS BIGINT), 500) AS text FROM a WHERE lang <> 'fr' UNION ALL SELECT doc_id, 0, 'new' FROM documents WHERE lang = 'fr'""")
def replace_chunks(spark, d):
    fresh = documents(spark, d).filter("lang = 'fr'").select("doc_id", F.lit(0).alias("ord"), F.lit("new").alias("text"))
    return lifecycle.replace_chunks(_pieces(spark, d), fresh)


@register("delete_document", f"""WITH p AS (SELECT doc_id, unnest(list_distinct({tq.TOKENS.format(tq.squash_sql('text'))})) AS term FROM documents WHERE lang <> 'fr'), c AS (SELECT doc_id, unnest(range(0, CAST(ceil(length(text) / 500.0) AS BIGINT))) AS i FROM documents WHERE lang <> 'fr')
SELECT 'documents' AS rows_of, count(*) AS n FROM documents WHERE lang <> 'fr' UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'postings', count(*) FROM p""")
def delete_document(spark, d):
    """What is left of documents, chunks and postings after the French documents are deleted."""
    docs = documents(spark, d)
    postings = search.postings(docs, "doc_id", tx.tokenize(tx.normalize(F.col("text"))))
    left = store.delete_documents(docs, _pieces(spark, d), postings, docs.filter("lang = 'fr'"))
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rows_of"), "n")
    return one(left[0], "documents").union(one(left[1], "chunks")).union(one(left[2], "postings"))


def _stored(spark, d):
    return _part(spark, d).select(F.col("p_partkey").alias("id"), "title", F.col("p_name").alias("answer"), F.lit("active").alias("status"), F.lit(None).cast("long").alias("superseded_by"))


@register("fact_crud", r"""WITH p AS (SELECT p_partkey AS id, p_partkey % 10 AS m, 'part' || p_partkey AS title, p_name AS answer FROM part),
r AS (SELECT id, title, CASE m WHEN 1 THEN answer || ' b' WHEN 2 THEN answer ELSE answer END AS answer, CASE WHEN m = 3 THEN 'superseded' ELSE 'active' END AS status, CASE WHEN m = 3 THEN id + 1000000 END AS superseded_by FROM p WHERE m <> 4
  UNION ALL SELECT id + 1000000, title, answer || ' new', 'active', NULL FROM p WHERE m = 3)
SELECT *, CAST(len(regexp_extract_all(lower(title || ' ' || answer), '[A-Za-z][A-Za-z0-9_+#.\-]*|[0-9]+(?:\.[0-9]+)?%?')) AS INTEGER) AS n_tokens FROM r""")
def fact_crud(spark, d):
    """Of ten parts one is updated twice, one is updated with nothing, one is superseded by a new fact, one is deleted; changes of unknown ids do nothing."""
    p = _part(spark, d).withColumn("id", F.col("p_partkey"))
    row = lambda on, op, seq, id_, answer, new: p.filter(on).select(id_.alias("id"), F.lit(op).alias("op"), F.lit(seq).alias("seq"), "title", answer.alias("answer"), new.cast("long").alias("new_id"))
    none, own = F.lit(None), F.col("id")
    changes = row("m = 1", "update", 1, own, _cat(F.col("p_name"), " a"), none).union(row("m = 1", "update", 2, own, _cat(F.col("p_name"), " b"), none)).union(row("m = 2", "update", 1, own, F.lit(""), none))
    changes = changes.union(row("m = 3", "supersede", 1, own, F.lit(""), own + 1_000_000)).union(row("m = 3", "add", 1, own + 1_000_000, _cat(F.col("p_name"), " new"), none))
    changes = changes.union(row("m = 4", "delete", 1, own, F.lit(""), none)).union(row("m = 5", "update", 1, own + 5_000_000, F.lit("x"), none))
    return store.apply_changes(_stored(spark, d), changes).drop("norm")


@register("delete_by_topic", "SELECT p_partkey, (SELECT count(*) FROM part WHERE p_brand = 'Brand#13') AS deleted FROM part WHERE p_brand <> 'Brand#13'")
def delete_by_topic(spark, d):
    left, gone = store.delete_by_topic(table(spark, d, "part").withColumn("topic", F.col("p_brand")), "Brand#13")
    return left.select("p_partkey").crossJoin(F.broadcast(gone))  # one row


@register("seed_observation", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1.4' WHEN 1 THEN '1.2' ELSE '' END AS version, CASE WHEN p_partkey % 4 = 0 THEN p_name || ' 12 (1.4版本)' ELSE p_name || ' 12' END AS answer FROM part""")
def seed_observation(spark, d):
    """Observations by hand: of four, one gets its version, one has one, one's words differ, one has no mark."""
    p, k = _part(spark, d), F.col("p_partkey") % 4
    base = [F.col("p_partkey"), F.col("title"), F.lit("u").alias("source_url"), F.lit("manual").alias("source_type"), F.lit("manual").alias("extraction"), F.lit("active").alias("status")]
    own = p.select(*base, _cat(F.col("p_name"), " 12").alias("answer"), F.when(k == 3, "").otherwise(store.OBSERVED).alias("tags"), F.when(k == 1, "1.2").otherwise("").alias("version"), F.lit(0.5).alias("confidence"))
    seen = p.select(*base, F.when(k == 2, _cat(F.col("p_name"), " 13 (1.4版本)")).otherwise(_cat(F.col("p_name"), " 12 (1.4版本)")).alias("answer"), F.lit(store.OBSERVED).alias("tags"), F.lit("1.4").alias("version"), F.lit(0.9).alias("confidence"))
    return store.observe(own, seen).select("p_partkey", "version", "answer")


@register("apply_revocations", with_facts("SELECT id, CASE WHEN source_url IN (SELECT DISTINCT source_url FROM facts WHERE source_type = 'official') THEN 'revoked' ELSE status END AS status FROM facts"))
def apply_revocations(spark, d):
    f = facts(spark, d)
    return lifecycle.apply_revocations(f, f.filter("source_type = 'official'"), ["source_url"]).select("id", "status")


@register("supersede_fact", "SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'superseded' ELSE 'active' END AS status, CASE WHEN p_size > 25 THEN p_partkey + 7 END AS superseded_by FROM part")
def supersede_fact(spark, d):
    pairs = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 7).alias("new"))
    return lifecycle.supersede(_stored(spark, d).drop("superseded_by"), pairs).select("id", "status", "superseded_by")


@register("audit_apply", """SELECT p_partkey, 'base' || CASE WHEN p_size % 2 = 0 THEN ', odd title' ELSE '' END || CASE WHEN p_brand = 'Brand#13' THEN ', weak source' ELSE '' END AS tags FROM part WHERE p_partkey % 10 <> 7""")
def audit_apply(spark, d):
    p = _part(spark, d).withColumns({"source_url": F.col("p_brand"), "tags": F.when(F.col("p_size") % 4 == 0, "base, odd title").otherwise("base")})
    out = store.clean_up(p, p.filter("m = 7"), p.filter("p_size % 2 = 0").select("title", F.lit("odd title").alias("note")), p.filter("p_brand = 'Brand#13'").select("source_url", F.lit("weak source").alias("note")))
    return out.select("p_partkey", "tags")


@register("audit_misattribution", """SELECT p_partkey, 'n' || (p_partkey + 1) || 'x' AS other, CAST(2 AS INTEGER) AS n FROM part WHERE p_partkey % 3 = 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part)""")
def audit_misattribution(spark, d):
    """Texts that never name their own part but the next one twice; others name both, or the next one once."""
    k, p = F.col("p_partkey"), table(spark, d, "part")
    own, other = _cat("n", k, "x"), _cat("n", k + 1, "x")
    text = F.when(k % 3 == 0, _cat(other, " is like ", other)).when(k % 3 == 1, _cat(own, " and ", other, " ", other)).otherwise(_cat("only ", other))
    return audit.misattributed(p.select("p_partkey", own.alias("own"), text.alias("text")), p.select(own.alias("name")), "p_partkey", "own", "text")


@register("audit_crossgame", "SELECT doc_id, CASE WHEN contains(text, 'license') OR contains(text, 'License') THEN array_to_string(list_filter(['License', 'license'], lambda n: contains(text, n)), ',') ELSE '' END AS terms FROM documents")
def audit_crossgame(spark, d):
    docs = documents(spark, d).select("doc_id", "text")
    hits = names.present(docs, spark.createDataFrame([("License",), ("license",)], "name string"), "doc_id", "text")
    return docs.select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce(F.array_join("names", ","), F.lit("")).alias("terms"))


@register("no_vote", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'narrative' WHEN 1 THEN 'construction' ELSE '' END AS why FROM part""")
def no_vote(spark, d):
    """Narrative facts, and numbers from a site under construction, have no vote; numbers elsewhere and other fields there have one."""
    k = F.col("p_partkey") % 4
    tags, title = F.when(k == 0, "x | 叙事来源").otherwise("x"), F.when(k == 3, _cat(F.col("p_name"), "·描述")).otherwise(_cat(F.col("p_name"), "·攻击力"))
    return table(spark, d, "part").select("p_partkey", vote.no_vote(tags, title, F.when(k == 2, "old.example").otherwise("new.example"), ("new.example",)).alias("why"))


# --- comparison and merging --------------------------------------------------------------------------------------


@register("find_duplicate", """WITH p AS (SELECT p_partkey, unnest([0, 1, 2]) AS v FROM part) SELECT p_partkey * 3 + v AS cid, p_partkey AS id, CASE v WHEN 0 THEN 'duplicate' ELSE 'conflict' END AS action FROM p WHERE v < 2""")
def find_duplicate(spark, d):
    """Three candidates for each part's fact: the same words, another number, and another title."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    stored = p.select(k.alias("id"), _cat("part", k).alias("title"), _cat(F.col("p_name"), " costs ", k + 100).alias("answer"), F.lit(0.5).alias("confidence"), F.lit("").alias("updated_at"))
    c = p.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v"))
    asked = c.select((k * 3 + F.col("v")).alias("cid"), F.when(F.col("v") == 2, _cat("other", k)).otherwise(_cat("part", k)).alias("title"), _cat(F.when(F.col("v") == 0, F.upper("p_name")).otherwise(F.col("p_name")), " costs ", k + 100 + F.when(F.col("v") == 1, 1).otherwise(0)).alias("answer"))
    # fingerprints that are far from each other, so that other titles' facts are no neighbours
    far = lambda df, key: df.withColumn("simhash", F.xxhash64(F.col(key)))
    return dedupe.find_duplicate(far(asked, "cid"), far(stored, "id")).select("cid", "id", "action")


@register("merge_answers", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_type WHEN 2 THEN p_name ELSE 'alpha beta gamma；second ' || p_brand END AS merged FROM part""")
def merge_answers(spark, d):
    """Equal answers, a longer one, an empty one, and two of different sentences."""
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    old = F.when(k == 3, "alpha beta gamma").otherwise(n)
    new = F.when(k == 0, F.upper(n)).when(k == 1, _cat(n, " ", F.col("p_type"))).when(k == 2, "").otherwise(_cat("Alpha, beta。second ", F.col("p_brand")))
    return table(spark, d, "part").select("p_partkey", tx.merge_answers(old, new).alias("merged"))


@register("merge_into", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'price | 并入:b.example' ELSE 'price' END AS tags, CASE WHEN p_size % 2 = 0 THEN 0.9 ELSE 0.5 END AS confidence FROM part")
def merge_into(spark, d):
    rows = _stored(spark, d).withColumns({"tags": F.lit("price"), "confidence": F.lit(0.5)})
    other = table(spark, d, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("answer"), F.lit("https://b.example/x").alias("source_url"), F.lit(0.9).alias("confidence"))
    return dedupe.merge_into(rows, other).select("id", "tags", "confidence")


@register("merge_report", "SELECT p_partkey * 2 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS keeper, p_partkey * 2 + CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS superseded FROM part")
def merge_report(spark, d):
    k, p = F.col("p_partkey"), table(spark, d, "part")
    rows = p.select((k * 2).alias("id"), F.lit(0.5).alias("confidence"), F.col("p_name").alias("answer")).union(p.select(k * 2 + 1, F.when(F.col("p_size") % 2 == 0, 0.6).otherwise(0.4), F.col("p_name")))
    return dedupe.merge_report(p.select((k * 2).alias("a"), (k * 2 + 1).alias("b"), F.lit("duplicate").alias("action")), rows)


# --- extraction --------------------------------------------------------------------------------------------------


def _replies(spark, d):
    """A document's reply of five facts: three that hold, one made up, one too short; of odd ids fenced and under a name."""
    own = F.substring("text", 1, 60)
    made_up = F.md5(F.col("doc_id").cast("string").cast("binary"))  # a third of plain words may well stand in a long page
    fact = lambda title, answer, tags: F.struct(F.lit(title).alias("title"), answer.alias("answer"), F.array(*[F.lit(t) for t in tags]).alias("tags"))
    listed = F.array(fact("one", own, "abcdefgh"), fact("two", made_up, ["x"]), fact("", own, []), fact("short", F.lit("tiny"), []), fact("免责声明：x", own, []))
    reply = F.when(F.col("doc_id") % 2 == 0, F.to_json(listed)).otherwise(F.concat(F.lit("Facts:\n```json\n"), F.to_json(F.struct(listed.alias("facts"))), F.lit("\n```")))
    return documents(spark, d).select(F.col("doc_id").alias("page"), F.col("text").alias("body"), reply.alias("reply"))


@register("extract_facts", rf"""WITH a AS (SELECT doc_id, text, trim(substring(text, 1, 60)) AS answer FROM documents WHERE length(trim(text)) >= 150)
SELECT doc_id AS page, 0 AS seq, 'one' AS title, answer, 'a, b, c, d, e, f' AS tags FROM a WHERE length(answer) >= 10 AND length({tq.COMPARE.format('answer')}) >= 6""")
def extract_facts(spark, d):
    return ingest.said_facts(_replies(spark, d))


@register("extract_outcome", """WITH p AS (SELECT p_partkey, unnest(range(9)) AS v FROM part)
SELECT p_partkey, v, CASE v WHEN 0 THEN 'merged' WHEN 1 THEN 'conflict' WHEN 2 THEN 'skipped' WHEN 3 THEN 'merged' WHEN 4 THEN 'superseded' WHEN 5 THEN 'added' WHEN 6 THEN 'added' WHEN 7 THEN 'added' ELSE 'superseded' END AS outcome FROM p""")
def extract_outcome(spark, d):
    """Nine kinds of candidates: by comparison, by a model's decision, without a target, and of a narrative source."""
    cases = [("", 0, "duplicate", True, False), ("new", 0, "conflict", False, False), ("skip_lower_tier", 5, "", True, False), ("duplicate", 5, "", True, False), ("SUPERSEDE", 5, "", True, False), ("supersede", 0, "", True, False), ("", 0, "", False, False), ("duplicate", 5, "duplicate", True, True), ("supersede", 5, "duplicate", True, False)]
    rows = F.array(*[F.struct(F.lit(a).alias("decision"), F.lit(b).cast("long").alias("target_id"), F.lit(c).alias("repeat"), F.lit(s).alias("similar"), F.lit(n).alias("no_vote")) for a, b, c, s, n in cases])
    c = table(spark, d, "part").select("p_partkey", F.posexplode(rows).alias("v", "x")).select("p_partkey", F.col("v").cast("long").alias("v"), "x.*")
    return ingest.outcome(c).select("p_partkey", "v", "outcome")


@register("adjudicate", """WITH n AS (SELECT o_custkey AS run, o_orderkey AS cid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT run, cid, CASE WHEN cid % 10 <> 0 THEN CAST(i // 4 AS INTEGER) END AS batch FROM n""")
def adjudicate(spark, d):
    """Requests of four candidates; a block over the characters that a request may have is left out of it."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("cid"), F.repeat(F.lit("x"), F.when(F.col("o_orderkey") % 10 == 0, 6001).otherwise(1500).cast("int")).alias("block"))
    return ingest.blocks(rows)


@register("adjudicate_batch", "SELECT p_partkey AS batch, 1 AS index, 'duplicate' AS decision, CAST(p_size AS BIGINT) AS target_id FROM part WHERE p_partkey % 3 <> 2 UNION ALL SELECT p_partkey, 2, 'new', NULL FROM part WHERE p_partkey % 3 <> 2")
def adjudicate_batch(spark, d):
    """Replies as a list or under a name, some rows without an index, an index said twice, and some replies that say nothing."""
    k = F.col("p_partkey")
    rows = _cat('[{"index": 1, "decision": "new"}, {"index": "x"}, {"index": "1", "decision": "Duplicate", "target_id": ', F.col("p_size"), '}, {"index": 2, "decision": "NEW", "target_id": ""}]')
    reply = F.when(k % 3 == 0, rows).when(k % 3 == 1, _cat('{"decisions": ', rows, "}")).otherwise("I can't say.")
    return ingest.decisions(table(spark, d, "part").select(k.alias("batch"), reply.alias("reply"))).drop("answer")


_STORE = """WITH p AS (SELECT p_partkey AS k, unnest([0, 1, 2, 3]) AS v FROM part) SELECT k * 4 + v AS cid, CASE v WHEN 0 THEN 'merged' WHEN 1 THEN 'conflict' ELSE 'added' END AS outcome, CASE WHEN v < 2 THEN k END AS target,
  CASE v WHEN 1 THEN 't | 冲突:numbers' ELSE 't' END AS tags, CASE WHEN v > 0 THEN {0} END AS confidence FROM p WHERE v < 3"""


def _store(spark, d, extraction):
    """Four facts for each part: a repeat, one with another number, one of another title, and one without an answer."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    stored = p.select(k.alias("id"), _cat("part", k).alias("title"), _cat(F.col("p_name"), " costs ", k + 100).alias("answer"), F.lit(0.5).alias("confidence"), F.lit("").alias("updated_at"), F.xxhash64("p_partkey").alias("simhash"))
    c, v = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("v")), F.col("v")
    fresh = c.select((k * 4 + v).alias("cid"), F.when(v == 2, _cat("other", k)).otherwise(_cat("part", k)).alias("title"), F.when(v == 3, " ").otherwise(_cat(F.col("p_name"), " costs ", k + 100 + F.when(v == 1, 1).otherwise(0))).alias("answer"), F.lit("t").alias("tags"), F.lit("wiki").alias("source_type"), F.lit("u").alias("source_url"))
    # these facts are of a page whose freshness is known
    return ingest.store_facts(stored, fresh.withColumn("simhash", F.xxhash64("cid")), extraction, freshness=F.lit(0.6)).select("cid", "outcome", "target", "tags", "confidence")


@register("store_table_facts", _STORE.format("round(0.45 * 0.75 + 0.25 * 0.85 + 0.2 * 0.6 + 0.1 * 0.6, 4)::DOUBLE"))
def store_table_facts(spark, d):
    return _store(spark, d, "table")


@register("store_api_facts", _STORE.format("round(0.45 * 0.75 + 0.25 * 1.0 + 0.2 * 0.6 + 0.1 * 0.6, 4)::DOUBLE"))
def store_api_facts(spark, d):
    return _store(spark, d, "api")


@register("fact_meta", """SELECT o_orderkey, '1.' || (o_custkey % 9 + 1) AS version, strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d') AS effective_from, CASE WHEN o_orderkey % 2 = 0 THEN 'effective' ELSE 'published' END AS date_kind FROM orders""")
def fact_meta(spark, d):
    """Facts whose date stands in the answer, or in the URL alone."""
    day, k = F.col("o_orderdate") + F.expr("INTERVAL 20 YEAR"), F.col("o_orderkey")
    answer = F.when(k % 2 == 0, F.concat(F.date_format(day, "yyyy-M-d"), F.lit(" 版本上线"))).otherwise("没有日期")
    meta = vs.fact_meta(_cat("1.", F.col("o_custkey") % 9 + 1, "版本"), answer, F.concat(F.lit("https://a.example/"), F.date_format(day, "yyyyMMdd"), F.lit("_1.html")))
    return table(spark, d, "orders").select("o_orderkey", meta.alias("m")).select("o_orderkey", "m.*")


@register("roll_forward", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 20 YEAR AS DATE) AS base, CAST(o_orderkey % 12 + 1 AS INTEGER) AS m, CAST(o_orderkey % 28 + 1 AS INTEGER) AS a FROM orders),
x AS (SELECT *, make_date(year(base), m, a) AS same, make_date(year(base) + 1, m, a) AS next FROM o)
SELECT o_orderkey, CASE WHEN same - base BETWEEN -45 AND 400 THEN CAST(same AS VARCHAR) WHEN next - base BETWEEN 1 AND 60 THEN CAST(next AS VARCHAR) ELSE '' END AS rolled FROM x""")
def roll_forward(spark, d):
    base = F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 20 YEAR"), "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", vs.roll_forward(base, (F.col("o_orderkey") % 12 + 1).cast("int"), (F.col("o_orderkey") % 28 + 1).cast("int")).alias("rolled"))


@register("month_days", "SELECT o_orderkey, CAST(o_orderkey % 12 + 1 AS INTEGER) AS month, CAST(o_orderkey % 28 + 1 AS INTEGER) AS day, CAST(2 AS INTEGER) AS at FROM orders")
def month_days(spark, d):
    k = F.col("o_orderkey")
    found = vs.month_days(_cat("于 ", k % 12 + 1, "月", k % 28 + 1, "日，13月40日，第2月"))
    return table(spark, d, "orders").select("o_orderkey", F.explode(found).alias("x")).select("o_orderkey", "x.month", "x.day", "x.at")


# --- retrieval ---------------------------------------------------------------------------------------------------


@register("fts_phrase", r"""WITH d AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), '  ') || ' ' AS w FROM documents), q AS (SELECT unnest(['the MIT license', 'version 2.0', 'version-3']) AS phrase, unnest([' the  mit  license ', ' version  2  0 ', ' version  3 ']) AS p)
SELECT doc_id, phrase, CAST((length(w) - length(replace(w, p, ''))) // length(p) AS BIGINT) AS n FROM d, q WHERE contains(w, p)""")
def fts_phrase(spark, d):
    return retrieval.phrase_hits(documents(spark, d), spark.createDataFrame([("the MIT license",), ("version 2.0",), ("version-3",)], "phrase string"))


@register("retrieve")
def retrieve(spark, d):
    """Facts and chunks of each benchmark item and of questions on parts' prices."""
    asked = tq._questions(spark, d)
    return retrieval.retrieve(tq.asked_facts(spark, d), tq._chunks(spark, d), asked, floor=0.05, fact_index=tq.fact_index(spark, d), chunk_index=tq.chunk_index(spark, d))


@register("like_fallback", "SELECT 'q' || p_partkey AS question_id, p_partkey AS chunk_id, 0.0 AS bm FROM part WHERE p_partkey % 20 = 0")
def like_fallback(spark, d):
    """Questions that share no whole word with a chunk, but a part of one."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    chunks = p.select(k.alias("chunk_id"), _cat("zq", F.md5(_cat(k).cast("binary")), " rest").alias("text_norm"), F.lit("").alias("title_norm"), F.lit("wiki").alias("source_type")).withColumn("tokens", F.split("text_norm", " "))
    asked = p.filter("p_partkey % 20 = 0").select(_cat("q", k).alias("question_id"), F.array(F.substring(F.md5(_cat(k).cast("binary")), 3, 12)).alias("tokens"))
    return search.search_chunks(chunks, asked, 5).select("question_id", "chunk_id", "bm")


@register("cited", "SELECT c_custkey AS answer_id, CAST(i AS INTEGER) AS index FROM customer, range(1, 6) r(i) WHERE i = c_custkey % 5 + 1 OR i = 3")
def cited(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    told = c.select(k.alias("answer_id"), _cat("So it is [", k % 5 + 1, "], as [3] says, not [77] or [x].").alias("text"))
    marks = c.select(k.alias("answer_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("index"))
    return search.cited(told, marks)


@register("paused_expectations", """SELECT c_custkey AS case_id, CASE WHEN c_custkey % 3 = 0 THEN 'https://off.example/r' ELSE 'https://off.example/a,https://off.example/b' END AS sources FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 3 = 1""")
def paused_expectations(spark, d):
    cases, paused = _cases(spark, d)
    return retrieval.paused_expectations(cases, paused).select("case_id", F.array_join("paused_sources", ",").alias("sources"))


def _cases(spark, d):
    """Cases that require a paused source, that expect paused ones only, or that expect one that isn't."""
    k = F.col("c_custkey")
    off, on = [F.lit(f"https://off.example/{x}") for x in "abr"], F.lit("https://on.example/a")
    expected = F.when(k % 3 == 1, F.array(*off[:2])).otherwise(F.array(off[0], on))
    required = F.when(k % 3 == 0, F.array(off[2])).when(k % 6 == 2, F.array(on)).otherwise(F.array().cast("array<string>"))
    cases = table(spark, d, "customer").select(k.alias("case_id"), expected.alias("expected"), required.alias("required"))
    return cases, spark.createDataFrame([(f"https://off.example/{x}",) for x in "abr"], "url string")


@register("run_retrieval", """SELECT c_custkey AS case_id, c_custkey % 3 < 2 AS deferred, CASE WHEN c_custkey % 3 = 0 THEN false WHEN c_custkey % 6 = 2 THEN c_custkey % 4 = 0 ELSE c_custkey % 4 < 2 END AS passed,
  CASE WHEN c_custkey % 3 = 0 THEN 'https://off.example/r' WHEN c_custkey % 6 = 2 AND c_custkey % 4 <> 0 THEN 'https://on.example/a' ELSE '' END AS missing FROM customer""")
def run_retrieval(spark, d):
    """Evidence by the case's number: both sources, one that is expected, one that isn't, or none."""
    cases, paused = _cases(spark, d)
    k = F.col("c_custkey")
    urls = F.when(k % 4 == 0, F.array(F.lit("https://on.example/a"), F.lit("https://off.example/a"))).when(k % 4 == 1, F.array(F.lit("https://off.example/a"))).when(k % 4 == 2, F.array(F.lit("https://else.example/"))).otherwise(F.array().cast("array<string>"))
    return retrieval.run_retrieval(cases, table(spark, d, "customer").select(k.alias("case_id"), F.explode(urls).alias("url")), paused)


@register("retrieval_warnings", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'timeout|本次证据未覆盖甲、乙的所问字段。' ELSE 'timeout' END AS warnings FROM customer")
def retrieval_warnings(spark, d):
    k = F.col("c_custkey") % 3
    none = F.array().cast("array<string>")
    return table(spark, d, "customer").select("c_custkey", F.array_join(retrieval.warnings(F.when(k > 0, F.array(F.lit("timeout"))), F.when(k == 1, F.array(F.lit("甲"), F.lit("乙"))).otherwise(none)), "|").alias("warnings"))


@register("system_prompt", "SELECT true AS cite, 'Rules: cite. Name [2].' AS prompt UNION ALL SELECT false, 'Rules: plain. Name it.'")
def system_prompt(spark, d):
    make = lambda cite: retrieval.system_prompt("Rules: {cite_rule}. Name [2].", "cite", "plain", {"Name [2].": "Name it."}, cite)
    return spark.createDataFrame([(True, make(True)), (False, make(False))], "cite boolean, prompt string")


@register("provider_retry_wait", "SELECT o_orderkey, o_orderkey % 8 AS attempt, least(60.0, greatest(1.5 * power(2, o_orderkey % 8), CAST(o_custkey % 40 AS DOUBLE))) AS least_wait, true AS within FROM orders")
def provider_retry_wait(spark, d):
    attempt, after = F.col("o_orderkey") % 8, (F.col("o_custkey") % 40).cast("double")
    least = F.least(F.lit(60.0), F.greatest(F.lit(1.5) * F.pow(F.lit(2), attempt), after))
    wait = retrieval.retry_wait(attempt, after, F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", attempt.alias("attempt"), least.alias("least_wait"), ((wait >= least) & (wait <= least + 0.5)).alias("within"))


class _Lengths:
    """An embedder without a model: a text's length and how many of its characters are letters of the alphabet's first half."""

    def embed(self, texts):
        return [[float(len(t)), float(sum("a" <= c <= "m" for c in t))] for t in texts]


@register("embed", "SELECT doc_id, [CAST(length(text) AS DOUBLE), CAST(length(regexp_replace(text, '[^a-m]', '', 'g')) AS DOUBLE)] AS embedding FROM documents")
def embed(spark, d):
    return retrieval.embed(documents(spark, d), _Lengths(), "doc_id", "text")


# --- topics, logs and runs ---------------------------------------------------------------------------------------


def _topics(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(F.col("c_name").alias("topic"), (k % 5).alias("priority"))


@register("list_topics", "SELECT c_name AS topic, c_custkey % 5 AS priority FROM customer ORDER BY 2, 1 LIMIT 50")
def list_topics(spark, d):
    return store.list_topics(_topics(spark, d), 50)


@register("remove_topic", "SELECT c_name AS topic, c_custkey % 5 AS priority FROM customer WHERE c_custkey % 7 <> 0")
def remove_topic(spark, d):
    return store.remove_topics(_topics(spark, d), table(spark, d, "customer").filter("c_custkey % 7 = 0").select(_cat(" ", F.col("c_name"), " ").alias("topic")))


def _logs(spark, d):
    o = table(spark, d, "orders")
    started = o.select(F.col("o_orderkey").alias("log_id"), F.col("o_orderdate").alias("started_at"))
    end = lambda days, status: o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("log_id"), (F.col("o_orderdate") + F.expr(f"INTERVAL {days} DAY")).alias("at"), F.lit(status).alias("status"), F.col("o_orderpriority").alias("message"), F.lit(days).alias("pages"), (F.col("o_orderkey") % 9).cast("int").alias("facts"))
    return store.finish_logs(started, end(1, "partial").union(end(2, "ok").filter("log_id % 2 = 0")))


_LOGS = """l AS (SELECT o_orderkey AS log_id, o_orderdate AS started_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 2 DAY ELSE INTERVAL 1 DAY END END AS finished_at, CASE WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderkey % 2 = 0 THEN 'ok' ELSE 'partial' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS message, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS pages, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(o_orderkey % 9 AS INTEGER) END AS facts FROM orders)"""


@register("update_logs", f"WITH {_LOGS} SELECT * FROM l")
def update_logs(spark, d):
    return _logs(spark, d)


@register("list_logs", f"WITH {_LOGS} SELECT log_id, status FROM l ORDER BY started_at DESC, log_id DESC LIMIT 30")
def list_logs(spark, d):
    return store.list_logs(_logs(spark, d), 30).select("log_id", "status")


@register("run_loop", """SELECT o_custkey AS run, count(*) AS topics, CAST(sum(o_orderkey % 5) AS BIGINT) AS fetched, CAST(sum(CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed, count(*) FILTER (o_orderkey % 101 = 0) AS errors, count(*) FILTER (o_orderkey % 103 = 0) AS retries,
  CASE WHEN bool_or(o_orderkey % 499 = 0) THEN 'failed' WHEN bool_or(o_orderkey % 97 = 0 OR o_orderkey % 101 = 0 OR o_orderkey % 103 = 0) THEN 'partial' ELSE 'ok' END AS status, coalesce(string_agg(DISTINCT 'e' || (o_orderkey % 2), '；' ORDER BY 'e' || (o_orderkey % 2)) FILTER (o_orderkey % 101 = 0), '') AS message FROM orders GROUP BY 1""")
def run_loop(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), (k % 5).alias("fetched"), F.when(k % 97 == 0, 1).otherwise(0).alias("failed"), F.when(k % 101 == 0, _cat("e", k % 2)).otherwise("").alias("error"), (k % 103 == 0).alias("retry"), (k % 499 == 0).alias("broke"))
    return ingest.run_status(rows)


@register("should_run", "SELECT o_orderkey, o_custkey % 7 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 5 = 1 OR o_orderkey % 48 >= 24) AS due FROM orders")
def should_run(spark, d):
    k, now = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    last = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "not a time").otherwise(F.date_format(now - F.make_dt_interval(hours=(k % 48).cast("int")), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return table(spark, d, "orders").select("o_orderkey", ingest.should_run(last, now, 24, F.col("o_custkey") % 7 == 0).alias("due"))


@register("scheduler", "SELECT event_id, 20.0 + event_id % 12 * 300 AS tick FROM events")
def scheduler(spark, d):
    return table(spark, d, "events").select("event_id", ingest.next_tick(F.lit(0.0), F.col("event_id") % 12).alias("tick"))


@register("collect_topics", """WITH c AS (SELECT s_suppkey AS seq, 'T' || s_suppkey AS topic FROM supplier), q AS (SELECT s_suppkey AS seq, 'T' || s_suppkey AS topic FROM supplier WHERE s_suppkey % 3 = 0),
a AS (SELECT topic, row_number() OVER (ORDER BY CASE WHEN seq > 4 THEN 0 ELSE 1 END, seq) AS turn FROM c WHERE topic NOT IN (SELECT topic FROM q)), b AS (SELECT topic, row_number() OVER (ORDER BY seq) AS turn FROM q)
SELECT topic, lane, CAST(turn AS INTEGER) AS turn FROM (SELECT topic, 'configured' AS lane, turn, 1 AS late FROM a UNION ALL SELECT topic, 'queued', turn, 0 FROM b) ORDER BY turn, late LIMIT 6""")
def collect_topics(spark, d):
    """Configured topics from the one after T4 on, in turn with queued ones, which begin."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), _cat("T", F.col("s_suppkey")).alias("topic"))
    return ingest.collect_topics(s, s.filter("seq % 3 = 0"), "T4", "configured", 6)


@register("topic_lanes", "SELECT topic, lane, turn FROM (SELECT 'c' || s_suppkey AS topic, 0 AS lane, (s_suppkey - 3 + (SELECT count(*) FROM supplier)) % (SELECT count(*) FROM supplier) AS turn FROM supplier UNION ALL SELECT 'q' || n_nationkey, 1, (n_nationkey - 3 + 25) % 25 FROM nation) ORDER BY turn, lane, topic LIMIT 12")
def topic_lanes(spark, d):
    rows = table(spark, d, "supplier").select(F.lit(0).alias("lane"), F.col("s_suppkey").cast("long").alias("seq"), _cat("c", F.col("s_suppkey")).alias("topic"))
    rows = rows.union(table(spark, d, "nation").select(F.lit(1), F.col("n_nationkey").cast("long"), _cat("q", F.col("n_nationkey"))))
    return topics.interleave(rows, 3, 12)


@register("normalize_entity", "SELECT p_partkey, lower(replace(p_name, ' ', '')) AS entity FROM part")
def normalize_entity(spark, d):
    return table(spark, d, "part").select("p_partkey", store.normalize_entity(_cat(" 「", F.col("p_name"), "」（", "） ")).alias("entity"))


@register("ask_label", "SELECT p_partkey, CASE WHEN length(p_name || ' ' || p_type) <= 20 THEN p_name || ' ' || p_type ELSE substring(p_name || ' ' || p_type, 1, 20) || '…' END AS label FROM part")
def ask_label(spark, d):
    return table(spark, d, "part").select("p_partkey", store.ask_label(_cat(F.col("p_name"), " ", F.col("p_type"), "？（注）")).alias("label"))


@register("answer", """SELECT c_custkey, c_custkey % 2 = 0 AS offline FROM customer""")
def answer(spark, d):
    """Questions with evidence are answered from it without a model; the others say that nothing is known."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    items = c.filter("c_custkey % 2 = 0").select(k.alias("q"), F.lit(1).alias("index"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("text"))
    told = answers.offline_answer(items, "q")
    return c.join(told, k == F.col("q"), "left").select("c_custkey", F.col("answer").isNotNull().alias("offline"))


# --- snapshots and streams ---------------------------------------------------------------------------------------


@register("export_sink", with_facts("SELECT id, title, answer, confidence FROM facts"))
def export_sink(spark, d):
    """Facts as JSON lines, read again."""
    path = scratch(spark, "export")
    snapshot.export(facts(spark, d).select("id", "title", "answer", "confidence"), path)
    return spark.read.schema("id long, title string, answer string, confidence double").json(path)


@register("seed_source", "SELECT CAST(n_nationkey AS INTEGER) AS seq, n_name AS title, 'region ' || n_regionkey AS answer, 0.9 AS confidence FROM nation")
def seed_source(spark, d):
    """A snapshot of the nations as one JSON document, and its facts in their order."""
    fact = F.struct(F.col("n_name").alias("title"), _cat("region ", F.col("n_regionkey")).alias("answer"), F.lit(0.9).alias("confidence"))
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", fact.alias("f"))))  # 25 nations at any scale
    path = scratch(spark, "seed")
    table(spark, d, "nation").agg(F.transform(rows, lambda x: x["f"]).alias("facts")).select(F.lit(1).cast("long").alias("version"), "facts").coalesce(1).write.json(path)
    return snapshot.read_snapshot(spark, path)[2].select("seq", "title", "answer", "confidence")


@register("seed_sink", "SELECT (SELECT count(*) FROM part) AS n_old, (SELECT count(*) FROM part WHERE p_size > 4) AS n_new, (SELECT count(*) FROM part WHERE p_size > 4) < 0.9 * (SELECT count(*) FROM part) AS refused")
def seed_sink(spark, d):
    """The guard of a snapshot that lost rows."""
    return snapshot.shrinks(table(spark, d, "part"), table(spark, d, "part").filter("p_size > 4"))


@register("ingest_sources", "SELECT doc_id FROM documents WHERE lang <> 'fr'")
def ingest_sources(spark, d):
    """All documents as a stream, of which those that are known by URL and content are not stored again."""
    path = f"{d}/documents.parquet"
    own = lambda df: df.select("doc_id", "lang", _cat("https://a.example/", F.col("doc_id")).alias("url"), F.md5(F.col("text").cast("binary")).alias("content_hash"))
    stored = spark.read.parquet(path)
    out = scratch(spark, "ingested")
    stream = own(spark.readStream.schema(stored.schema).parquet(f"{d}/documents.parque[t]"))  # a stream's path is a folder or a pattern
    ev.ingest(stream, lambda: own(stored).filter("lang = 'fr'"), lambda df: df.write.mode("append").parquet(out), scratch(spark, "stream"))
    return spark.read.parquet(out).select("doc_id")


@register("update_topic", rf"""WITH p AS (SELECT *, text || chr(10) || chr(10) || '| name | size | kind |' || chr(10) || '|---|---|---|' || chr(10) || '| d' || doc_id || ' | ' || length(text) || ' | text |' AS page FROM documents),
a AS (SELECT *, list_filter(string_split(page, chr(10)), lambda x: NOT regexp_matches(trim(x), '^\s*[\-—=*·.]{{3,}}\s*$|^\s*[0-9]+\s*/\s*[0-9]+\s*$')) AS kept FROM p),
b AS (SELECT *, trim(regexp_replace(array_to_string(kept, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM a),
c AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS l, length(regexp_replace(t, '[\s　，。、；：！？…—－·（）()\[\]【】《》<>"''`,.;:!?\-_/\\|~@#$%^&*+=]+', '', 'g')) / greatest(length(t), 1) AS dens FROM b),
j AS (SELECT source, lang, length(page) < 200 AS short, length(t) < 150 OR (coalesce(len(list_filter(l, lambda x: regexp_matches(x, '^\s*\|.*\|\s*$'))) / nullif(len(l), 0), 0) < 0.25 AND dens < 0.35) AS bad FROM c)
SELECT source AS topic, count(*) FILTER (NOT short) AS fetched, count(*) FILTER (short) AS failed, count(*) FILTER (NOT short AND bad) AS filtered, count(*) FILTER (NOT short AND NOT bad AND lang <> 'fr') AS pages,
  count(*) FILTER (NOT short AND NOT bad AND lang = 'fr') AS skipped, count(*) FILTER (NOT short AND NOT bad AND lang <> 'fr') AS facts_added FROM j GROUP BY 1""")
def update_topic(spark, d):
    """All documents as a stream of fetched pages, each with a table, over tables that have the French ones: a run's figures, of a stream that came twice."""
    folder = scratch(spark, "topics")
    kept = Tables(spark, f"{folder}/tables", update.SCHEMAS, update.KEYS)
    row = F.concat(F.col("text"), F.lit("\n\n| name | size | kind |\n|---|---|---|\n| d"), F.col("doc_id").cast("string"), F.lit(" | "), F.length("text").cast("string"), F.lit(" | text |"))
    pages = lambda df: df.select(F.col("source").alias("topic"), _cat("https://a.example/", F.col("doc_id")).alias("url"), F.lit("pages").alias("title"), row.alias("text"), F.lit("").alias("published"), F.col("doc_id").alias("seq"), "lang")
    change = lambda df, n: (update.changes({t: kept.read(t) for t in update.SCHEMAS}, df, n + 1), {})
    stored = spark.read.parquet(f"{d}/documents.parquet")
    kept.commit("first", 0, change(pages(stored).filter("lang = 'fr'"), -1)[0])
    for attempt in ("one", "two"):  # the second has lost its checkpoint: its batches are known
        stream = spark.readStream.schema(stored.schema).parquet(f"{d}/documents.parque[t]")
        kept.stream(pages(stream), "update", f"{folder}/{attempt}", change)
    return kept.read("runs").filter("run > 0").select("topic", "fetched", "failed", "filtered", "pages", "skipped", "facts_added")
