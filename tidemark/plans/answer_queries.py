"""Queries from evidence to answers, and on evaluation sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.operators import answers, audit, retrieval, search
from tidemark.operators.steps import settle
from tidemark.plans import text_queries as tq
from tidemark.plans.catalog import register
from tidemark.plans.relations import documents, facts, table, with_facts
from tidemark.sources import curation


def _evidence(spark, d):
    found = tq.build_evidence(spark, d).join(documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    empty = F.lit("")
    return found.select("question_id", "index", "text", F.col("source").alias("title"), F.lit("wiki").alias("source_type"), empty.alias("version"), empty.alias("effective_from"), empty.alias("date_kind"), empty.alias("updated_at"), empty.alias("tags"), empty.alias("url"), F.lit("active").alias("status"))


_EV = f"""{tq.SEARCH_CHUNKS}, b AS (SELECT question_id, best.doc_id, rank, trim(docs.t, ' ') AS t FROM best JOIN docs ON docs.doc_id = best.doc_id WHERE rank <= 10 AND relevance >= 0.05 AND length(trim(docs.t, ' ')) > 0),
c AS (SELECT *, 12000 - coalesce(sum(length(t)) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM b),
ev AS (SELECT question_id, source AS title, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS idx, substring(c.t, 1, CAST(room AS BIGINT)) AS text FROM c JOIN docs ON docs.doc_id = c.doc_id WHERE room > 200)"""


@register("render_context", f"WITH {_EV} SELECT question_id, string_agg('[' || idx || '] ' || title || '｜Wiki' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY idx) AS context FROM ev GROUP BY 1")
def render_context(spark, d):
    return answers.render_context(_evidence(spark, d), "question_id")


@register("offline_answer", f"""WITH {_EV}, s AS (SELECT *, trim(regexp_replace(text, '[ \\t\\n\\f\\r\\v]+', ' ', 'g'), ' ') AS u FROM ev WHERE idx <= 5)
SELECT question_id, string_agg('**[' || idx || '] ' || title || '**' || chr(10) || CASE WHEN length(u) <= 400 THEN u ELSE substring(u, 1, 399) || '…' END, chr(10) || chr(10) ORDER BY idx) AS answer FROM s GROUP BY 1""")
def offline_answer(spark, d):
    return answers.offline_answer(_evidence(spark, d), "question_id")


@register("citation", f"""WITH {_EV}, s AS (SELECT *, trim(regexp_replace(text, '[ \\t\\n\\f\\r\\v]+', ' ', 'g'), ' ') AS u FROM ev)
SELECT question_id, CAST(idx AS INTEGER) AS index, title, CASE WHEN length(u) <= 180 THEN u ELSE substring(u, 1, 179) || '…' END AS preview FROM s""")
def citation(spark, d):
    return answers.citation(_evidence(spark, d)).select("question_id", "index", "title", "preview")


@register("diagnostics", f"WITH {tq.SEARCH_CHUNKS} SELECT question_id, count(*) FILTER (relevance >= 0.3) AS kept, CAST(max(relevance) AS DOUBLE) AS best_score, count(*) FILTER (relevance < 0.3) AS dropped FROM best WHERE rank <= 10 GROUP BY 1")
def diagnostics(spark, d):
    return answers.diagnostics(tq.search_chunks(spark, d), "question_id", 0.3)


@register("web_trigger", f"WITH {tq.SEARCH_CHUNKS}, m AS (SELECT question_id, max(relevance) AS b FROM best WHERE rank <= 10 GROUP BY 1) SELECT q.question_id, coalesce(b, 0) < 0.35 AS needs_web FROM q LEFT JOIN m USING (question_id)")
def web_trigger(spark, d):
    """By the best of facts and chunks, or for questions that compare by what their evidence lacks.

    A chunk that is good enough settles a question that compares nothing, so facts are searched for the others alone.
    """
    asked, questions = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text"), tq._questions(spark, d)
    hits = settle(retrieval.found_chunks(tq._chunks(spark, d), questions, 10, index=tq.chunk_index(spark, d)), "web-chunks")
    good = hits.groupBy("question_id").agg(F.round(F.max("relevance"), 4).alias("best")).filter(F.col("best") >= answers.WEB_SCORE)
    plain = asked.filter(answers.comparison_scope(F.col("text")).isNull())
    open_ = settle(questions.join(plain.join(good, "question_id").select("question_id"), "question_id", "left_anti"), "web-open")
    if not open_.isEmpty():
        hits = settle(hits.unionByName(retrieval.found_facts(tq.asked_facts(spark, d), open_, 10, index=tq.fact_index(spark, d))), "web-hits")
    hits = search.relevance_floor(hits, 0.05)

    def items(found):
        stated = facts(spark, d).select(F.lit("fact").alias("kind"), F.col("id").alias("key"), "title", F.col("answer").alias("text"))
        texts = documents(spark, d).select(F.lit("chunk").alias("kind"), F.col("doc_id").alias("key"), F.lit("").alias("title"), "text")
        return found.join(stated.unionByName(texts), ["kind", "key"])

    return answers.web_needs(asked, hits, items, "question_id").select("question_id", "needs_web")


@register("remember_gap", "SELECT substring(trim(text, ' '), 1, 60) AS topic, item_id AS seq FROM benchmark WHERE item_id % 3 = 0 AND length(trim(text, ' ')) >= 4")
def remember_gap(spark, d):
    asked = table(spark, d, "benchmark").withColumn("best", F.when(F.col("item_id") % 3 == 0, 0.1).otherwise(0.9))
    return answers.remember_gaps(asked, "item_id", "text", "best").select("topic", "seq")


@register("starter_asks", with_facts("SELECT DISTINCT '「' || title || '」是什么？' AS ask FROM facts WHERE length(title) <= 20 ORDER BY md5('7:' || '「' || title || '」是什么？'), ask LIMIT 5"))
def starter_asks(spark, d):
    return answers.starter_asks(facts(spark, d), 7, 5)


@register("latest_version", "SELECT '1.' || max(p_size) AS version FROM part")
def latest_version(spark, d):
    titles = table(spark, d, "part").select(F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit("版本更新")).alias("title"))
    return answers.latest_version(titles)


@register("followup_rewrite", r"""WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 2 AND role = 'user' THEN '它的生日呢' ELSE text END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
names AS (SELECT DISTINCT lower(regexp_extract(text, '^([\p{L}\p{N}_]+ [\p{L}\p{N}_]+)', 1)) AS name FROM t WHERE role = 'user' AND conv_id % 3 > 0), u AS (SELECT conv_id, turn, n, text, lower(text) AS low FROM t WHERE role = 'user'),
m AS (SELECT conv_id, turn, list(struct_pack(at := strpos(low, name), len := -length(name), name := name) ORDER BY strpos(low, name), -length(name), name) AS hits FROM u JOIN names ON length(name) >= 2 AND contains(low, name) GROUP BY conv_id, turn),
f AS (SELECT conv_id, turn, list_reduce(list_transform(hits, lambda h: struct_pack(e := h.at - h.len, at := h.at, names := [h.name])), lambda s, h: CASE WHEN h.at >= s.e THEN struct_pack(e := h.e, at := h.at, names := s.names || h.names) ELSE s END).names AS names FROM m),
a AS (SELECT u.*, f.names, u.text = '它的生日呢' AS leans FROM u LEFT JOIN f USING (conv_id, turn)),
d AS (SELECT q.conv_id, q.turn, arg_max(coalesce(a.names, []), a.n) AS before FROM a q JOIN a ON a.conv_id = q.conv_id AND a.n BETWEEN q.n - 6 AND q.n - 1 AND (a.names IS NOT NULL OR NOT a.leans) GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN leans AND coalesce(len(before), 0) = 1 THEN before[1] || '的生日呢' ELSE text END AS question,
  CASE WHEN NOT leans OR len(before) = 1 THEN '' WHEN len(before) > 1 THEN '你指的是' || array_to_string(before, '、') || '中的哪一个？' ELSE '你指的是哪位角色或哪个对象？请告诉我名称。' END AS clarify FROM a LEFT JOIN d USING (conv_id, turn)""")
def followup_rewrite(spark, d):
    """Every other question leans on what was said before; names are the first two words of most conversations' questions."""
    leaning = (F.col("turn") % 4 == 2) & (F.col("role") == "user")
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(leaning, "它的生日呢").otherwise(F.col("text")).alias("text"))
    names = turns.filter("role = 'user' AND conv_id % 3 > 0").select(F.lower(F.regexp_extract("text", r"^([\p{L}\p{N}_]+ [\p{L}\p{N}_]+)", 1)).alias("name")).distinct()
    return answers.followups(turns, names)


@register("comparison_scope", "SELECT p_partkey, 'part' || p_partkey || ',' || p_brand AS subjects, CAST(8 AS INTEGER) AS field FROM part")
def comparison_scope(spark, d):
    part = table(spark, d, "part")
    asked = F.concat(F.lit("比较part"), F.col("p_partkey").cast("string"), F.lit("和"), F.col("p_brand"), F.lit("的攻击力"))
    out = part.select("p_partkey", answers.comparison_scope(asked).alias("s"))
    return out.select("p_partkey", F.array_join("s.subjects", ",").alias("subjects"), "s.field")


@register("missing_subjects", "SELECT p_partkey, p_brand || 'x' AS missing FROM part WHERE p_size BETWEEN 11 AND 25")
def missing_subjects(spark, d):
    part = table(spark, d, "part")
    scopes = part.select("p_partkey", F.lit(8).alias("field"), F.array(F.col("p_brand"), F.concat(F.col("p_brand"), F.lit("x"))).alias("subjects"))
    # a fact about the brand by its title, or a line of a text; in small parts both, and the text is about the longer name
    size = F.col("p_size")
    fact = part.filter((size <= 25)).select("p_partkey", F.lit("fact").alias("kind"), F.concat("p_brand", F.lit("·攻击力")).alias("title"), size.cast("string").alias("text"))
    line = part.filter((size > 25) | (size <= 10)).select("p_partkey", F.lit("chunk").alias("kind"), F.concat("p_brand", F.lit("·攻击力")).alias("title"), F.concat(F.col("p_brand"), F.lit("X的攻击力为"), size.cast("string"), F.lit("。")).alias("text"))
    told = fact.unionByName(line)
    return answers.missing_subjects(scopes, told, "p_partkey").select("p_partkey", F.array_join("missing", ",").alias("missing"))


@register("source_hit", f"WITH {tq.SEARCH_CHUNKS} SELECT question_id, bool_or(source = 'src' || (question_id % 20)) AS hit, count(*) FILTER (source = 'src' || (question_id % 20)) = 0 AS missing FROM best JOIN docs USING (doc_id) WHERE rank <= 10 GROUP BY 1")
def source_hit(spark, d):
    hits = tq.search_chunks(spark, d).join(documents(spark, d).select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    seen = hits.groupBy("question_id").agg(F.collect_set("source").alias("actual")).withColumn("want", F.array(F.concat(F.lit("src"), (F.col("question_id") % 20).cast("string"))))
    return seen.select("question_id", audit.source_hit(F.col("want"), F.col("actual")).alias("hit"), (F.size(audit.missing_sources(F.col("want"), F.col("actual"))) > 0).alias("missing"))


@register("split_scored", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'refusal' WHEN o_custkey % 7 = 0 THEN 'gap' ELSE 'scored' END AS part, count(*) AS n FROM orders GROUP BY 1")
def split_scored(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderstatus") != "P").alias("answerable"), (F.col("o_custkey") % 7 == 0).alias("kb_gap"))
    return o.groupBy(F.when(~F.col("answerable"), "refusal").when(F.col("kb_gap"), "gap").otherwise("scored").alias("part")).agg(F.count("*").alias("n"))


@register("seed_inspect", with_facts("SELECT CASE WHEN confidence >= 0.9 THEN '0.9' WHEN confidence >= 0.7 THEN '0.7' WHEN confidence >= 0.5 THEN '0.5' ELSE '0' END AS band, extraction, count(*) AS n, count(*) FILTER (version <> '') AS versioned FROM facts GROUP BY ALL"))
def seed_inspect(spark, d):
    band = F.when(F.col("confidence") >= 0.9, "0.9").when(F.col("confidence") >= 0.7, "0.7").when(F.col("confidence") >= 0.5, "0.5").otherwise("0")
    return facts(spark, d).groupBy(band.alias("band"), "extraction").agg(F.count("*").alias("n"), F.count_if(F.col("version") != "").alias("versioned"))


@register("eval_item_gen", with_facts("SELECT p_partkey, 'part' || p_partkey || '的brand是什么？' AS question, p_brand AS expected FROM part WHERE 'part' || p_partkey || '·price' NOT IN (SELECT title FROM facts WHERE id % 10 = 3)"))
def eval_item_gen(spark, d):
    """Questions on parts that the base has no entry for."""
    part = table(spark, d, "part").withColumn("e", F.concat(F.lit("part"), F.col("p_partkey").cast("string")))
    known = facts(spark, d).filter("id % 10 = 3").select(F.substring_index("title", "·", 1).alias("e"))
    return part.join(known, "e", "left_anti").select("p_partkey", F.concat("e", F.lit("的brand是什么？")).alias("question"), F.col("p_brand").alias("expected"))


@register("paused_source", with_facts("SELECT count(*) AS n FROM facts WHERE contains(source_url, 's2.example.com/p/') OR contains(tags, '并入:m1.example.org')"))
def paused_source(spark, d):
    f = facts(spark, d)
    hit = curation.paused(F.col("source_url"), F.col("tags"), "www.s2.example.com", "/p") | curation.paused(F.lit(""), F.col("tags"), "m1.example.org", "/p")
    return f.filter(hit).agg(F.count("*").alias("n"))


@register("revoked_reason", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'r' ELSE '' END AS reason FROM (SELECT page_id, min(page_id % 5) OVER (PARTITION BY regexp_replace(lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '')) AS m FROM pages) WHERE m = page_id % 5")
def revoked_reason(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    key = urls.canonical_url(F.col("url"))
    least = pages.groupBy(key.alias("k")).agg(F.min(F.col("page_id") % 5).alias("m"))
    registry = pages.filter("page_id % 5 = 0").select(key.alias("url"), F.lit("r").alias("reason"))
    out = curation.revoked_reason(pages.withColumn("k", key), registry).join(least, "k").filter(F.col("m") == F.col("page_id") % 5)
    return out.select("page_id", F.col("revoked_reason").alias("reason"))


@register("report_dup_pairs", with_facts("""m AS (SELECT title, answer, min(id) AS id FROM facts GROUP BY ALL) SELECT x.id AS a, y.id AS b, x.title FROM m x JOIN m y ON x.title = y.title AND x.id < y.id"""))
def report_dup_pairs(spark, d):
    """Different answers of one title side by side; a title's answers are few."""
    members = facts(spark, d).groupBy("title", "answer").agg(F.min("id").alias("id"))
    listed = members.groupBy("title").agg(F.array_sort(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)
    one = listed.select("title", "ids", F.posexplode("ids").alias("i", "a"))
    return one.select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"), "title")


@register("build_messages")
def build_messages(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    told = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), "turn", "role", "text")
    out = answers.build_messages(asked, told, render_context(spark, d), "question_id", "Answer from the evidence.")
    return out.select("question_id", F.size("messages").alias("n_messages"), F.element_at("messages", -1)["content"].alias("last"))
