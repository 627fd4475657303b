"""Queries on sources: stored pages, lists, wiki answers, caches, providers, and what gates them. Inputs are made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import tables, urls, wikitext
from tidemark.functions import text as tx
from tidemark.operators import names, quality_gate, topics
from tidemark.operators.steps import scratch
from tidemark.plans.catalog import register
from tidemark.plans.relations import documents, table
from tidemark.sources import curation, listing, providers, wiki
from tidemark.sources import pages as web
from tidemark.streaming import events as ev


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- character pages ---------------------------------------------------------------------------------------------


def _characters(spark, d):
    """A customer as a character page; of some the panel has no end, others have no name or no fields."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    name = _cat("客", F.pmod(k, F.lit(1000)))
    head = F.when(k % 7 == 0, "没有标题").otherwise(_cat("异环", name, "角色图鉴"))
    body = _cat("\n", name, "  ", F.col("c_mktsegment"), " 组\n战斗定位：生存 打击 异能名：「力", k % 10, "」 生日：", k % 12 + 1, "月0", k % 9 + 1, "日\n初始面板 生命值 约", k % 5000 + 100, " 攻击力：", k % 90 + 10)
    end = F.when(k % 5 == 0, "").otherwise("\n简介 生命值 999999")
    text = F.when(k % 11 == 0, F.concat(head, F.lit("\n初始面板 无"))).otherwise(F.concat(head, body, end))
    out = c.select("c_custkey", text.alias("text"))
    return out.withColumn("name", wiki.character_name(F.col("text"), F.lit("")))


_CHAR = """c AS (SELECT c_custkey AS k, '客' || (c_custkey % 1000) AS own, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '客' || (c_custkey % 1000) END AS name, c_mktsegment AS seg FROM customer)"""


@register("character_page", f"""WITH {_CHAR}, f AS (SELECT k, unnest([{{'i': 0, 'k': '生日', 'v': (k % 12 + 1) || '月' || (k % 9 + 1) || '日'}}, {{'i': 1, 'k': '异能', 'v': '力' || (k % 10)}}, {{'i': 2, 'k': '战斗定位', 'v': '生存 打击'}},
  {{'i': 3, 'k': '初始生命', 'v': CASE WHEN k % 5 <> 0 THEN (k % 5000 + 100) || '' ELSE '' END}}, {{'i': 4, 'k': '初始攻击', 'v': CASE WHEN k % 5 <> 0 THEN (k % 90 + 10) || '' ELSE '' END}}, {{'i': 5, 'k': '所属', 'v': CASE WHEN name <> '' THEN seg || ' 组' ELSE '' END}}]) AS x FROM c WHERE k % 11 <> 0)
SELECT k AS c_custkey, x.k AS field, x.v AS value FROM f WHERE x.v <> ''""")
def character_page(spark, d):
    pages = _characters(spark, d)
    return pages.select("c_custkey", F.explode(wiki.character_fields(F.col("text"), F.col("name"))).alias("x")).select("c_custkey", F.col("x.k").alias("field"), F.col("x.v").alias("value"))


@register("character_name", f"WITH {_CHAR} SELECT k AS c_custkey, name FROM c")
def character_name(spark, d):
    return _characters(spark, d).select("c_custkey", "name")


@register("affiliation", f"WITH {_CHAR} SELECT k AS c_custkey, CASE WHEN k % 11 = 0 THEN '' ELSE seg || ' 组' END AS held FROM c")
def affiliation(spark, d):
    pages = _characters(spark, d)
    return pages.select("c_custkey", wiki.affiliation(F.col("text"), _cat("客", F.pmod("c_custkey", F.lit(1000)))).alias("held"))


@register("drop_reason", f"WITH {_CHAR} SELECT k AS c_custkey, CASE WHEN name = '' THEN 'no_name' WHEN k % 11 = 0 THEN 'open_panel' ELSE '' END AS reason FROM c")
def drop_reason(spark, d):
    pages = _characters(spark, d).withColumn("f", wiki.character_fields(F.col("text"), F.col("name")))
    return pages.select("c_custkey", wiki.drop_reason(F.col("text"), F.col("name"), F.col("f")).alias("reason"))


@register("panel_block", f"WITH {_CHAR} SELECT k AS c_custkey, CASE WHEN k % 5 = 0 OR k % 11 = 0 THEN '' ELSE ' 生命值 约' || (k % 5000 + 100) || ' 攻击力：' || (k % 90 + 10) || chr(10) END AS panel FROM c")
def panel_block(spark, d):
    return _characters(spark, d).select("c_custkey", quality_gate.panel_block(F.col("text"), *wiki.PANEL).alias("panel"))


@register("character_links", "SELECT 'https://wiki.example/' || p_brand AS url, arg_min('异环' || substring(p_name, 1, 5) || '角色图鉴', p_partkey) AS title, arg_min(trim(substring(p_name, 1, 5)), p_partkey) AS name FROM part WHERE p_size % 2 = 0 GROUP BY 1")
def character_links(spark, d):
    part = table(spark, d, "part")
    label = F.when(F.col("p_size") % 2 == 0, _cat("异环", F.substring("p_name", 1, 5), "角色图鉴")).otherwise(F.col("p_name"))
    return wiki.character_links(part.select(_cat("https://wiki.example/", F.col("p_brand")).alias("url"), label.alias("title"), F.col("p_partkey").alias("seq")))


# --- lists and interfaces ----------------------------------------------------------------------------------------


@register("src_list", """WITH o AS (SELECT o_custkey AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS k, o_orderstatus = 'P' AS bare FROM orders), e AS (SELECT source, min(n) AS n_end FROM o WHERE bare GROUP BY 1)
SELECT source, 'https://list.example/d/' || (k % 50) || '.html' AS link, arg_min('Detail page ' || (k % 50), n) AS title FROM o LEFT JOIN e USING (source) WHERE n_end IS NULL OR n < n_end GROUP BY 1, 2""")
def src_list(spark, d):
    """Each customer is a source, each of its orders a list page with a link to a detail page and one elsewhere; pending orders are bare pages."""
    from pyspark.sql import Window

    o, k = table(spark, d, "orders"), F.col("o_orderkey") % 50
    page = _cat("<html><body><a href='/other'>Some other page</a>", F.when(F.col("o_orderstatus") == "P", "").otherwise(_cat("<a href='/d/", k, ".html'>Detail page ", k, "</a>")), "</body></html>")
    rows = o.select(F.col("o_custkey").alias("source"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page_no"), F.lit("https://list.example/list.html").alias("url"), page.alias("html"))
    return wiki.list_links(rows, r"/d/[0-9]+\.html")


@register("src_mw_allpages", """WITH o AS (SELECT o_custkey AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS hop, o_orderkey AS k, o_orderstatus = 'P' AS bare FROM orders), e AS (SELECT source, min(hop) AS stop FROM o WHERE bare GROUP BY 1),
r AS (SELECT source, hop, unnest(['页 ' || k, '第二页 ' || k]) AS title, unnest([0, 1]) AS i FROM o LEFT JOIN e USING (source) WHERE hop < 40 AND (stop IS NULL OR hop < stop)), p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hop, i) AS place FROM r)
SELECT source, title, CAST(place AS INTEGER) AS place FROM p WHERE place <= 9""")
def src_mw_allpages(spark, d):
    from pyspark.sql import Window

    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    titles = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("模板:表"))).otherwise(F.array(_cat("页 ", k), F.lit("首页"), _cat("第二页 ", k), F.lit("Sandbox 2")))
    body = F.to_json(F.struct(F.struct(F.transform(titles, lambda t: F.struct(t.alias("title"))).alias("allpages")).alias("query")))
    rows = o.select(F.col("o_custkey").alias("source"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("hop"), body.alias("body"))
    return wiki.all_pages(rows, 9)


@register("category_members", "SELECT c_custkey, c_name AS title FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer")
def category_members(spark, d):
    c = table(spark, d, "customer")
    members = F.array(F.struct(F.col("c_name").alias("title")), F.struct(F.lit("").alias("title")), F.struct(F.col("c_mktsegment").alias("title")))
    body = F.to_json(F.struct(F.struct(members.alias("categorymembers")).alias("query")))
    return c.select("c_custkey", F.explode(wiki.category_members(body)).alias("title"))


@register("src_mw_api", "SELECT p_partkey, 'P' || p_partkey AS title, '{{部件|名称=' || p_name || '}}' AS text FROM part WHERE p_partkey % 3 <> 0")
def src_mw_api(spark, d):
    """Batch answers of two pages each; pages that the wiki lacks, and pages without text, are left out."""
    part, k = table(spark, d, "part"), F.col("p_partkey")
    text = _cat("{{部件|名称=", F.col("p_name"), "}}")
    page = F.when(k % 3 == 0, F.when(k % 2 == 0, '{"title":"gone","missing":""}').otherwise('{"title":"empty","revisions":[{"*":""}]}')).when(k % 3 == 1, _cat('{"title":"P', k, '","revisions":[{"*":"', text, '"}]}')).otherwise(_cat('{"title":"P', k, '","revisions":[{"slots":{"main":{"*":"', text, '"}}}]}'))
    return part.select("p_partkey", F.explode(wiki.revisions(_cat('{"query":{"pages":{"', k, '":', page, "}}}"))).alias("x")).select("p_partkey", "x.title", "x.text")


@register("src_mw_parse", "SELECT page_id, 'https://wiki.example/Page_' || page_id AS url, true AS content FROM pages")
def src_mw_parse(spark, d):
    rows = table(spark, d, "pages").select("page_id", "html", _cat("Page ", F.col("page_id")).alias("asked"), F.lit("https://wiki.example/api.php").alias("api"))
    return wiki.parsed_pages(rows).select("page_id", "url", F.col("reason").isin("", "short").alias("content"))


@register("extract_variants")
def extract_variants(spark, d):
    """Every page's text by every strategy. No SQL: all but the two that patterns make are read from the page's tree."""
    return wiki.variants(table(spark, d, "pages").select("page_id", "html"), "page_id")


@register("extract_strategies")
def extract_strategies(spark, d):
    return wiki.variants(table(spark, d, "pages").select("page_id", "html"), "page_id")


@register("wikitext_many", """WITH p AS (SELECT p_brand AS source, 'P' || p_partkey AS title, p_size > 40 AS known FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY source, known ORDER BY title) - 1 AS i FROM p)
SELECT source, title, CASE WHEN NOT known THEN CAST(i // 20 AS INTEGER) END AS batch FROM n""")
def wikitext_many(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("source"), _cat("P", F.col("p_partkey")).alias("title"), "p_size")
    cached = part.select("source", "title", F.when(F.col("p_size") > 40, "x").otherwise("").alias("text"))
    return wiki.wikitext_plan(part.withColumn("title", _cat(" ", F.col("title"), " ")), cached)


_CACHE = """c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'https://w.example/api.php?list=allpages&x=' ELSE 'https://w.example/api.php?page=' END || o_orderkey AS url, 1000000 - (o_orderkey % 100) * 10000 AS since FROM orders)"""


@register("wiki_cache_read", f"WITH {_CACHE} SELECT url, '{{\"k\":' || k || '}}' AS data FROM c WHERE k % 7 > 1 AND 1000000 - since <= CASE WHEN k % 2 = 0 THEN 21600 ELSE 604800 END")
def wiki_cache_read(spark, d):
    """Stored answers of many ages; some are no envelope, some have a list for an object."""
    k = F.col("o_orderkey")
    url = F.when(k % 2 == 0, _cat("https://w.example/api.php?list=allpages&x=", k)).otherwise(_cat("https://w.example/api.php?page=", k))
    body = F.when(k % 7 == 0, "[1, 2").when(k % 7 == 1, _cat('{"fetched_at": ', 1000000 - (k % 100) * 10000, ', "data": [1]}')).otherwise(_cat('{"fetched_at": ', 1000000 - (k % 100) * 10000, ', "data": {"k": ', k, "}}"))
    return wiki.cache_read(table(spark, d, "orders").select(url.alias("url"), body.alias("body")), 1000000.0)


@register("wiki_ttl", f"WITH {_CACHE} SELECT url, CASE WHEN k % 2 = 0 THEN 21600 ELSE 604800 END AS ttl FROM c")
def wiki_ttl(spark, d):
    k = F.col("o_orderkey")
    url = F.when(k % 2 == 0, _cat("https://w.example/api.php?list=allpages&x=", k)).otherwise(_cat("https://w.example/api.php?page=", k))
    return table(spark, d, "orders").select(url.alias("url"), wiki.cache_ttl(url).alias("ttl"))


@register("wiki_cache", """WITH f AS (SELECT event_id AS name, epoch_us(ts) // 1000000 AS modified, user_id AS size FROM events), r AS (SELECT *, sum(size) OVER (ORDER BY modified // 86400 DESC, modified DESC, name) AS total FROM f) SELECT name, modified, size FROM r WHERE total <= 200000""")
def wiki_cache(spark, d):
    """The newest files up to a size in all."""
    files = table(spark, d, "events").select(F.col("event_id").alias("name"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("modified"), F.col("user_id").alias("size"))
    return topics.cache_sweep(files, 200_000)


@register("constant_guard", "SELECT c_custkey, c_nationkey >= greatest(4, ceil(c_custkey % 40 * 4 / 5)) AS enough FROM customer")
def constant_guard(spark, d):
    return table(spark, d, "customer").select("c_custkey", wiki.constant_guard(F.col("c_nationkey"), F.col("c_custkey") % 40).alias("enough"))


@register("meta_title_filter", r"""SELECT p_partkey, p_partkey % 4 IN (0, 1) AS meta FROM part""")
def meta_title_filter(spark, d):
    k = F.col("p_partkey") % 4
    title = F.when(k == 0, _cat(" Template:", F.col("p_name"))).when(k == 1, F.lit("Sandbox_a")).when(k == 2, _cat("共存测试", F.col("p_name"))).otherwise(_cat("a 首页 ", F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", wiki.meta_title(title).alias("meta"))


@register("narrative_title", "SELECT p_partkey, p_size % 3 = 0 AS narrative FROM part")
def narrative_title(spark, d):
    return table(spark, d, "part").select("p_partkey", wiki.narrative_title(F.when(F.col("p_size") % 3 == 0, _cat(F.col("p_name"), "的背景故事")).otherwise(F.col("p_name"))).alias("narrative"))


@register("source_class", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'narrative' ELSE 'data' END AS source_class FROM part")
def source_class(spark, d):
    part = table(spark, d, "part").withColumn("title", F.when(F.col("p_size") % 3 == 0, "角色介绍").otherwise("数据"))
    return web.annotate_class(part, wiki.narrative_title(F.col("title"))).select("p_partkey", "source_class")


@register("mark_construction", "SELECT s_suppkey, s_suppkey % 3 = 0 AS under_construction, s_suppkey % 6 <> 0 AS enabled, CASE WHEN s_suppkey % 3 <> 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'n' END WHEN s_suppkey % 6 = 0 THEN 'paused' ELSE '建设中' END AS note FROM supplier")
def mark_construction(spark, d):
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(k % 3 == 0, "https://new.example/a").otherwise("https://old.example/a").alias("url"), F.lit(True).alias("enabled"), F.when(k % 2 == 0, "n").alias("note"))
    return wiki.mark_construction(rows, ["new.example"], "建设中", F.when(k % 6 == 0, "paused").otherwise("")).select("s_suppkey", "under_construction", "enabled", "note")


@register("source_catalog", "SELECT 's' || n_nationkey AS source_id, CASE n_regionkey % 2 WHEN 0 THEN 'page' ELSE 'list' END AS kind, 'data' AS source_class FROM nation WHERE n_nationkey % 4 <> 0")
def source_catalog(spark, d):
    rows = [(f"s{r.n_nationkey}", "page" if r.n_regionkey % 2 == 0 else "list", "https://a.example/", "wiki", None, r.n_nationkey % 4 != 0) for r in table(spark, d, "nation").collect()]  # a catalogue is a file of some rows
    return curation.catalog(spark, rows).select("source_id", "kind", "source_class")


@register("src_dispatch", "SELECT 's' || n_nationkey AS source_id, CASE n_regionkey % 2 WHEN 0 THEN 'page' ELSE 'list' END AS via FROM nation")
def src_dispatch(spark, d):
    rows = table(spark, d, "nation").select(_cat("s", F.col("n_nationkey")).alias("source_id"), F.when(F.col("n_regionkey") % 2 == 0, "page").otherwise("list").alias("kind"))
    read = lambda kind: lambda df: df.select("source_id", F.lit(kind).alias("via"))
    return curation.dispatch(rows, {"page": read("page"), "list": read("list")})


# --- cleaning and gates ------------------------------------------------------------------------------------------


@register("decode_bytes", "SELECT doc_id, text FROM documents")
def decode_bytes(spark, d):
    """Texts as bytes in UTF-8, UTF-16 with a declared charset, and back."""
    wide = F.col("doc_id") % 2 == 0
    rows = documents(spark, d).select("doc_id", F.when(wide, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-8")).alias("raw"), F.when(wide, "utf-16-le").otherwise("").alias("charset"))
    return rows.select("doc_id", web.decode_bytes("raw", "charset").alias("text"))


@register("strip_boilerplate", r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), '^\s*[\-—=*·.]{3,}\s*$|^\s*[0-9]+\s*/\s*[0-9]+\s*$')) AS k FROM documents)
SELECT doc_id, trim(regexp_replace(array_to_string(k, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text, 3 AS removed_more FROM l""")
def strip_boilerplate(spark, d):
    """Three lines of noise are put around each text, and go again with its own."""
    noisy = _cat("扫码关注我们\n", F.col("text"), "\n免责声明：无\n3 / 7")
    out = documents(spark, d).select("doc_id", quality_gate.strip_boilerplate(noisy).alias("a"), quality_gate.strip_boilerplate(F.col("text")).alias("b"))
    return out.select("doc_id", "a.text", (F.col("a.removed") - F.col("b.removed")).alias("removed_more"))


@register("foreign_entities", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '光遇,原神,幻塔,鸣潮' ELSE '' END AS names FROM documents")
def foreign_entities(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, _cat(F.col("text"), "原神与鸣潮、幻塔和光遇")).otherwise(_cat(F.col("text"), "原神与鸣潮、幻塔"))
    docs = documents(spark, d).select("doc_id", text.alias("text"))
    foreign = names.present(docs, spark.createDataFrame([(n,) for n in quality_gate.FOREIGN], "name string"), "doc_id", "text", quality_gate.FOREIGN_KINDS)
    return docs.select("doc_id").join(foreign, "doc_id", "left").select("doc_id", F.coalesce(F.array_join("names", ","), F.lit("")).alias("names"))


@register("theme_terms", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_mktsegment < c_name THEN c_mktsegment || ',' || c_name ELSE c_name || ',' || c_mktsegment END AS terms FROM customer")
def theme_terms(spark, d):
    """Words that all of a customer's topics share."""
    a, b = F.col("c_mktsegment"), F.col("c_name")
    topics_ = F.array(_cat(a, " ", b, " x"), _cat(b, "、", a, " more"), F.when(F.col("c_custkey") % 4 == 0, F.lit("other words")).otherwise(_cat("y/", b, "|", a)))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(quality_gate.theme_terms(topics_)), ",").alias("terms"))


@register("config_theme", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'base' ELSE c_mktsegment END AS terms FROM customer")
def config_theme(spark, d):
    """Configured topics, or the default ones where none are."""
    own = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(_cat(F.col("c_mktsegment"), " a1"), _cat("b1 ", F.col("c_mktsegment"))))
    return table(spark, d, "customer").select("c_custkey", F.array_join(quality_gate.theme_terms(F.when(F.size(own) == 0, F.array(F.lit("base c1"), F.lit("d1 base"))).otherwise(own)), ",").alias("terms"))


@register("strip_footer", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Body of ' || page_id ELSE 'Body of ' || page_id || ' END MARK and more' END AS text FROM pages")
def strip_footer(spark, d):
    url = F.when(F.col("page_id") % 2 == 0, "https://a.example/x").otherwise("https://b.example/x")
    return table(spark, d, "pages").select("page_id", curation.strip_footer(url, _cat("Body of ", F.col("page_id"), " END MARK and more"), "a.example", r"\s*END MARK").alias("text"))


@register("strip_banner", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'A' || chr(10) || 'B [old] C' ELSE 'A[old]B [old] C' END AS text FROM pages")
def strip_banner(spark, d):
    url = F.when(F.col("page_id") % 2 == 0, "https://a.example/x").otherwise("https://a.example/y")
    return table(spark, d, "pages").select("page_id", curation.strip_banner(url, F.lit("A[old]B [old] C"), ["https://a.example/x"], "[old]").alias("text"))


@register("wikitext_clean", "SELECT p_partkey, p_name || ' ' || p_brand || '；' || p_type || ' site（https://e.example/' || p_partkey || '）' AS clean FROM part")
def wikitext_clean(spark, d):
    text = _cat("| '''", F.col("p_name"), "''' <!-- note --><ref name=a>r</ref> [[page|", F.col("p_brand"), "]]<br/>", "{{color|", F.col("p_type"), "|red=1}} [https://e.example/", F.col("p_partkey"), " site]\n\n")
    return table(spark, d, "part").select("p_partkey", wikitext.wikitext_clean(text).alias("clean"))


@register("json_repair", r"""SELECT p_partkey, '{"a": "\\u and é ' || p_partkey || '"}' AS fixed FROM part""")
def json_repair(spark, d):
    return table(spark, d, "part").select("p_partkey", F.replace(wikitext.json_repair(_cat('{"a": "\\u and \\u00e9 ', F.col("p_partkey"), '"}')), F.lit("\\u00e9"), F.lit("é")).alias("fixed"))


@register("llm_json", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{"a": ' || p_size || ', "b": "' || p_brand || '"}' WHEN 1 THEN '[' || p_size || ', {"k": "x"}]' END AS reply FROM part""")
def llm_json(spark, d):
    """Fenced and embedded JSON, and replies without any."""
    k, z = F.col("p_partkey") % 3, F.col("p_size")
    reply = F.when(k == 0, _cat('Here it is:\n```json\n{"b": "', F.col("p_brand"), '", "a": ', z, "}\n```")).when(k == 1, _cat("{not it} but [", z, ', {"k": "x"}] so')).otherwise("no json [here")
    return table(spark, d, "part").select("p_partkey", wikitext.llm_json(reply).alias("reply"))


@register("tautology", "SELECT p_partkey, p_partkey % 2 = 0 AS same FROM part")
def tautology(spark, d):
    return table(spark, d, "part").select("p_partkey", wikitext.tautology(F.when(F.col("p_partkey") % 2 == 0, _cat("「", F.col("p_name"), "」")).otherwise(_cat(F.col("p_name"), "x")), F.col("p_name")).alias("same"))


@register("page_text", "SELECT p_partkey, p_name || '（结构化字段，来自 parts）' || chr(10) || 'brand：' || p_brand || chr(10) || 'kind：' || p_type AS text FROM part")
def page_text(spark, d):
    pairs = F.array(F.struct(F.lit("brand").alias("k"), F.col("p_brand").alias("v")), F.struct(F.lit("kind").alias("k"), F.col("p_type").alias("v")))
    return table(spark, d, "part").select("p_partkey", wikitext.page_text(F.col("p_name"), pairs, F.lit("parts")).alias("text"))


# --- tables ------------------------------------------------------------------------------------------------------


@register("table_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents UNION ALL SELECT p_partkey + 1000000000, unnest(['| ' || p_name || ' | ' || p_size || ' |', '|---|:-:|', '| | |', '| 12 | 3.5% |', '| 一句。 | x |', '| ' || repeat(p_brand, 4) || ' | y |']) FROM part),
c AS (SELECT *, regexp_matches(x, '^\s*\|.*\|\s*$') AS is_row, list_transform(string_split(trim(trim(x, chr(32) || chr(9) || chr(13)), '|'), '|'), lambda i: trim(i, ' ')) AS cells FROM l),
f AS (SELECT *, list_filter(cells, lambda i: i <> '') AS filled FROM c)
SELECT doc_id, count(*) FILTER (is_row) AS n_rows, count(*) FILTER (is_row AND len(list_filter(cells, lambda i: contains(i, '-'))) > 0 AND len(list_filter(cells, lambda i: NOT regexp_matches(i, '^[-:]*$'))) = 0) AS n_rules,
  count(*) FILTER (is_row AND len(filled) > 0 AND len(list_filter(filled, lambda i: NOT regexp_matches(i, '^[0-9\s.,%+/\-年月日时分秒:：()（）]+$'))) > 0 AND len(list_filter(filled, lambda i: length(i) > 20 OR regexp_matches(i, '[。！？，、；「」【】《》…]'))) = 0) AS n_headers FROM f GROUP BY 1""")
def table_lines(spark, d):
    """Rows, rules and possible headers among the lines of all documents, and of lines made of parts."""
    part, docs = table(spark, d, "part"), documents(spark, d)
    made = F.array(_cat("| ", F.col("p_name"), " | ", F.col("p_size"), " |"), F.lit("|---|:-:|"), F.lit("| | |"), F.lit("| 12 | 3.5% |"), F.lit("| 一句。 | x |"), _cat("| ", F.repeat("p_brand", 4), " | y |"))
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("x")).union(part.select(F.col("p_partkey") + 1_000_000_000, F.explode(made)))
    row = tables.is_row(F.col("x"))
    return lines.groupBy("doc_id").agg(F.count_if(row).alias("n_rows"), F.count_if(tables.is_separator(F.col("x"))).alias("n_rules"), F.count_if(row & tables.is_header(tables.cells(F.col("x")))).alias("n_headers"))


@register("looks_like_table", r"""WITH a AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents) SELECT doc_id, len(l) >= 2 AND len(list_filter(l, lambda x: regexp_matches(x, '^\s*\|.*\|\s*$'))) >= greatest(2, len(l) * 0.5) AS tabular FROM a""")
def looks_like_table(spark, d):
    return documents(spark, d).select("doc_id", tables.looks_like_table(F.col("text")).alias("tabular"))


@register("split_table", """WITH r AS (SELECT l_orderkey, list('| ' || l_partkey || ' | ' || CAST(l_quantity AS INTEGER) || ' |' ORDER BY l_linenumber, l_partkey, l_quantity) AS rows FROM lineitem GROUP BY 1),
p AS (SELECT l_orderkey, rows, unnest(range((len(rows) + 2) // 3)) AS i FROM r)
SELECT l_orderkey, CAST(i AS INTEGER) AS piece, len(rows[i * 3 + 1 : i * 3 + 3]) AS n_rows FROM p""")
def split_table(spark, d):
    """An order's lines as a table, cut into pieces of three rows' room below the header; a row is padded to one width."""
    from tidemark.functions import types as ty

    @F.pandas_udf(ty.STRINGS)
    def pieces(blocks, sizes):
        import pandas as pd

        return pd.Series([tables.split_rows(b, int(s)) for b, s in zip(blocks, sizes, strict=True)])

    width = 26
    row = F.rpad(F.concat(F.lit("| "), _s("l_partkey"), F.lit(" | "), F.col("l_quantity").cast("int").cast("string")), width - 2, " ")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", F.concat(row, F.lit(" |")).alias("r")))).alias("x"))
    head = "| part | n |\n|---|---|"
    block = F.concat(F.lit(head + "\n"), F.array_join(F.transform("x", lambda y: y["r"]), "\n"))
    cut = rows.select("l_orderkey", F.posexplode(pieces(block, F.lit(len(head) + 1 + 3 * (width + 1)))).alias("piece", "t"))
    return cut.select("l_orderkey", "piece", (F.size(F.split("t", "\n")) - 2).cast("long").alias("n_rows"))


# --- hosts, redirects and providers ------------------------------------------------------------------------------


@register("site_of", r"SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS site FROM pages")
def site_of(spark, d):
    return table(spark, d, "pages").select("page_id", urls.host_of(F.upper("url")).alias("site"))


@register("private_host", "SELECT c_custkey, c_custkey % 5 <> 4 AS private FROM customer")
def private_host(spark, d):
    k = F.col("c_custkey")
    host = F.get(F.array(_cat("10.0.", k % 250, ".1"), F.lit("[::1]"), _cat("a", k, ".local"), _cat("172.", 16 + k % 16, ".3.4"), _cat("a", k, ".example")), (k % 5).cast("int"))
    return table(spark, d, "customer").select("c_custkey", urls.is_private(host).alias("private"))


@register("redirect_gate", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'private' WHEN 2 THEN 'blocked' ELSE '' END AS gate FROM customer")
def redirect_gate(spark, d):
    k = F.col("c_custkey")
    end = F.get(F.array(F.lit("https://a.example/b"), F.lit("http://127.0.0.1/"), F.lit("https://bad.example/x"), F.lit("https://c.example/y")), (k % 4).cast("int"))
    return table(spark, d, "customer").select("c_custkey", curation.redirect_gate(F.lit("https://a.example/a"), end, urls.host_matches(urls.host_of(end), "bad.example")).alias("gate"))


@register("video_url", "SELECT page_id, page_id % 3 = 0 AS video FROM pages")
def video_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.is_video(F.when(F.col("page_id") % 3 == 0, _cat("https://www.bilibili.com/video/BV", F.col("page_id"))).otherwise(F.col("url"))).alias("video"))


@register("baseline_block", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'dictionary:zdic.net' ELSE '' END AS block FROM pages")
def baseline_block(spark, d):
    return table(spark, d, "pages").select("page_id", urls.baseline_block(F.when(F.col("page_id") % 3 == 0, _cat("https://x.zdic.net/", F.col("page_id"))).otherwise(F.col("url"))).alias("block"))


@register("normalize_domains", "SELECT s_suppkey, 'b.example,s' || s_suppkey || '.example' AS domains FROM supplier")
def normalize_domains(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(F.array_sort(urls.normalize_domains(F.array(_cat("https://www.S", k, ".example/x"), F.lit(" b.example "), F.lit("# no"), F.lit(""), _cat("user@s", k, ".example:80")))), ",").alias("domains"))


@register("provider_order", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'b,a' ELSE 'c,a,b' END AS providers FROM customer")
def provider_order(spark, d):
    first = F.get(F.array(F.lit(""), F.lit("b"), F.lit("c")), (F.col("c_custkey") % 3).cast("int"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(providers.provider_order(first, ["a", "b"]), ",").alias("providers"))


@register("retry_after_parse", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey % 100 AS DOUBLE) WHEN 1 THEN 90.0 ELSE 0.0 END AS wait FROM orders")
def retry_after_parse(spark, d):
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    value = F.when(k % 3 == 0, _s(k % 100)).when(k % 3 == 1, F.date_format(at + F.expr("INTERVAL 90 SECONDS"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", providers.retry_after(value, at).alias("wait"))


@register("cooldown", "SELECT o_orderkey, u AS until, greatest(u - 1030, 0.0) AS left_ FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN greatest(CAST(o_orderkey % 3000 AS DOUBLE), 1000 + greatest(60.0, CAST(o_orderkey % 200 AS DOUBLE))) ELSE CAST(o_orderkey % 3000 AS DOUBLE) END AS u FROM orders)")
def cooldown(spark, d):
    k = F.col("o_orderkey")
    until = providers.cooldown_until(F.when(k % 4 == 0, 429).otherwise(200), (k % 200).cast("double"), F.lit(1000.0), (k % 3000).cast("double"))
    return table(spark, d, "orders").select("o_orderkey", until.alias("until"), providers.cooldown_left(until, F.lit(1030.0)).alias("left_"))


@register("host_interval", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 3.0 ELSE 0.8 END AS seconds FROM pages")
def host_interval(spark, d):
    return table(spark, d, "pages").select("page_id", providers.host_interval(F.when(F.col("page_id") % 2 == 0, "x.slow.example").otherwise("quick.example"), ["slow.example"], 0.8, 3.0).alias("seconds"))


@register("robots_policy", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey % 2 = 0 WHEN 1 THEN true ELSE false END AS allowed, o_orderkey % 30000 >= CASE o_orderkey % 3 WHEN 0 THEN 1800 WHEN 1 THEN 21600 ELSE 300 END AS stale FROM orders")
def robots_policy(spark, d):
    k = F.col("o_orderkey")
    state = F.get(F.array(F.lit("ok"), F.lit("missing"), F.lit("error")), (k % 3).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", providers.robots_allows(state, F.col("o_custkey") % 2 == 0).alias("allowed"), providers.robots_stale(state, k % 30000).alias("stale"))


@register("fetch_guarded", """WITH g AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'blocked' WHEN o_orderkey % 13 = 0 THEN 'baseline' WHEN o_orderkey % 1500 > 1000 THEN 'cooling' WHEN o_orderkey % 3 = 2 OR (o_orderkey % 3 = 0 AND o_custkey % 2 = 1) THEN 'robots' ELSE '' END AS reason FROM orders)
SELECT k AS o_orderkey, reason, reason = 'cooling' OR (reason = 'robots' AND k % 3 = 2) AS again, CASE WHEN reason = 'cooling' THEN CAST(k % 1500 - 1000 AS DOUBLE) ELSE 0.0 END AS wait FROM g""")
def fetch_guarded(spark, d):
    """Requests to blocked hosts, to sites that are never read, to hosts that pause, and to those whose robots answer refuses or is missing."""
    k = F.col("o_orderkey")
    url = F.when(k % 11 == 0, "https://a.bad.example/x").when(k % 13 == 0, "https://www.zdic.net/x").otherwise(_cat("https://h.example/", k))
    state = F.get(F.array(F.lit("ok"), F.lit("missing"), F.lit("error")), (k % 3).cast("int"))
    gate = providers.fetch_gate(url, urls.host_matches(urls.host_of(url), "bad.example"), (k % 1500).cast("double"), F.lit(1000.0), state, F.col("o_custkey") % 2 == 0)
    return table(spark, d, "orders").select("o_orderkey", gate.alias("g")).select("o_orderkey", "g.*")


@register("retryable_error", "SELECT o_orderkey, o_orderkey % 10 IN (0, 1, 2, 3) AS again FROM orders")
def retryable_error(spark, d):
    k = F.col("o_orderkey") % 10
    return table(spark, d, "orders").select("o_orderkey", providers.retryable(F.when(k == 0, F.lit(None).cast("int")).when(k == 1, 429).when(k == 2, 503).when(k == 3, 567).when(k < 6, 404).otherwise(200)).alias("again"))


@register("web_search", """WITH p AS (SELECT item_id, unnest(['https://b.example/' || item_id, 'https://a.example/' || item_id || '/', 'https://a.example/' || item_id || '#x']) AS url, unnest(['community', 'official', 'official']) AS t, unnest([0, 1, 2]) AS seq FROM benchmark)
SELECT item_id AS query, url, CASE seq WHEN 1 THEN 1 ELSE 2 END AS rank FROM p WHERE seq < 2""")
def web_search(spark, d):
    """Stored answers of a search provider: repeats of a page go, the better source comes first."""
    k = F.col("item_id")
    hits = F.array(F.struct(_cat("https://b.example/", k).alias("url"), F.lit("community").alias("source_type")), F.struct(_cat("https://a.example/", k, "/").alias("url"), F.lit("official").alias("source_type")), F.struct(_cat("https://a.example/", k, "#x").alias("url"), F.lit("official").alias("source_type")))
    rows = table(spark, d, "benchmark").select(k.alias("query"), F.posexplode(hits).alias("seq", "x")).select("query", "seq", "x.*")
    return providers.search_dedupe(rows).select("query", "url", "rank")


@register("cjk_bigrams", "SELECT c_custkey, '星城 城角 角' || chr(33394) || ' ' || chr(33394) || c_custkey % 10 AS grams FROM customer")
def cjk_bigrams(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.array_join(tx.pairs_of(_cat("星城角色", F.col("c_custkey") % 10)), " ").alias("grams"))


@register("quoted_terms", "SELECT p_partkey, regexp_replace(lower(p_brand), '#', '#') AS terms FROM part")
def quoted_terms(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.quoted_terms(tx.normalize(_cat("what is 「", F.col("p_brand"), "」 of ", F.col("p_type")))), " ").alias("terms"))


@register("noise_bigram", "SELECT c_custkey, c_custkey % 2 = 0 AS noise FROM customer")
def noise_bigram(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.is_noise(F.when(F.col("c_custkey") % 2 == 0, "我的").otherwise("角色")).alias("noise"))


@register("gap_numbers", r"SELECT p_partkey, CAST(p_size + 1000 AS VARCHAR) || ' ' || p_size || '.5 7' AS numbers FROM part")
def gap_numbers(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.gap_numbers(_cat(F.format_number(F.col("p_size") + 1000, 0), " then ", F.col("p_size"), ".50, 7, and 7.0")), " ").alias("numbers"))


@register("strip_template", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_type || repeat('x', 30) || '：' || p_type END AS value FROM part")
def strip_template(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.strip_template(F.when(F.col("p_partkey") % 2 == 0, _cat("部件的类型：", F.col("p_type"))).otherwise(_cat(F.col("p_type"), "x" * 30, "：", F.col("p_type")))).alias("value"))


@register("listing_source", "SELECT source, 'doc' || doc_id AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents")
def listing_source(spark, d):
    """Each source's documents as a listing of answers of up to 200 ids, read as a stream that stops after two answers and goes on in a second run."""
    folder = scratch(spark, "listing")
    docs = table(spark, d, "documents").select(F.col("source").alias("name"), F.floor(F.col("doc_id") / 200).alias("hop"), "doc_id")
    hops = docs.groupBy("name", "hop").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))  # 200 ids at most
    w = Window.partitionBy("name").orderBy("hop")
    hops = hops.withColumns({"token": F.when(F.row_number().over(w) == 1, "").otherwise(F.col("hop").cast("string")), "next": F.lead("hop").over(w).cast("string")})
    titles = F.transform("ids", lambda i: F.struct(F.concat(F.lit("doc"), i.cast("string")).alias("title")))
    body = F.to_json(F.struct(F.struct(titles.alias("allpages")).alias("query"), F.struct(F.col("next").alias("apcontinue")).alias("continue")))
    listing.store(hops.select("name", "token", body.alias("body")), f"{folder}/answers")
    names = ",".join(r.name for r in docs.select("name").distinct().orderBy("name").collect())  # the sources that are configured
    spark.dataSource.register(listing.Listing)
    for n in (2, 1_000_000):
        rows = spark.readStream.format("listing").options(path=f"{folder}/answers", names=names, hops=n).load()
        ev.run_once(rows, lambda df, _: df.write.mode("append").parquet(f"{folder}/rows"), f"{folder}/stream")
    return spark.read.schema("source string, title string, place long").parquet(f"{folder}/rows")
