"""Readers of wikis and list pages over stored answers: the requests are made elsewhere, what follows from the answers is tables.

Character pages are texts with named fields; list pages are HTML with links; interface answers are JSON. A stored answer is a row, so a
source of any size is a table that Spark deals out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import quality_gate
from tidemark.operators.steps import settle
from tidemark.sources import pages as web

# Fields of a character page, maintenance titles, narrative titles, limits.
NAME = r"异环(.{1,6}?)角色图鉴"
ROLE = r"战斗定位[：:]\s*([^\n]{1,40}?)\s*(?=(?:异能名|生日)[：:]|$)"
ABILITY_QUOTED = r"异能名[：:]\s*[「『\"“]([^」』\"”\n]{1,20})[」』\"”]"
ABILITY_BARE = r"异能名[：:]\s*([^\s「『\"”（(]{1,20})"
BIRTHDAY = r"生日[：:]\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日"
PANEL = ("初始面板", "简介")
PANEL_FIELDS = (("生命值", "初始生命"), ("攻击力", "初始攻击"), ("防御力", "初始防御"))
META_TITLE = (
    r"(?i)^(san\w{0,3}box.*|沙盒.*|测试页面.*|test\s*page.*|创建.*|编辑.*|widget|gadget|common\.css|common\.js|wiki样式.*|样式调整器|mediawiki(\s*汇总页面)?.*|汇总页面|"
    r"(模板|template|分类|category|帮助|help|用户|user|talk|讨论|widget|模块|module|特殊|special|文件|file)\s*:.*|首页|main\s*page)$"
)
NARRATIVE_TITLE = "角色介绍|角色档案|人物介绍|角色设定|人物设定|世界观|设定集|背景故事|人物故事|剧情|前传|番外|访谈"
MAX_HOPS, BATCH_TITLES, MIN_PARSED, CONSTANT_PAGES = 40, 20, 120, 4
INDEX_TTL, PAGE_TTL = 6 * 3600, 7 * 86400

_PAIRS = "array<struct<k:string,v:string>>"


def _spaced(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def character_name(text: Column, title: Column) -> Column:
    """The name in the text's heading, else in the page's title, else nothing."""
    named = [F.nullif(F.btrim(F.regexp_extract(F.coalesce(t, F.lit("")), NAME, 1)), F.lit("")) for t in (text, title)]
    return F.coalesce(*named, F.lit(""))


def affiliation(text: Column, name: Column) -> Column:
    """What stands after the name in the first line that begins with it, up to 21 characters."""
    after = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.when(F.ltrim(x).startswith(name), F.substr(F.regexp_replace(x, r"^[ \t]+", ""), F.length(name) + 1)))
    fits = F.filter(after, lambda x: x.rlike(r"^[ \t]+\S.{0,20}$"))
    return F.when(name == "", "").otherwise(F.coalesce(_spaced(F.get(fits, 0)), F.lit("")))


def character_fields(text: Column, name: Column) -> Column:
    """array<struct<k, v>> of a character page's fields in a fixed order, empty ones left out."""
    body = F.coalesce(text, F.lit(""))
    grab = lambda where, pattern, i=1: F.regexp_extract(where, pattern, i)
    day = [F.concat(F.lit("0"), grab(body, BIRTHDAY, i)) for i in (1, 2)]
    born = F.when(grab(body, BIRTHDAY, 1) != "", F.concat(day[0].cast("int").cast("string"), F.lit("月"), day[1].cast("int").cast("string"), F.lit("日")))
    panel = quality_gate.panel_block(body, *PANEL)
    found = [
        ("生日", born),
        ("异能", _spaced(F.coalesce(F.nullif(grab(body, ABILITY_QUOTED), F.lit("")), grab(body, ABILITY_BARE)))),
        ("战斗定位", _spaced(grab(body, "(?m)" + ROLE))),
        *((field, grab(panel, rf"{label}[^0-9]{{0,8}}([0-9]{{1,7}})")) for label, field in PANEL_FIELDS),
        ("所属", affiliation(text, name)),
    ]
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in found])
    return F.filter(pairs, lambda p: F.coalesce(p["v"], F.lit("")) != "").cast(_PAIRS)


def drop_reason(text: Column, name: Column, fields: Column) -> Column:
    """Why a page isn't used: no name, a panel without an end, or nothing structured; empty for a usable one."""
    bare = (quality_gate.panel_block(F.coalesce(text, F.lit("")), *PANEL) == "") & (F.size(fields) == 0)
    return F.when(F.coalesce(name, F.lit("")) == "", "no_name").when(bare & F.contains(F.coalesce(text, F.lit("")), F.lit(PANEL[0])), "open_panel").when(bare, "no_fields").otherwise("")


def character_links(links: DataFrame, label: str = "title", url: str = "url") -> DataFrame:
    """url, title and name of links whose label is a character page's, each URL once, the first place of it."""
    named = links.withColumn(label, _spaced(F.col(label))).filter(F.col(label).rlike("异环.{1,6}角色图鉴"))
    first = named.groupBy(url).agg(F.min_by(label, "seq").alias(label))
    return first.withColumn("name", character_name(F.col(label), F.lit("")))


def list_links(pages: DataFrame, pattern: str, by: str = "source", page: str = "page_no", url: str = "url", html: str = "html") -> DataFrame:
    """by, link and title of the detail pages that a source's list pages link to; pages after the first one without any are not read."""
    # written once: both the ends and the links are read from it, and each would parse all pages
    own = settle(pages.select(by, page, F.filter(web.extract_links(F.col(html), F.col(url)), lambda x: x["url"].rlike(pattern)).alias("_l")), "list-links")
    ends = own.filter(F.size("_l") == 0).groupBy(by).agg(F.min(page).alias("_end"))
    used = own.join(ends, by, "left").filter(F.col("_end").isNull() | (F.col(page) < F.col("_end")))
    rows = used.select(by, page, F.posexplode("_l").alias("_i", "_x"))
    return rows.groupBy(by, F.col("_x.url").alias("link")).agg(F.min_by(F.col("_x.title"), F.struct(page, "_i")).alias("title"))


def meta_title(title: Column) -> Column:
    """A wiki's maintenance page; one without title is one too."""
    return quality_gate.meta_title(title, META_TITLE)


def narrative_title(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(NARRATIVE_TITLE)


def all_pages(answers: DataFrame, limit: int, by: str = "source", hop: str = "hop", body: str = "body") -> DataFrame:
    """by, title and place of the titles of a listing's answers, in order, without maintenance pages.

    A source's answers count up to the first that brings no title, ``MAX_HOPS`` of them, and ``limit`` titles.
    """
    titles = F.transform(F.from_json(body, "query struct<allpages: array<struct<title: string>>>")["query"]["allpages"], lambda x: x["title"])
    read = answers.filter(F.col(hop) < MAX_HOPS).select(by, hop, F.filter(F.coalesce(titles, F.array().cast("array<string>")), lambda t: ~meta_title(t)).alias("_t"))
    ends = read.filter(F.size("_t") == 0).groupBy(by).agg(F.min(hop).alias("_end"))
    rows = read.join(ends, by, "left").filter(F.col("_end").isNull() | (F.col(hop) < F.col("_end"))).select(by, hop, F.posexplode("_t").alias("_i", "title"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(hop, "_i"))  # a listing has MAX_HOPS answers at most
    return rows.withColumn("place", place).filter(F.col("place") <= limit).select(by, "title", "place")


def category_members(body: Column) -> Column:
    """The titles of a category's answer."""
    listed = F.from_json(body, "query struct<categorymembers: array<struct<title: string>>>")["query"]["categorymembers"]
    return F.filter(F.transform(F.coalesce(listed, F.array().cast("array<struct<title:string>>")), lambda x: x["title"]), lambda t: F.coalesce(t, F.lit("")) != "")


def revisions(body: Column) -> Column:
    """array<struct<title, text>> of a batch answer; pages without text are left out."""
    shape = "query struct<pages: map<string, struct<title: string, missing: string, revisions: array<struct<`*`: string, slots: struct<main: struct<`*`: string>>>>>>>"
    pages = F.map_values(F.from_json(body, shape)["query"]["pages"])
    first = lambda p: F.get(p["revisions"], 0)
    told = F.transform(pages, lambda p: F.struct(p["title"].alias("title"), F.coalesce(F.nullif(first(p)["slots"]["main"]["*"], F.lit("")), first(p)["*"]).alias("text"), p["missing"].alias("missing")))
    good = F.filter(told, lambda p: p["missing"].isNull() & (F.coalesce(p["title"], F.lit("")) != "") & (F.coalesce(p["text"], F.lit("")) != ""))
    return F.coalesce(F.transform(good, lambda p: F.struct(p["title"], p["text"])), F.array().cast("array<struct<title:string,text:string>>"))


def cache_ttl(url: Column, ttl: int = PAGE_TTL) -> Column:
    """Seconds that a stored answer holds: less for listings."""
    listing = F.contains(url, F.lit("list=categorymembers")) | F.contains(url, F.lit("list=allpages"))
    return F.when(listing, F.least(F.lit(ttl), F.lit(INDEX_TTL))).otherwise(ttl)


def cache_read(cache: DataFrame, now: float, ttl: int = PAGE_TTL, url: str = "url", body: str = "body") -> DataFrame:
    """url and data of stored answers that still hold; what isn't an envelope with a time and an object is no answer."""
    when = F.try_element_at(F.from_json(body, "map<string, string>"), F.lit("fetched_at")).try_cast("double")
    data = F.get_json_object(body, "$.data")
    held = cache.select(url, when.alias("_at"), data.alias("data"))
    return held.filter((F.lit(now) - F.coalesce("_at", F.lit(0.0)) <= cache_ttl(F.col(url), ttl)) & (F.substring("data", 1, 1) == "{")).select(url, "data")


def wikitext_plan(wanted: DataFrame, cached: DataFrame, by: str = "source", title: str = "title", size: int = BATCH_TITLES) -> DataFrame:
    """by, title and batch: null for a title whose text is stored, else the number of the request that asks for it."""
    names = wanted.select(by, F.btrim(title).alias(title)).filter(F.col(title) != "").distinct()
    known = cached.filter(F.coalesce("text", F.lit("")) != "").select(by, title).distinct().withColumn("_known", F.lit(True))
    both = names.join(known, [by, title], "left")
    number = F.row_number().over(Window.partitionBy(by, F.col("_known").isNull()).orderBy(title)) - 1  # a source's pages are a bounded list
    return both.select(by, title, F.when(F.col("_known").isNull(), F.floor(number / size).cast("int")).alias("batch"))


def constant_guard(parsed: Column, wanted: Column, least: int = CONSTANT_PAGES) -> Column:
    """Whether enough of a batch was read to tell a template's constants: four pages, and four fifths."""
    return parsed >= F.greatest(F.lit(least), F.ceil(wanted * F.lit(4) / F.lit(5)))


def parsed_pages(pages: DataFrame, title: str = "asked", html: str = "html", api: str = "api") -> DataFrame:
    """pages with url, title, text and reason: a rendered page that is too short, or a maintenance page, isn't used."""
    read = pages.withColumn("_p", web.html_extract(F.col(html)))
    own = F.coalesce(F.nullif(F.col("_p.title"), F.lit("")), F.col(title))
    reason = F.when(F.coalesce(F.col(html), F.lit("")) == "", "no_text").when(F.length("_p.text") < MIN_PARSED, "short").when(meta_title(own), "meta").otherwise("")
    place = F.concat(F.regexp_replace(api, r"/api\.php.*$", ""), F.lit("/"), F.url_encode(F.replace(F.col(title), F.lit(" "), F.lit("_"))))
    return read.select(*[c for c in pages.columns if c != html], place.alias("url"), own.alias("title"), F.col("_p.text").alias("text"), reason.alias("reason"))


def variants(pages: DataFrame, key: str, html: str = "html", containers: Sequence[str] = web.CONTAINERS) -> DataFrame:
    """key, strategy, chars and preview of a page's text by several strategies, to see which of them loses it; -1 characters where a page lacks a container."""
    raw = F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), "<[^>]*>", " "), r"\s+", " "))
    read = pages.select(key, tx.clean_inline(F.col(html)).alias("inline"), raw.alias("body"))
    long_ = read.unpivot([key], ["inline", "body"], "strategy", "text").withColumn("text", F.coalesce("text", F.lit("")))
    every = long_.unionByName(web.texts_by_strategy(pages.select(key, html), containers))
    return every.select(key, "strategy", F.coalesce(F.length("text"), F.lit(-1)).alias("chars"), F.substring(F.coalesce("text", F.lit("")), 1, 240).alias("preview"))


def mark_construction(catalog: DataFrame, domains: Sequence[str], note: str, paused: Column) -> DataFrame:
    """The catalogue with under_construction; such sources are noted, and switched off where they are paused."""
    hit = F.exists(F.array(*[F.lit(x) for x in domains]), lambda x: F.contains(F.coalesce("url", F.lit("")), x))
    old = F.coalesce("note", F.lit(""))
    told = F.when(~hit, F.col("note")).when(paused != "", paused).when(F.contains(old, F.lit(note)), old).when(old == "", note).otherwise(F.concat(old, F.lit("；"), F.lit(note)))
    return catalog.withColumns({"under_construction": hit, "enabled": F.col("enabled") & ~(hit & (paused != "")), "note": told})
