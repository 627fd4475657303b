"""Golden cases of the text, number, URL, version, trust, table and wikitext functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import chunking, tables, trust, urls, wikitext
from tidemark.functions import text as tx
from tidemark.functions import versions as vs
from tidemark.functions.grounding import common_run
from tidemark.operators import dedupe, facts_py, quality_gate
from tidemark.sources import pages as web


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int")
    return df.select(column.alias("out")).first().out


def c(name="t"):
    return F.col(name)


@pytest.mark.parametrize(("text", "want"), [("原价 2,480.00 钻", ["2480"]), ("12.50 和 3", ["12.5", "3"]), (None, []), ("", [])])
def test_numbers(spark, text, want):
    assert one(spark, tx.numbers_in(F.lit(text).cast("string"))) == want


def test_signed_numbers(spark):
    assert one(spark, tx.numbers_signed(c()), t="8,424 / 12.00% / 1,455.00") == ["8424", "12", "1455"]
    assert one(spark, tx.signature(tx.numbers_signed(c())), t="-5 和 120 和 3.0") == "3|-5|120"
    assert one(spark, tx.gap_numbers(c()), t="86,000 甲硬币, 3") == ["86000", "3"]


@pytest.mark.parametrize(("text", "want"), [("8424", True), ("最高攻击 8424 点", True), ("12.5%", True), ("第 1 章", False), ("3 次", False), ("需要消耗体力", False), ("", False), (None, False)])
def test_value_like(spark, text, want):
    assert one(spark, tx.value_like(F.lit(text).cast("string"))) is want


def test_tokens(spark):
    norm = lambda t: one(spark, tx.normalize(c()), t=t)
    assert one(spark, tx.tokenize(c()), t=norm("Ａbc 星城角色 12.5% x")) == ["abc", "星城", "城角", "角色", "12.5%", "x"]
    assert one(spark, tx.tokenize_query(c()), t=norm("弧盘「我们。」的效果我们")) == ["弧盘", "我们", "的效", "效果", "果我"]
    assert one(spark, tx.tokenize_query(c()), t=norm("我们的 the the")) == ["the"]
    assert one(spark, tx.match_expression(F.array(F.lit('a"b'), F.lit('"')))) == '"ab"'


@given(st.text(alphabet="星城a b1.%「」的我\n", max_size=30))
@settings(max_examples=40, deadline=None)
def test_python_tokens_have_no_other_characters(text):
    assert all(t and " " not in t for t in tx.tokens_of(text))


CASES = [
    ("开放世界动作角色扮演游戏", "动作角色扮演游戏", "duplicate", "existing"),
    ("时装「夏日梦」原价 2480 钻", "时装「织梦者」原价 3280 钻", "conflict", "both"),
    ("持续 3 秒", "持续 5 秒", "conflict", "both"),
    ("弧盘「倾世之雨」提升暴击伤害 12%", "活动期间登录送 12 抽", "unrelated", "both"),
    ("", "", "duplicate", "existing"),
    ("a", "", "unrelated", "both"),
    ("same text", "Same, text!", "duplicate", "existing"),
    ("共存测试招募活动将于1月23日11:00关闭，还未参加的鉴定师请注意", "招募截止时间为1月23日 11:00。", None, None),
]


def test_compare_and_its_python_form_agree(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(CASES)], "i int, a string, b string")
    for r in dedupe.compare(df, "a", "b").collect():
        _, _, action, keep = CASES[r.i]
        assert (r.action, r.keep) == facts_py.compare(r.a, r.b)
        assert action is None or (r.action, r.keep) == (action, keep)


@given(st.lists(st.tuples(st.text(alphabet="星城角色12.,秒 a", max_size=14), st.text(alphabet="星城角色12.,秒 a", max_size=14)), min_size=1, max_size=30))
@settings(max_examples=8, deadline=None)
def test_compare_property(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for r in dedupe.compare(df, "a", "b").collect():
        assert (r.action, r.keep) == facts_py.compare(r.a, r.b), (r.a, r.b)


def test_merge(spark):
    for a, b in [("甲。乙", "乙。丙是新的内容"), ("", "x"), ("x", ""), ("动作角色扮演游戏", "开放世界动作角色扮演游戏"), ("甲乙丙丁", "乙丙")]:
        assert one(spark, tx.merge_answers(c("a"), c("b")), a=a, b=b) == facts_py.merge_answers(a, b)
    assert one(spark, tx.containment(c("a"), c("b")), a="动作角色扮演游戏", b="开放世界动作角色扮演游戏") == 1.0


def test_versions(spark):
    assert one(spark, vs.extract_version(c()), t="1.3版本更新…后续1.4版本前瞻") == "1.4"
    assert one(spark, vs.extract_version(c()), t="1.9版本和1.10版本") == "1.10"
    assert one(spark, vs.extract_version(c()), t="装备者造成的伤害增加12.00%，对低血量敌人提升1.5倍") == ""
    assert one(spark, vs.version_key(c()), t="1.10") == [1, 10] and one(spark, vs.version_key(c()), t="") == []
    assert one(spark, vs.slot_key(vs.entity_of(c()), c()), t="「我们。」·描述") == "我们。|描述"


@pytest.mark.parametrize(
    ("text", "url", "want"),
    [
        ("活动时间：2026年8月13日-2026年9月3日", "", ("2026-08-13", "effective")),
        ("8月13日上线", "", ("", "")),
        ("新版本将于1月5日上线。", "https://a.b/20251220/1.html", ("2026-01-05", "effective")),
        ("没有日期", "https://a.b/20251220/1.html", ("2025-12-20", "published")),
        ("2026-13-45", "", ("", "")),
        ("2026-01-01、2026-02-01、2026-03-01 上线", "https://a.b/20251220/", ("2025-12-20", "published")),
    ],
)
def test_dates(spark, text, url, want):
    got = one(spark, vs.extract_date_info(F.lit(""), c("t"), c("u")), t=text, u=url)
    assert (got.date, got.kind) == want


def test_dates_of_two_texts(spark):
    """Title before answer; two dates without context leave it to the next text; months and days of one kind only."""
    cases = [
        ("2026-01-01与2026-02-01", "2026/3/5 开启", "", ("2026-03-05", "effective")),
        ("上线 2026-02-01，2026-01-01", "2026/3/5 开启", "", ("2026-02-01", "effective")),
        (None, "1月5日和2月3日上线", "https://a.b/20251220/", ("2025-12-20", "published")),
        (None, "11月20日与11月20日的更新", "https://a.b/20251220_x", ("2025-11-20", "effective")),
        (None, "6月1日的更新", "https://a.b/20250808", ("2025-08-08", "published")),
        ("2023-02-29 更新", None, "https://a.b/20251340", ("2023-02-29", "effective")),
        ("", "x" * 40 + "8月13日" + "y" * 40 + "更新", "https://a.b/20260808", ("2026-08-08", "published")),
    ]
    df = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(cases)], "i int, a string, b string, u string")
    for r in df.select("i", vs.extract_date_info(c("a"), c("b"), c("u")).alias("d")).collect():
        assert (r.d.date, r.d.kind) == cases[r.i][3], cases[r.i]


def test_places(spark):
    assert [(x.at, x.hit) for x in one(spark, vs.places(c(), r"[0-9]+"), t="12ab3 4")] == [(0, "12"), (4, "3"), (6, "4")]
    assert one(spark, vs.places(c(), r"[0-9]+"), t="ab") == [] and one(spark, vs.places(c(), r"[0-9]+"), t="") == []


def test_question_dates(spark):
    assert one(spark, vs.question_date(c()), t="2026年8月13日能用吗") == "2026-08-13"
    assert one(spark, vs.question_date(c()), t="2026年8月13日到15日能用吗") is None
    assert one(spark, vs.explicit_start(c(), F.lit("https://a.b/20260808/")), t="将于8月13日版本更新后开启") == "2026-08-13"


def test_trust_order(spark):
    at = F.lit("2026-01-01").cast("timestamp")
    score = lambda s, e, n, bad: one(spark, trust.trust(F.lit(s), F.lit(e), trust.consistency(F.lit(n), F.lit(bad)), trust.freshness(at, at, F.lit(False))))
    assert score("official", "api", 1, False) > score("official", "table", 1, False) > score("official", "llm", 1, False)
    assert score("official", "api", 1, False) > score("wiki", "api", 1, False) > score("community", "api", 1, False)
    assert score("wiki", "api", 2, False) > score("wiki", "api", 1, False) > score("wiki", "api", 1, True)
    assert one(spark, trust.time_sensitive(c(), F.lit("")), t="角色up池")
    assert not one(spark, trust.time_sensitive(c(), F.lit("")), t="setup backup")


@pytest.mark.parametrize(
    ("url", "host", "domain"),
    [
        ("https://www.A.example.com:8080/x?y#z", "www.a.example.com", "a.example.com"),
        ("http://u:p@h_o.st/x", "h_o.st", "h_o.st"),
        ("a.b/c", "", "a.b"),
        ("http://[abc", "", ""),
        ("", "", ""),
    ],
)
def test_hosts(spark, url, host, domain):
    assert one(spark, urls.host_of(c()), t=url) == host
    assert one(spark, urls.domain_of(c()), t=url) == domain


def test_urls(spark):
    assert one(spark, urls.canonical_url(c()), t="HTTPS://A.b/%E8%96%84/x+y/?q#f") == "https://a.b/薄/x+y"
    assert one(spark, urls.page_key(c()), t="https://A.b/x//#f") == "https://a.b/x"
    assert one(spark, urls.source_key(c()), t="https://a.b:443/x/?b=2&a=1") == "a.b||/x|a=1&b=2"
    assert one(spark, urls.url_date(c()), t="https://a.b/20260229/") == "2026-02-29"
    assert one(spark, urls.url_date(c()), t="https://a.b/20260231/") == ""
    assert one(spark, urls.baseline_block(c()), t="https://www.bilibili.com/video/1") == "video"
    assert one(spark, urls.baseline_block(c()), t="https://x.zdic.net/a") == "dictionary:zdic.net"
    assert one(spark, urls.baseline_block(c()), t="https://notzdic.net/a") == ""
    values = F.array(*[F.lit(v) for v in ("https://www.9game.cn/x", " blog.csdn.net ", "# no", "", "user@example.com:80", "9game.cn")])
    assert one(spark, urls.normalize_domains(values)) == ["9game.cn", "blog.csdn.net", "example.com"]
    assert one(spark, urls.is_private(c()), t="192.168.0.1") and one(spark, urls.is_private(c()), t="[::1]") and not one(spark, urls.is_private(c()), t="8.8.8.8")


TABLE = "| 添加弧盘 | |\n|---|---|\n| 名称 | 稀有度 | 效果 |\n|---|---|---|\n| 该死的邂逅 | A | 攻击 12% |\n| 名称 | 稀有度 | 效果 |\n| 我们 | S | 图片.png |"


def test_tables(spark):
    (table,) = tables.tables_of(TABLE)
    assert table["header"] == ["名称", "稀有度", "效果"] and len(table["rows"]) == 2
    df = spark.createDataFrame([(TABLE, "图鉴")], "text string, page string")
    got = [(r.fact_title, r.fact_answer) for r in tables.table_facts(df, "text", "page").collect()]
    assert got[0] == ("该死的邂逅（图鉴）", "图鉴 中「该死的邂逅」的详细信息：稀有度：A；效果：攻击 12%。")
    assert got[1][1] == "图鉴 中「我们」的详细信息：稀有度：S。"
    assert one(spark, tables.is_separator(c()), t="|---|:-:|") and not one(spark, tables.is_separator(c()), t="| | |")
    pieces = tables.split_rows("\n".join(["| a | b |", "|---|---|"] + [f"| {i} | x |" for i in range(50)]), 120)
    assert len(pieces) > 3 and all(p.startswith("| a | b |\n|---|---|\n") and len(p) <= 120 for p in pieces)


def test_tables_are_the_best_of_what_follows():
    small, large = "| a | b |\n|---|---|\n| 1 | 2 |\n", "| x | y | z |\n|---|---|---|\n" + "| 1 | q | 3 |\n" * 3
    names = lambda t: [x["header"][0] for x in tables.tables_of(t)]
    assert names(small + "text\n" + large) == ["x"] and names(large + "text\n" + small) == ["x", "a"] and names(small + "\n" + small) == ["a", "a"]
    assert names("|---|---|\n| 1 | 2 |") == [] and names(None) == [] and names("| 一。二 | b |\n|---|---|\n| 1 | 2 |") == []
    assert tables.split_rows(large + "end of it\nmore", 30)[-1] == "| 1 | q | 3 |\nend of it" or tables.split_rows(large, 30)[0].startswith("| x |")


def test_wikitext(spark):
    text = "{{弧盘 \n|名称=[[a|我们]]|效果='''攻击'''{{色|红|12%}}<br>x<ref>no</ref>|名称=更长的名称}}"
    (top, *_) = wikitext.templates(text)
    assert top["name"] == "弧盘" and {"k": "效果", "v": "攻击红；x"} in top["fields"]
    df = spark.createDataFrame([(1, text)], "page int, text string")
    got = {r.field: r.value for r in wikitext.template_fields(df, "page", "text", ["弧盘"]).collect()}
    assert got == {"名称": "更长的名称", "效果": "攻击红；x"}
    assert wikitext.split_top("a|{{b|c}}|[[d|e]]|f") == ["a", "{{b|c}}", "[[d|e]]", "f"]
    assert one(spark, wikitext.tautology(c("a"), c("b")), a="「我们」", b="我们")
    assert one(spark, wikitext.llm_json(c()), t='Here: ```json\n{"b": [1], "a": 2}\n``` end') == '{"a": 2, "b": [1]}'
    assert one(spark, wikitext.llm_json(c()), t="none") is None
    assert one(spark, wikitext.json_repair(c()), t=r'{"a": "\u12"}') == r'{"a": "\\u12"}'


def test_chunks():
    text = "。".join(f"第{i}句话说了一些东西" for i in range(200))
    chunks = chunking.chunks_of(text, 200, 40)
    assert all(10 <= len(x) <= 240 for x in chunks) and len(chunks) > 8
    assert chunking.chunks_of("short") == [] and chunking.chunks_of(None) == []
    assert chunking.chunks_of("a paragraph of text\n\nanother paragraph", 120) == ["a paragraph of text\nanother paragraph"]
    assert [len(x) for x in chunking.chunks_of("x" * 500, 200, 0)] == [200, 200, 100]


def test_gates(spark):
    got = one(spark, quality_gate.strip_boilerplate(c()), t="正文第一行\n扫码关注我们\n---\n3 / 7\n正文第二行")
    assert (got.text, got.removed) == ("正文第一行\n正文第二行", 3)
    assert one(spark, quality_gate.theme_terms(F.array(F.lit("星城 角色 图鉴"), F.lit("星城 主线"), F.lit("")))) == ["星城"]
    assert one(spark, quality_gate.panel_block(c(), "<a>", "</a>"), t="x<a>mid</a>y") == "mid"
    assert one(spark, quality_gate.gate_reason(F.lit(""), c()), t="字" * 200) == "" and one(spark, quality_gate.gate_reason(F.lit(""), c()), t="字" * 20) == "short"


def test_simhash_is_fnv(spark):
    assert dedupe.fnv1a64(b"a") == 0xAF63DC4C8601EC8C and int(dedupe._fnv([b"a", b"foobar", b""])[1]) == 0x85944171F73967E8
    assert dedupe.simhash([]) == 0
    (a,) = spark.createDataFrame([("x y z",)], "t string").select(dedupe.simhash64(F.col("t"))).first()
    assert a == dedupe.simhash(["x", "y", "z"])


@given(st.text(alphabet="ab星", max_size=25), st.text(alphabet="ab星", max_size=25))
@settings(max_examples=80, deadline=None)
def test_common_run(a, b):
    best = max((n for n in range(len(a) + 1) for i in range(len(a) - n + 1) if a[i : i + n] in b), default=0)
    assert common_run(a, b) == best


def test_html():
    text, title, date = web.extract('<html><head><title>T</title><meta property="article:published_time" content="2026-01-02"></head><body><nav>menu</nav><article><h1>H</h1>' + "<p>Some words here.</p>" * 20 + "</article><footer>f</footer></body></html>")
    assert title == "T" and date == "2026-01-02" and text.startswith("H\nSome words here.") and "menu" not in text
    assert web.extract(None) == ("", "", "")


def test_long_answers_are_grounded(spark):
    import random

    from tidemark.functions import grounding

    rng = random.Random(2)
    text = "".join(rng.choices("abcdefghij", k=3000))
    for _ in range(200):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(15))) for _ in range(2))
        assert common_run(a, b) == max(j - i for i in range(len(a) + 1) for j in range(i, len(a) + 1) if a[i:j] in b)
    data = [(1, text[500:1700], text), (2, text[:250] + "k" * 950, text)]
    rows = spark.createDataFrame(data, "id int, text string, source string")
    got = rows.select("id", grounding.longest_common_run("text", "source").alias("run"), grounding.grounded("text", "source").alias("ok")).orderBy("id").collect()
    assert [(r.run, r.ok) for r in got] == [(1200, True), (250, False)]
