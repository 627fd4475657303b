"""Page quality gates: boilerplate lines, density, noise and foreign names, in a fixed order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import tables
from tidemark.functions import text as tx

# Line patterns, page patterns, title words and foreign names of the gates.
LINE_NOISE = (
    r"^\s*扫码(关注|下载|查看)",
    r"^\s*长按(识别)?二维码",
    r"^\s*扫描二维码",
    r"^\s*(点击|戳)(这里|下方|上方|查看|阅读原文)",
    r"^\s*关注(我们|公众号|官方)",
    r"^\s*(更多|相关)(精彩|内容|攻略|推荐)",
    r"^\s*(责任编辑|编辑|作者|来源|版权|转载请注明|声明)\s*[:：]",
    r"^\s*(本文|本站).{0,10}(转载|整理|发布)",
    r"^\s*免责声明",
    r"^\s*(上一[篇页]|下一[篇页]|返回列表|回到顶部)",
    r"^\s*(广告|赞助内容|推广)",
    r"^\s*下载\s*(九游|3DM|游民|TapTap|APP)",
    r"^\s*[\-—=*·.]{3,}\s*$",
    r"^\s*\d+\s*/\s*\d+\s*$",
    r"本WIKI编辑权限开放",
    r"欢迎收藏起来防止迷路",
    r"目前WIKI正在初步建设中",
    r"WIKI编辑权限暂时无人",
    r"WIKI留言板|WIKI交流群",
    r"本页面正在\s*施工中",
    r"点击此处\s*协助编辑",
    r"刷新当前页缓存",
)
PAGE_NOISE = (("qr", r"二维码|扫码关注|扫码下载", 3), ("account", r"关注(公众号|官方微信)", 3), ("download", r"点击(下载|安装).{0,8}(APP|客户端|游戏)", 3))
LOW_VALUE_TITLES = "视频|图集|图片|直播回放|预告片|高清壁纸"
FOREIGN = (
    "绝区零", "原神", "崩坏3", "崩坏三", "星穹铁道", "崩坏：星穹铁道", "鸣潮", "明日方舟", "碧蓝航线", "公主连结", "塞尔达", "艾尔登法环",
    "黑神话", "幻塔", "光遇", "第五人格", "阴阳师", "Fate/Grand Order", "FGO", "妮姬", "尘白禁区", "白荆回廊", "无限暖暖", "洛克王国",
)
MIN_CHARS, MIN_DENSITY, TABLE_DENSITY, FOREIGN_KINDS, FOREIGN_SHARE = 150, 0.35, 0.25, 4, 0.02
_START = r"^\s*"
#: Patterns of a line's start, tried at one place, and of any place, all of which have a CJK character.
_AT_START = f"(?i){_START}(?:" + "|".join(p.removeprefix(_START) for p in LINE_NOISE if p.startswith(_START)) + ")"
_ANYWHERE = "(?i)" + "|".join(f"(?:{p})" for p in LINE_NOISE if not p.startswith(_START))


def boilerplate_line(line: Column) -> Column:
    own = F.btrim(F.coalesce(line, F.lit("")))
    return (own != "") & (own.rlike(_AT_START) | F.when(own.rlike(f"[{tx.CJK}]"), own.rlike(_ANYWHERE)).otherwise(False))


def strip_boilerplate(text: Column) -> Column:
    """struct(text, removed): lines that match a pattern go."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")
    kept = F.filter(lines, lambda x: ~boilerplate_line(x))
    joined = F.btrim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), F.lit(" \t\n\r"))
    return F.struct(joined.alias("text"), (F.size(lines) - F.size(kept)).alias("removed"))


def foreign_entities(text: Column, names=FOREIGN, threshold: int = FOREIGN_KINDS) -> Column:
    found = F.array_sort(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.coalesce(text, F.lit("")), n)))
    return F.when(F.size(found) >= threshold, found).otherwise(F.array().cast("array<string>"))


def gate_reason(title: Column, cleaned: Column, names=FOREIGN) -> Column:
    """The first gate that refuses a cleaned page: short, qr, account, download, density, title, foreign; empty if none does."""
    rules = [F.when(F.length(cleaned) < MIN_CHARS, "short")]
    rules += [F.when(F.regexp_count(cleaned, F.lit(p)) >= n, name) for name, p, n in PAGE_NOISE]
    rules.append(F.when((tables.density(cleaned) < TABLE_DENSITY) & (tx.info_density(cleaned) < MIN_DENSITY), "density"))
    bare_title, bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", ""), F.regexp_replace(cleaned, r"\s+", "")
    rules.append(F.when(bare_title.rlike(LOW_VALUE_TITLES) & (tx.occurrences(bare, bare_title) >= 3), "title"))
    hits = lambda found: F.aggregate(found, F.lit(0), lambda s, n: s + tx.occurrences(cleaned, n))
    much = lambda found: (F.size(found) > 0) & (hits(found) / F.greatest(F.length(cleaned), F.lit(1)) >= FOREIGN_SHARE)
    rules.append(F.when(tx.let(foreign_entities(cleaned, names), much), "foreign"))
    return F.coalesce(*rules, F.lit(""))


def validate_page(df, title: str, text: str):
    """df with cleaned_text, removed_lines, info_density, reason and ok."""
    # a generator of one row: the text is stripped once, not at each place that reads it
    df = df.withColumn("_s", F.explode(F.array(strip_boilerplate(F.col(text)))))
    df = df.withColumns({"cleaned_text": F.col("_s.text"), "removed_lines": F.col("_s.removed")}).drop("_s")
    df = df.withColumns({"info_density": F.round(tx.info_density(F.col("cleaned_text")), 3), "reason": gate_reason(F.col(title), F.col("cleaned_text"))})
    return df.withColumn("ok", F.col("reason") == "")


def theme_terms(topics: Column, min_chars: int = 2) -> Column:
    """Words that all topics share."""
    words = F.transform(topics, lambda t: F.filter(F.split(t, r"[\s　,，、;；|/\\+]+"), lambda w: F.length(w) >= min_chars))
    words = F.filter(words, lambda w: F.size(w) > 0)
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.aggregate(words, F.get(words, 0), lambda a, b: F.array_intersect(a, b))))


def theme_mismatch(title: Column, text: Column, terms: Column) -> Column:
    whole = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    return (F.size(terms) > 0) & ~F.exists(terms, lambda t: F.contains(whole, t))


def panel_block(text: Column, start: str, end: str) -> Column:
    """What stands between two marks; empty without the end."""
    a = F.instr(text, start)
    rest = F.substr(text, a + len(start))
    b = F.instr(rest, end)
    return F.when((a > 0) & (b > 0), F.substr(rest, F.lit(1), b - 1)).otherwise("")


def meta_title(title: Column, pattern: str = r"^(?i:(user|talk|template|category|help|file|module|mediawiki|special):.*|首页|.*/doc)$") -> Column:
    """Maintenance pages; a page without title is one."""
    own = F.btrim(F.coalesce(title, F.lit("")))
    return (own == "") | own.rlike(pattern)


def any_of(columns) -> Column:
    return reduce(lambda a, b: a | b, columns)
