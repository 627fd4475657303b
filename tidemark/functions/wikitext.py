"""Wikitext templates: balanced braces need a scan, done in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import types as ty

VALUE_CHARS = 400
_MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
_COMMENT, _REF, _TAG = re.compile(r"<!--.*?-->", re.S), re.compile(r"<ref\b[^>]*?/>|<ref\b[^>]*>.*?</ref>", re.S | re.I), re.compile(r"<[^>]+>")
_LINK, _EXTERNAL = re.compile(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]"), re.compile(r"\[(https?://\S+)\s+([^\]]+)\]")


def split_top(body: str, sep: str = "|") -> list[str]:
    """Parts between separators that stand in no template or link."""
    out, start, braces, links = [], 0, 0, 0
    for m in _MARK.finditer(body):
        mark = m[0]
        if mark == sep and not braces and not links:
            out.append(body[start : m.start()])
            start = m.end()
        braces = max(0, braces + (mark == "{{") - (mark == "}}"))
        links = max(0, links + (mark == "[[") - (mark == "]]"))
    return [*out, body[start:]]


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of all balanced templates, outer ones before those inside."""
    stack, out = [], []
    for m in re.finditer(r"\{\{|\}\}", text):
        if m[0] == "{{":
            stack.append(m.start())
        elif stack:
            out.append((stack.pop(), m.end()))
    return sorted(out)


def expand(value: str, rounds: int = 3) -> str:
    """Templates within a value become their first positional part; three at most."""
    for _ in range(rounds):
        at = value.find("{{")
        if at < 0:
            break
        end = next((b for a, b in spans(value) if a == at), -1)
        if end < 0:
            return value[:at]
        parts = [p.strip() for p in split_top(value[at + 2 : end - 2]) if p.strip()]
        plain = [p for p in (parts[1:] or parts) if "=" not in p]
        value = value[:at] + (plain or parts or [""])[0] + value[end:]
    return value


def clean(value: str | None) -> str:
    """Text without comments, references, templates, links, tags and bold marks; a line break is a full-width semicolon."""
    text = _REF.sub("", _COMMENT.sub("", value or ""))
    text = _EXTERNAL.sub(r"\2（\1）", _LINK.sub(r"\1", expand(text)))
    text = _TAG.sub("", re.sub(r"<br\s*/?>", "；", text, flags=re.I))
    text = re.sub(r"[ \t]+", " ", re.sub(r"'{2,}", "", text))
    return re.sub(r"^\s*[|!]\s*", "", re.sub(r"\n{2,}", "\n", text)).strip(" \t|\n")


def name_of(value: str) -> str:
    return " ".join(clean(value).split())


def templates(text: str | None) -> list[dict]:
    body = _COMMENT.sub("", text or "")
    out = []
    for a, b in spans(body):
        head, *parts = split_top(body[a + 2 : b - 2])
        fields, positional = [], []
        for part in parts:
            key, eq, value = part.partition("=")
            if eq and name_of(key):
                fields.append({"k": name_of(key), "v": clean(value)})
            elif clean(part):
                positional.append(clean(part))
        out.append({"name": name_of(head), "fields": fields, "positional": positional})
    return out


@F.pandas_udf(ty.STRING)
def wikitext_clean(values: pd.Series) -> pd.Series:
    return values.map(clean)


@F.pandas_udf(T.ArrayType(ty.struct(name=ty.STRING, fields=T.ArrayType(ty.struct(k=ty.STRING, v=ty.STRING)), positional=ty.STRINGS)))
def iter_templates(texts: pd.Series) -> pd.Series:
    return texts.map(templates)


def template_fields(pages: DataFrame, key: str, text: str, wanted: list[str] | None = None, skip: list[str] = ()) -> DataFrame:
    """key, position, field and value: a field's longest value at its first place."""
    found = pages.select(key, F.posexplode(iter_templates(F.col(text))).alias("_i", "_t"))
    found = found.filter((F.col("_t.name") != "") & ~F.col("_t.name").rlike("^[#!]"))
    found = found.filter(F.col("_t.name").isin(*wanted)) if wanted else found.filter(~F.contains("_t.name", F.lit(":")))
    rows = found.select(key, "_i", F.posexplode("_t.fields").alias("_j", "_f")).filter("_f.v <> ''")
    rows = rows.filter(~F.col("_f.k").isin(*skip)) if skip else rows
    place = F.struct("_i", "_j")
    out = rows.groupBy(key, F.col("_f.k").alias("field")).agg(F.min(place).alias("position"), F.max_by(F.col("_f.v"), F.struct(F.length("_f.v"), (-F.col("_i")).alias("a"), (-F.col("_j")).alias("b"))).alias("value"))
    return out.withColumn("value", F.substring("value", 1, VALUE_CHARS))


def api_facts(fields: DataFrame, entity: str, field: str, value: str, source: str) -> DataFrame:
    """A fact entity·field for each value of two characters or more that isn't the title itself."""
    bare = F.btrim(F.btrim(F.col(value)), F.lit("\"'「」『』《》〈〉（）() 　"))
    on = fields.filter((F.length(value) >= 2) & (bare != F.btrim(F.col(entity))))
    answer = F.concat(F.col(entity), F.lit(" 的"), F.col(field), F.lit("为："), F.col(value))
    return on.withColumns({"title": F.substring(F.concat(F.col(entity), F.lit("·"), F.col(field)), 1, 40), "answer": F.when(F.length(answer) > VALUE_CHARS, F.concat(F.substring(answer, 1, VALUE_CHARS), F.lit("…"))).otherwise(answer), "tags": F.concat_ws(", ", F.col(field), F.lit(source), F.lit("结构化字段"))})


def tautology(value: Column, title: Column) -> Column:
    bare = F.btrim(F.btrim(F.btrim(value), F.lit("\"'「」『』《》〈〉（）() 　")))
    return (bare != "") & (bare == F.btrim(title))


def page_text(title: Column, pairs: Column, source: Column) -> Column:
    head = F.concat(title, F.lit("（结构化字段，来自 "), source, F.lit("）"))
    return F.array_join(F.concat(F.array(head), F.transform(pairs, lambda p: F.concat(p["k"], F.lit("："), p["v"]))), "\n")


def json_repair(text: Column) -> Column:
    r"""A \u that four hex digits don't follow becomes a literal backslash and u."""
    return F.regexp_replace(text, r"\\u(?![0-9a-fA-F]{4})", r"\\\\u")


@F.pandas_udf(ty.STRING)
def llm_json(texts: pd.Series) -> pd.Series:
    """The first JSON object or array of a model's reply, fenced or not, in one spelling; null without."""

    def one(text: str | None) -> str | None:
        text = re.sub(r"```(?:json)?", "", text or "")
        decoder = json.JSONDecoder()
        for m in re.finditer(r"[\[{]", text):
            try:
                return json.dumps(decoder.raw_decode(text, m.start())[0], ensure_ascii=False, sort_keys=True)
            except ValueError:
                continue
        return None

    return texts.map(one)
