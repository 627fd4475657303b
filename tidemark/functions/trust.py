"""Trust of a fact: weighted source, extraction, agreement and freshness, each as a column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import types as ty

# Weights and scores of the trust model.
WEIGHTS = {"source": 0.45, "extraction": 0.25, "consistency": 0.20, "freshness": 0.10}
SOURCE = {"official": 1.0, "manual": 0.95, "wiki": 0.75, "seed": 0.6, "community": 0.5}
EXTRACTION = {"api": 1.0, "table": 0.85, "llm": 0.6, "manual": 0.95}
FRESH = {"recent": 1.0, "year": 0.7, "old": 0.4, "unknown": 0.7, "penalty": 0.7}
TIME_WORDS = "版本|更新|活动|限时|时间|日期|公测|测试|招募|预约|价格|折扣|原价|概率|保底|卡池"


def _score(key: Column, scores: dict[str, float], default: float) -> Column:
    key = F.lower(F.btrim(F.coalesce(key, F.lit(""))))
    out = F.lit(default)
    for name, value in scores.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def time_sensitive(title: Column, answer: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(answer, F.lit("")))
    return text.rlike(f"(?i){TIME_WORDS}|(?<![A-Za-z])up(?![A-Za-z])")


def parse_date(value: Column) -> Column:
    """A timestamp of one of four formats or ISO with an offset; without one it is UTC."""
    text = F.btrim(value)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])


def freshness(published: Column, as_of: Column, sensitive: Column) -> Column:
    """published and as_of are timestamps; what lies ahead counts as new."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(published)
    base = F.when(published.isNull(), FRESH["unknown"]).when(seconds <= 183 * 86400, FRESH["recent"]).when(seconds <= 365 * 86400, FRESH["year"]).otherwise(FRESH["old"])
    return F.round(base * F.when(sensitive, FRESH["penalty"]).otherwise(1.0), 4)


def consistency(sources: Column, conflict: Column) -> Column:
    return F.when(conflict, 0.2).when(F.coalesce(sources, F.lit(1)) >= 2, 1.0).otherwise(0.6)


def trust(source_type: Column, extraction: Column, agreement: Column, fresh: Column, penalty: Column | None = None) -> Column:
    """The weighted sum within 0.05 and 1; a penalty multiplies it."""
    total = WEIGHTS["source"] * _score(source_type, SOURCE, 0.5) + WEIGHTS["extraction"] * _score(extraction, EXTRACTION, 0.6)
    total = total + WEIGHTS["consistency"] * agreement + WEIGHTS["freshness"] * fresh
    clamp = lambda x: F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), x)), 4)
    return clamp(total) if penalty is None else clamp(clamp(total) * penalty)


def trust_tag(source_type: Column, extraction: Column, agreement: Column, fresh: Column) -> Column:
    """The score and its parts as text."""
    name = F.when(F.coalesce(extraction, F.lit("")) == "", "llm").otherwise(extraction)
    parts = (trust(source_type, extraction, agreement, fresh), _score(source_type, SOURCE, 0.5), _score(extraction, EXTRACTION, 0.6), agreement, fresh)
    return _tag(name, *parts)


@F.pandas_udf(ty.STRING)
def _tag(name: pd.Series, *parts: pd.Series) -> pd.Series:
    """Two decimals of the binary value, as C prints them; the JVM rounds the shortest spelling up, 0.595 to 0.60."""
    rows = zip(name, *parts, strict=True)
    return pd.Series([f"提取:{n} 可信度:{a:.2f}(来源{b:.2f}/提取{c:.2f}/一致{d:.2f}/时效{e:.2f})" for n, a, b, c, d, e in rows])
