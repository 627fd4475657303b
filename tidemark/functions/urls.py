"""URL, host and source rules as columns. Malformed URLs give an empty host, never an error."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import types as ty

# Hosts and paths of the source rules.
DICTIONARY_HOSTS = ("hanyuguoxue.com", "hgcha.com", "zdic.net", "hanyu.baidu.com", "chazidian.com", "cidianwang.com", "guoxuedashi.net")
VIDEO_HOSTS = ("b23.tv", "youtu.be", "v.douyin.com", "ixigua.com")
VIDEO_PATHS = (
    ("bilibili.com", ("/video/",)),
    ("youtube.com", ("/watch", "/shorts")),
    ("douyin.com", ("/video/",)),
    ("v.qq.com", ("/x/",)),
    ("youku.com", ("/v_show",)),
    ("iqiyi.com", ("/v_",)),
    ("acfun.cn", ("/v/",)),
    ("twitch.tv", ("/videos",)),
    ("kuaishou.com", ("/short-video",)),
)
TIERS = {"official": 3, "manual": 3, "wiki": 2}
SEARCH_ORDER = {"official": 0, "wiki": 1, "community": 2}

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]*)(?::[0-9]*)?(?:[/?#]|$)"
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host_of(url: Column) -> Column:
    """The lower-case host, or nothing."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1))


def domain_of(url: Column) -> Column:
    """The host without www.; a URL without scheme counts too."""
    text = F.btrim(F.coalesce(url, F.lit("")))
    return F.regexp_replace(host_of(F.when(text.contains("://"), text).otherwise(F.concat(F.lit("//"), text))), r"^www\.", "")


def raw_netloc(url: Column) -> Column:
    """Host with port and www., of http and https only."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://([^/]+)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 3)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 4)


def page_key(url: Column) -> Column:
    """Without fragment and trailing slashes, lower case."""
    return F.lower(F.regexp_replace(F.split(F.coalesce(url, F.lit("")), "#")[0], "/+$", ""))


@F.pandas_udf(ty.STRING)
def percent_decode(paths: pd.Series) -> pd.Series:
    """%XX as UTF-8; a plus sign stays."""
    from urllib.parse import unquote

    return paths.map(lambda p: unquote(p) if p and "%" in p else p)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, path decoded, without query, fragment and trailing slashes."""
    text = F.btrim(F.coalesce(url, F.lit("")))
    scheme, netloc = F.lower(F.regexp_extract(text, _PARTS, 1)), F.lower(F.regexp_extract(text, _PARTS, 2))
    path = F.regexp_replace(percent_decode(path_of(text)), r"(?<=.)/+$", "")
    return F.when(scheme == "", F.regexp_replace(F.lower(text), "/+$", "")).otherwise(F.concat(scheme, F.lit("://"), netloc, path))


def source_key(url: Column) -> Column:
    """Host, port, decoded path and the query's parts in order: equal for URLs of one source."""
    query = F.array_join(F.array_sort(F.filter(F.split(query_of(url), "&"), lambda x: x != "")), "&")
    port = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]+://[^/?#]*:([0-9]+)", 1)
    usual = F.when(port.isin("80", "443"), F.lit("")).otherwise(port)
    path = F.regexp_replace(percent_decode(path_of(url)), "/+$", "")
    return F.concat_ws("|", host_of(url), usual, path, query)


def host_matches(host: Column, domain: Column | str) -> Column:
    """The domain itself or one below it."""
    domain = F.regexp_replace(F.lower(F.btrim(F.lit(domain) if isinstance(domain, str) else domain)), r"^\.+", "")
    return (host != "") & (domain != "") & ((host == domain) | host.endswith(F.concat(F.lit("."), domain)))


def any_host(host: Column, domains: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [host_matches(host, d) for d in domains], F.lit(False))


def is_video(url: Column) -> Column:
    host, path, query = host_of(url), F.lower(path_of(url)), F.lower(query_of(url))
    hinted = [host_matches(host, d) & reduce(lambda a, b: a | b, [path.contains(h) | query.contains(h) for h in hints]) for d, hints in VIDEO_PATHS]
    return any_host(host, VIDEO_HOSTS) | reduce(lambda a, b: a | b, hinted)


def baseline_block(url: Column, paused: Column | None = None) -> Column:
    """Why the built-in rules refuse a URL; empty if they don't."""
    host = host_of(url)
    rules = [F.when(host_matches(host, d), F.lit(f"dictionary:{d}")) for d in DICTIONARY_HOSTS]
    first = [F.when(paused, F.lit("paused"))] if paused is not None else []
    return F.coalesce(*first, *rules, F.when(is_video(url), F.lit("video")), F.lit(""))


def normalize_domains(values: Column) -> Column:
    """A user's list of hosts or URLs as distinct hosts in order; entries that begin with # are remarks."""
    items = F.filter(F.transform(values, lambda v: F.lower(F.btrim(F.coalesce(v, F.lit(""))))), lambda v: (v != "") & ~v.startswith("#"))
    bare = F.transform(items, lambda v: F.regexp_replace(F.regexp_extract(F.regexp_replace(v, r"^[a-z]+://", ""), r"^([^/?#]*)", 1), r"^.*@", ""))
    hosts = F.transform(bare, lambda v: F.regexp_replace(F.split(v, ":")[0], r"^www\.", ""))
    return F.array_distinct(F.filter(hosts, lambda v: v != ""))


def classify_source(url: Column, official: Sequence[str], wiki: Sequence[str]) -> Column:
    host = host_of(url)
    return F.when(host == "", "community").when(any_host(host, official), "official").when(any_host(host, wiki) | host.contains("wiki"), "wiki").otherwise("community")


def source_tier(source_type: Column) -> Column:
    return F.when(source_type.isin("official", "manual"), 3).when(source_type == "wiki", 2).otherwise(1)


def url_date(url: Column) -> Column:
    """The /YYYYMMDD/ of a URL as a date string, if the calendar has that day in a leap year."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"/(20[0-9]{2}[0-9]{2}[0-9]{2})(?:[/_]|$)", 1)
    day = F.concat_ws("-", F.substring(found, 1, 4), F.substring(found, 5, 2), F.substring(found, 7, 2))
    leap = F.try_to_date(F.concat(F.lit("2000"), F.substring(day, 5, 6)), "yyyy-MM-dd")
    return F.when((found != "") & leap.isNotNull(), day).otherwise("")


def is_private(host: Column) -> Column:
    """Loopback, private and link-local addresses, and local names."""
    host = F.regexp_replace(F.lower(host), r"^\[|\]$", "")
    v4 = host.rlike(r"^(127|10|0)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.")
    return (host == "localhost") | host.endswith(".localhost") | host.endswith(".local") | v4 | host.rlike(r"^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|::ffff:(127|10)\.)")
