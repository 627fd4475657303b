"""Text functions as columns: cleaning, tokens, bigrams, numbers.

All but ``normalize`` are built-in expressions, so that they stay in generated code and can be pushed down. Patterns carry
``(?U)`` where Unicode classes are meant, as Java's are ASCII otherwise.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import types as ty

# Character ranges, stop characters, quotes and patterns of the text model.
CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ"
STOP_CHARS = "的了是在和与有也都很就这那你我他她它们个之而及或者对于把被从到用为以等且但如若因所"
TOKEN = rf"([{CJK}]+|[A-Za-z][A-Za-z0-9_+#.\-]*|[0-9]+(?:\.[0-9]+)?%?)"
QUOTED = "[「『“\"'《【]([^」』”\"'》】]{1,40})[」』”\"'》】]"
COMPARE_PUNCT = "[\\s　 ，。、；：！？“”‘’（）【】《》「」『』…—·,.;:!?\"'()\\[\\]<>/\\\\|~`^&*+=_-]+"
DENSITY_PUNCT = "[\\s　，。、；：！？…—－·（）()\\[\\]【】《》<>\"'`,.;:!?\\-_/\\\\|~@#$%^&*+=]+"
FULL_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
VALUE_PREFIX = r"^\s*.{1,14}?的.{1,12}?为[：:]\s*"
#: White space of Unicode.
WHITE = "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SIGNED_NUMBER = r"(-?[0-9]+(?:[.,][0-9]+)*)"
_TOKEN, _CJK = re.compile(TOKEN), re.compile(f"[{CJK}]")


@F.pandas_udf(ty.STRING)
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC form; ASCII texts are returned as they are."""
    import unicodedata

    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def squash(text: Column) -> Column:
    """The part of ``normalize`` after NFKC: spaces, case, blank lines. Patterns run only on texts that have what they change."""
    spaces = lambda t: F.when(reduce(or_, (F.contains(t, F.lit(x)) for x in ("  ", "\t", "\f", "\v"))), F.regexp_replace(t, r"[ \t\f\x0B]+", " ")).otherwise(t)
    lines = lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(spaces(t), r"\n{3,}", "\n\n")).otherwise(spaces(t))
    plain = F.replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), F.lit("\u3000"), F.lit(" "))
    return let(F.lower(plain), lambda t: F.btrim(lines(t), F.lit(WHITE)))


def normalize(text: Column) -> Column:
    """NFKC, one kind of space, lower case, at most one blank line. Null is empty."""
    return squash(nfkc(F.coalesce(text, F.lit(""))))


def tidy(text: Column) -> Column:
    """Line ends to \\n, runs of spaces to one, three or more \\n to two, each line trimmed."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t ]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.btrim(F.array_join(F.transform(F.split(out, "\n"), lambda x: F.btrim(x)), "\n"), F.lit(" \n"))


def clean_inline(text: Column) -> Column:
    """Tags of up to 200 characters out, four entities decoded, white space squashed."""
    out = F.regexp_replace(text, r"<[^>]{1,200}>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(out, r"\s+", " "))


def snippet(text: Column) -> Column:
    """A search result's text without tags; three entities."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"')):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(out, r"\s+", " "))


def summarize(text: Column, limit: int = 160) -> Column:
    clean = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.substring(clean, 1, limit - 1), F.lit("…")))


def let(value: Column, use) -> Column:
    """use(value), with value computed once: in a lambda of ``use`` it would be computed for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def pairs_of(text: Column) -> Column:
    """Two-character pieces in order; a single character is its own piece."""
    pairs = lambda c: F.transform(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(1))), lambda x, i: F.concat(x, F.coalesce(F.get(c, i + 1), F.lit(""))))
    return let(text, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(let(F.split(t, ""), pairs)))


def tokenize(normalized: Column) -> Column:
    """Index tokens of a normalised text: bigrams of CJK runs, words, numbers."""
    pieces = F.regexp_extract_all(normalized, F.lit(TOKEN), 1)
    cut = F.flatten(F.transform(pieces, lambda p: F.when(p.rlike(f"^[{CJK}]"), pairs_of(p)).otherwise(F.array(p))))
    wide = (F.octet_length(normalized) > F.char_length(normalized)) & normalized.rlike(f"[{CJK}]")
    return F.when(wide, cut).otherwise(pieces)  # the lambda costs as much as the pattern


def tokens_of(normalized: str | None) -> list[str]:
    """``tokenize`` on a Python string."""
    text = normalized or ""
    pieces = _TOKEN.findall(text)
    if text.isascii() or not _CJK.search(text):
        return pieces
    out = []
    for piece in pieces:
        cjk = len(piece) > 1 and _CJK.match(piece)
        out += [piece[i : i + 2] for i in range(len(piece) - 1)] if cjk else [piece]
    return out


def is_noise(token: Column) -> Column:
    """Both of two characters are stop characters."""
    return token.rlike(f"^[{STOP_CHARS}]{{2}}$")


def quoted_terms(normalized: Column) -> Column:
    """Tokens of what stands in quotes."""
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(normalized, F.lit(QUOTED), 1), tokenize)))


def tokenize_query(normalized: Column) -> Column:
    """Distinct tokens in order, without noise that isn't quoted."""
    quoted = quoted_terms(normalized)
    return F.array_distinct(F.filter(tokenize(normalized), lambda t: ~is_noise(t) | F.array_contains(quoted, t)))


def match_expression(tokens: Column) -> Column:
    """Quoted tokens joined by OR, as a full-text MATCH string."""
    safe = F.filter(F.transform(tokens, lambda t: F.replace(t, F.lit('"'), F.lit(""))), lambda t: t != "")
    return F.array_join(F.transform(safe, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def hard_split(text: Column, size: int) -> Column:
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size))
    return F.when(n > 0, F.transform(starts, lambda i: F.substring(text, i, size))).otherwise(F.array().cast("array<string>"))


def comparable(text: Column) -> Column:
    """Without white space and punctuation, full-width digits as ASCII, lower case."""
    return F.lower(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), FULL_DIGITS, DIGITS), COMPARE_PUNCT, ""))


def bigrams(text: Column) -> Column:
    return F.array_distinct(pairs_of(text))


def _dice(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(F.round(2 * both / (F.size(a) + F.size(b)), 4))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the bigram sets of two texts; of two empty ones 1."""
    return _dice(bigrams(comparable(a)), bigrams(comparable(b)))


def containment(a: Column, b: Column) -> Column:
    """Share of the shorter text's bigrams that the other has."""
    x, y = comparable(a), comparable(b)
    small = bigrams(F.when(F.length(x) <= F.length(y), x).otherwise(y))
    large = bigrams(F.when(F.length(x) <= F.length(y), y).otherwise(x))
    return F.when((F.size(small) == 0) | (F.size(large) == 0), 0.0).otherwise(F.round(F.size(F.array_intersect(small, large)) / F.size(small), 4))


def _trim_zeros(n: Column) -> Column:
    return F.when(n.contains("."), F.regexp_replace(F.regexp_replace(n, "0+$", ""), r"\.$", "")).otherwise(n)


def numbers_in(text: Column) -> Column:
    """Numbers after all commas are gone, without trailing decimal zeros; repeats stay."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit(""))
    return F.transform(F.regexp_extract_all(plain, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1), _trim_zeros)


def numbers_signed(text: Column) -> Column:
    """Distinct signed numbers in order, thousands marks gone."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SIGNED_NUMBER), 1)
    clean = F.transform(raw, lambda n: _trim_zeros(F.replace(n, F.lit(","), F.lit(""))))
    return F.array_distinct(F.transform(clean, lambda n: F.when(n == "", "0").otherwise(n)))


def gap_numbers(text: Column) -> Column:
    """Numbers where a comma goes only between digits."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[0-9]),(?=[0-9])", "")
    return F.array_distinct(F.transform(F.regexp_extract_all(joined, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1), _trim_zeros))


def signature(numbers: Column) -> Column:
    """Numbers by length and text, joined by a bar."""
    keyed = F.array_sort(F.transform(numbers, lambda n: F.named_struct(F.lit("size"), F.length(n), F.lit("n"), n)))
    return F.array_join(F.transform(keyed, lambda x: x["n"]), "|")


def value_body(text: Column) -> Column:
    """Without the leading 'X's field is:'."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, VALUE_PREFIX, ""), r"(?U)^\s+|\s+$", "")


def value_like(text: Column, max_chars: int = 40, min_digits: int = 2, max_rest: int = 6) -> Column:
    """Short, with a number of two digits or more, and little else."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    found = numbers_signed(body)
    digits = F.exists(found, lambda n: F.length(F.regexp_replace(n, r"[.\-]", "")) >= min_digits)
    rest = F.regexp_replace(F.regexp_replace(value_body(body), SIGNED_NUMBER, ""), r"(?U)[\W_]+", "")
    return (F.length(body).between(1, max_chars)) & digits & (F.length(rest) <= max_rest)


def merge_answers(old: Column, new: Column) -> Column:
    """Both answers' sentences, without those of the new one that the old one has."""
    old, new = F.btrim(F.coalesce(old, F.lit(""))), F.btrim(F.coalesce(new, F.lit("")))
    a, b = comparable(old), comparable(new)
    parts = lambda t: F.filter(F.transform(F.split(t, "[。；\n]"), lambda p: F.btrim(p)), lambda p: p != "")
    extra = F.filter(parts(new), lambda p: ~F.contains(a, comparable(p)))
    longer = F.when(F.length(a) >= F.length(b), old).otherwise(new)
    return (
        F.when(old == "", new)
        .when(new == "", old)
        .when(F.contains(a, b), old)
        .when(F.contains(b, a), new)
        .when(containment(old, new) >= 0.9, longer)
        .when(F.size(extra) == 0, old)
        .otherwise(F.array_join(F.concat(parts(old), extra), "；"))
    )


def info_density(text: Column) -> Column:
    """Share of characters that aren't white space or punctuation."""
    text = F.coalesce(text, F.lit(""))
    return F.length(F.regexp_replace(text, DENSITY_PUNCT, "")) / F.greatest(F.length(text), F.lit(1))


def occurrences(text: Column, part: Column) -> Column:
    """How often part stands in text, without overlap."""
    n = F.length(part)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / n).cast("int")).otherwise(0)


def strip_template(text: Column, limit: int = 24) -> Column:
    """What follows a short prefix that ends in a full-width colon."""
    at = F.instr(text, "：")
    return F.when(at.between(1, limit), F.btrim(F.substr(text, at + 1))).otherwise(text)


def ensure_tag(tags: Column, tag: Column, sep: str = " | ") -> Column:
    """tags with tag, unless an entry equals it or begins with it and a colon."""
    tags = F.coalesce(tags, F.lit(""))
    entries = F.transform(F.split(tags, r"\|"), lambda x: F.btrim(x))
    there = F.exists(entries, lambda x: (x == tag) | x.startswith(F.concat(tag, F.lit(":"))))
    return F.when(there, tags).when(F.btrim(tags) == "", tag).otherwise(F.concat(tags, F.lit(sep), tag))


def ensure_extra_tag(tags: Column, tag: Column, sep: str = " | ") -> Column:
    """tags with tag, unless it is part of them."""
    tags = F.coalesce(tags, F.lit(""))
    return F.when(F.contains(tags, tag), tags).when(F.btrim(tags) == "", tag).otherwise(F.concat(tags, F.lit(sep), tag))
