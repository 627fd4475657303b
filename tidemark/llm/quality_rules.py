"""Quality rules (op 9): a threshold table compiled into one projection of built-in functions.

``RULES`` is the table. ``judge`` adds what the rules compare and the verdict, ``keep`` drops what they
reject; neither shuffles, so a text is read once, where it lies. Words are longest runs outside space and \\t-\\r.

Edge cases: a null or empty text has no words, so that it fails ``n_words``. Null ids, sources and languages don't
matter. Rows are judged one by one: repeated rows get the same verdict. Columns of the input, of any names, keep their
values; only what ``judge`` adds, listed in ``ADDED``, replaces input columns of the same names. An empty table gives an
empty one. A text of any length is one row's arrays, sorted and never compared in pairs.
Windows of eight words are told apart by two 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by this at from or an "
    "der die das und in den von zu mit sich des ist im dem ein eine für auf nicht als auch "
    "de la le les et des un une du en que qui dans pour est par sur au avec pas "
    "el los las y del se una por con para su al lo como más no es"
).split()

SPACE = r"[ \t-\r]+"
WINDOW = 8

#: Name, what is compared, how, with what: a row that meets one of these is rejected.
RULES = (
    ("n_words", "n_words", "<", 20),
    ("repeated", "repeat_ratio", ">", 0.30),
    ("symbols", "symbol_ratio", ">", 0.25),
    ("short_words", "mean_word_chars", "<", 2.0),
    ("long_words", "mean_word_chars", ">", 20.0),
    ("stop_words", "stop_ratio", "<", 0.005),
    ("same_lines", "dup_line_ratio", ">", 0.60),
)
#: The two rules that hold whatever the table says.
BASE = ("n_words", "repeated")
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept", "failed")


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _repeat_words(df: DataFrame, words: str, out: str, window: int) -> DataFrame:
    """Words in windows found twice or more in the row: sort the windows that aren't alone, then add up their cover."""
    n = F.size(words)
    starts = F.when(n >= window, F.sequence(F.lit(0), n - F.lit(window))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_w", F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, window))))
    alone = F.size(F.array_distinct("_w")) == F.size("_w")
    keyed = F.transform("_w", lambda h, i: F.struct(h.alias("h"), F.xxhash64(F.lit(window), F.slice(words, i + 1, window)).alias("g"), i.alias("i")))
    empty = F.array().cast("array<struct<h:bigint,g:bigint,i:int>>")
    df = df.withColumn("_s", F.when(alone, empty).otherwise(F.array_sort(keyed)))
    same = lambda a, b: (a["h"] == b["h"]) & (a["g"] == b["g"])
    near = lambda e, j: F.coalesce(same(e, F.get("_s", j)), F.lit(False))
    df = df.withColumn("_p", F.array_sort(F.transform(F.filter("_s", lambda e, i: near(e, i - 1) | near(e, i + 1)), lambda e: e["i"])))
    zero = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).alias("e"))
    step = lambda a, p: F.struct((a["c"] + p + window - F.greatest(p, a["e"])).alias("c"), (p + window).alias("e"))
    return df.withColumn(out, F.aggregate("_p", zero, step)["c"]).drop("_w", "_s", "_p")


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """_row, the input's columns as a struct, out of the way of all names here, and _counts, what the rules need."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    own = F.coalesce("_text", F.lit(""))
    stops = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    lines = F.filter(F.split(own, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    df = docs.select(row, F.col(f"`{text}`").alias("_text")).withColumn("_words", split_words(F.col("_text"))).withColumn("_lines", lines)
    df = _repeat_words(df, "_words", "_repeated", WINDOW)
    counts = {
        "n_repeat_words": F.col("_repeated"),
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(own, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(stops))).cast("long"),
    }
    # a generator of one row: a filter on the counts would else be moved below the steps above, each step's expression
    # written out at every place that reads it
    return df.select("_row", F.struct(*[x.alias(c) for c, x in counts.items()]).alias("_counts")).select("_row", F.explode_outer(F.array("_counts")).alias("_counts"))


def _compare(value: Column, how: str, limit: float) -> Column:
    return {"<": value < limit, ">": value > limit}[how]


def _judged(docs: DataFrame, text: str, rules) -> DataFrame:
    """_row, _counts, and _verdict with base_failed, kept and failed."""
    df = _measured(docs, text)
    count = lambda c: F.col(f"_counts.{c}")
    n = F.greatest(count("n_words"), F.lit(1))
    ratio = {
        "n_words": count("n_words"),
        "repeat_ratio": count("n_repeat_words") / n,
        "symbol_ratio": count("n_symbols") / n,
        "mean_word_chars": count("word_chars") / n,
        "stop_ratio": count("n_stop_words") / n,
        "dup_line_ratio": count("n_dup_lines") / F.greatest(count("n_lines"), F.lit(1)),
    }
    met = {name: _compare(ratio[what], how, limit) for name, what, how, limit in rules}
    base = (count("n_words") < 20) | (100 * count("n_repeat_words") > 30 * count("n_words"))
    rejected = reduce(lambda a, b: a | b, met.values(), base)
    failed = F.array_compact(F.array(*[F.when(x, F.lit(name)) for name, x in met.items()]))
    return df.withColumn("_verdict", F.struct(base.alias("base_failed"), (~rejected).alias("kept"), F.concat_ws(",", failed).alias("failed")))


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with the columns of ``ADDED``: counts, ``base_failed``, ``kept``, and ``failed``, the names of the rules that a row meets."""
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in ADDED]
    added = [F.col(f"{'_verdict' if c in ('base_failed', 'kept', 'failed') else '_counts'}.{c}") for c in ADDED]
    return _judged(docs, text, rules).select(*kept, *added)


def keep(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs, names and values."""
    return _judged(docs, text, rules).filter("_verdict.kept").select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", *ADDED)


_STOPS = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)}))
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT rid, unnest(range(0, greatest(len(w) - 7, 0))) AS p, w FROM d),
k AS (SELECT rid, p, array_to_string(w[p + 1 : p + 8], ' ') AS x FROM g),
r AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, x) AS c FROM k),
cover AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 8)) AS q FROM r WHERE c > 1) GROUP BY rid),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: x IN ({_STOPS}))) AS BIGINT) AS n_stop_words
  FROM d LEFT JOIN cover USING (rid)),
m AS (
  SELECT *, greatest(n_words, 1) AS n, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
v AS (
  SELECT *, concat_ws(',', CASE WHEN n_words < 20 THEN 'n_words' END, CASE WHEN n_repeat_words / n > 0.30 THEN 'repeated' END,
    CASE WHEN n_symbols / n > 0.25 THEN 'symbols' END, CASE WHEN word_chars / n < 2.0 THEN 'short_words' END,
    CASE WHEN word_chars / n > 20.0 THEN 'long_words' END, CASE WHEN n_stop_words / n < 0.005 THEN 'stop_words' END,
    CASE WHEN n_dup_lines / greatest(n_lines, 1) > 0.60 THEN 'same_lines' END) AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
       failed = '' AND NOT base_failed AS kept, failed FROM v
"""
