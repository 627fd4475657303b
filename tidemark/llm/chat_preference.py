"""Preference formatting (op 1): chosen and rejected conversations become a prompt and two masked completions.

``format_pairs`` takes rows with two turn lists. Their longest common prefix of turns is rendered once as the prompt; what
follows on each side is a completion. A completion's mask tells which of its characters are trained on: those of assistant
turns, not their headers. It is written as ``length:flag`` runs, joined by commas. Only built-in functions are used.

``pair_conversations`` makes such rows where a table has no judgements: conversations 2i and 2i + 1 form pair i; chosen is
the one with more assistant characters, of equal ones the smaller id. Each conversation is in one pair, whatever it
shares with others, so a common conversation or first turn makes no group. One shuffle, by pair, carries the turns.

A pair's turns are one row, as a rendered prompt is: a conversation must fit a task's memory, however many there are.

Edge cases: other columns of the pairs, of whatever names, stay, but for those that the result has itself, which it replaces; turns are ordered by turn, role and text, nulls first, so ties and repeated rows have one order; a null text
or role is empty; rows without conv_id belong to no conversation and are left out. A pair with one conversation has
an empty rejected side; it and a pair whose sides are equal are returned with ``usable`` false. Two conversations without
common turns have an empty prompt. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import spare

HEAD, TAIL = "<|{}|>\n", "<|end|>\n"
_TURNS = "array<struct<role:string,text:string>>"


def common_turns(a: Column, b: Column) -> Column:
    """How many turns both lists begin with."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x), x["text"], F.lit(TAIL))), "")


def mask(turns: Column) -> Column:
    """Runs of the rendered text: an assistant turn's text and end mark count, all else doesn't."""
    runs = F.transform(
        turns,
        lambda x: F.when(
            x["role"] == "assistant",
            F.concat(F.length(_head(x)).cast("string"), F.lit(":0,"), (F.length(x["text"]) + len(TAIL)).cast("string"), F.lit(":1")),
        ).otherwise(F.concat((F.length(_head(x)) + F.length(x["text"]) + len(TAIL)).cast("string"), F.lit(":0"))),
    )
    return F.array_join(runs, ",")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with prompt, n_common, chosen and rejected completion, their masks, and usable, in place of the turn lists and of columns of these names."""
    n, c, r = spare(pairs.columns, "_n", "_c", "_r")
    rest = lambda turns: F.slice(turns, F.col(n) + 1, F.greatest(F.size(turns) - F.col(n), F.lit(0)))
    df = pairs.withColumn(n, common_turns(F.col(chosen), F.col(rejected))).withColumns({c: rest(chosen), r: rest(rejected)})
    made = {
        "n_common": F.col(n),
        "prompt": render(F.slice(chosen, F.lit(1), F.col(n))),
        "chosen_completion": render(F.col(c)),
        "chosen_mask": mask(F.col(c)),
        "rejected_completion": render(F.col(r)),
        "rejected_mask": mask(F.col(r)),
        "usable": (F.size(rejected) > 0) & (F.size(chosen) > 0) & ((F.size(c) > 0) | (F.size(r) > 0)),
    }
    gone = {x.lower() for x in (chosen, rejected, *made)}
    return df.select(*[F.col(f"`{x}`") for x in pairs.columns if x.lower() not in gone], *[v.alias(k) for k, v in made.items()])


def pair_conversations(turns: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id, chosen and rejected of a table with conv_id, turn, role and text."""
    empty = F.lit("")
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
        F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("n"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("x"),
    )
    df = rows.groupBy("pair_id").agg(F.array_sort(F.collect_list("x"), _order).alias("x"))
    first, second = F.col("pair_id") * 2, F.col("pair_id") * 2 + 1
    side = lambda k: F.filter("x", lambda e: e["c"] == k)
    weight = lambda s: F.aggregate(s, F.lit(0).cast("long"), lambda a, e: a + F.when(e["role"] == "assistant", F.length(e["text"])).otherwise(0))
    df = df.withColumns({"_a": side(first), "_b": side(second)})
    df = df.withColumn("_swap", (F.size("_a") == 0) | ((F.size("_b") > 0) & (weight(F.col("_b")) > weight(F.col("_a")))))
    bare = lambda s: F.transform(s, lambda e: F.struct(e["role"].alias("role"), e["text"].alias("text")))
    one, other = F.when(F.col("_swap"), second).otherwise(first), F.when(F.col("_swap"), first).otherwise(second)
    both = (F.size("_a") > 0) & (F.size("_b") > 0)
    return df.select(
        "pair_id",
        one.alias("chosen_id"),
        F.when(both, other).alias("rejected_id"),
        bare(F.when(F.col("_swap"), F.col("_b")).otherwise(F.col("_a"))).cast(_TURNS).alias("chosen"),
        bare(F.when(F.col("_swap"), F.col("_a")).otherwise(F.col("_b"))).cast(_TURNS).alias("rejected"),
    )


def _order(a: Column, b: Column) -> Column:
    """By conversation, turn (null first), role and text."""
    key = lambda e: F.struct(e["c"], e["n"], e["role"], e["text"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def query(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return format_pairs(pair_conversations(turns))


SQL = """
WITH t AS (SELECT conv_id AS c, conv_id // 2 AS pair_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT c, pair_id, count(*) AS n, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS weight FROM t GROUP BY ALL),
p AS (SELECT pair_id, arg_max(c, (weight, -c)) AS chosen_id, CASE WHEN count(*) = 2 THEN arg_min(c, (weight, -c)) END AS rejected_id FROM w GROUP BY pair_id),
m AS (SELECT p.pair_id, coalesce(min(a.i) FILTER (b.i IS NULL OR a.role <> b.role OR a.text <> b.text), max(a.i) + 1) - 1 AS n_common
  FROM p JOIN t a ON a.c = p.chosen_id LEFT JOIN t b ON b.c = p.rejected_id AND b.i = a.i GROUP BY p.pair_id),
r AS (SELECT t.*, '<|' || role || '|>' || chr(10) AS head, '<|end|>' || chr(10) AS tail FROM t),
s AS (SELECT p.pair_id, r.c = p.chosen_id AS good, r.i, m.n_common, head || text || tail AS shown,
    CASE WHEN role = 'assistant' THEN length(head) || ':0,' || (length(text) + length(tail)) || ':1' ELSE (length(head) + length(text) + length(tail)) || ':0' END AS mask
  FROM p JOIN m USING (pair_id) JOIN r USING (pair_id)),
g AS (SELECT pair_id, coalesce(string_agg(shown, '' ORDER BY i) FILTER (good AND i <= n_common), '') AS prompt,
    coalesce(string_agg(shown, '' ORDER BY i) FILTER (good AND i > n_common), '') AS chosen_completion,
    coalesce(string_agg(mask, ',' ORDER BY i) FILTER (good AND i > n_common), '') AS chosen_mask,
    coalesce(string_agg(shown, '' ORDER BY i) FILTER (NOT good AND i > n_common), '') AS rejected_completion,
    coalesce(string_agg(mask, ',' ORDER BY i) FILTER (NOT good AND i > n_common), '') AS rejected_mask,
    count(*) FILTER (i > n_common) > 0 AS differ FROM s GROUP BY pair_id)
SELECT pair_id, chosen_id, rejected_id, CAST(n_common AS INTEGER) AS n_common, prompt, chosen_completion, chosen_mask, rejected_completion, rejected_mask,
  rejected_id IS NOT NULL AND differ AS usable FROM p JOIN m USING (pair_id) JOIN g USING (pair_id)
"""
