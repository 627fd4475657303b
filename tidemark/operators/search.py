"""Batch retrieval: postings, BM25, rerank, evidence. Many questions at a time; one question is a table of one row.

A postings table (id, term, tf) and its statistics are shuffled by term once; a question's terms meet only their own
postings. Statistics count every indexed row, whatever its status, as a full-text index does; status is a filter after the join.

The best rows of each question are found without scoring all that share a word with it, see ``bm25_pool``: a word that all rows have
would make as many rows as questions times documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import versions as vs
from tidemark.operators import names
from tidemark.operators import vectors as cells
from tidemark.operators.steps import scratch, settle
from tidemark.operators.text_index import TextIndex

K1, B, MIN_IDF = 1.2, 0.75, 1e-6
#: Documents of a term up to which it is rare.
COMMON = 20_000
#: Tokens of a question that the substring fallback looks for, as the surveyed engine does.
LIKE_TOKENS = 200
SOURCE_BONUS = {"official": 0.12, "wiki": 0.08, "seed": 0.06}


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, term, tf and len, the document's number of tokens."""
    df = docs.select(key, tokens.alias("_t")).withColumn("len", F.size("_t"))
    return df.select(key, "len", F.explode("_t").alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))


def _frequencies(index: DataFrame, sizes: DataFrame) -> DataFrame:
    """term, df, idf, avg_len and most, the largest part of the score that the term gives to a document."""
    totals = sizes.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    counted = index.crossJoin(F.broadcast(totals))  # one row
    x = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    terms = counted.groupBy("term").agg(F.count("*").alias("df"), F.max(x).alias("_x"), F.first("n_docs").alias("n_docs"), F.first("avg_len").alias("avg_len"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(MIN_IDF))
    return terms.select("term", "df", idf.alias("idf"), "avg_len", (idf * (K1 + 1) * F.col("_x")).alias("most"))


def _part() -> Column:
    """A posting's part of the score."""
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))


def bm25(index: DataFrame, sizes: DataFrame, questions: DataFrame, key: str, qkey: str) -> DataFrame:
    """qkey, key, bm of all rows that share a term: the lower the better, as full-text engines order it.

    index: postings; sizes: a row per document with len, empty ones too; questions: qkey and distinct terms (term).
    """
    asked = questions.join(_frequencies(index, sizes), "term")
    return index.join(asked.select(qkey, "term", "idf", "avg_len"), "term").groupBy(qkey, key).agg(F.round(-F.sum(_part()), 6).alias("bm"))


def bm25_pool(index: DataFrame, sizes: DataFrame, questions: DataFrame, key: str, qkey: str, pool: int, common: int = COMMON) -> DataFrame:
    """qkey, key, bm of the ``pool`` best rows of each question, of equal ones those with the smaller key: exactly those of ``bm25``.

    Terms in more than ``common`` documents are common. Rows with a rare term of a question are its candidates, at most ``common`` for a
    term; the parts of common terms are looked up for those of them alone that these parts can still bring into the pool. All
    other rows have nothing but common terms, so they are ranked by these, once for each set of common terms that questions have: of such a list
    the first ``pool`` rows do, as each of them is at least as good in full. Lists are made just for the questions whose candidates are too few, or
    too weak against the most that the common terms can give.
    """
    index, sizes = settle(index, "postings"), settle(sizes, "sizes")
    known, part = settle(_frequencies(index, sizes), "terms"), _part()
    asked = questions.join(known, "term")
    told = index.join(asked.filter(F.col("df") <= common).select(qkey, "term", "idf", "avg_len"), "term")
    rare = told.groupBy(qkey, key).agg(F.sum(part).alias("_rare"))
    frequent = asked.filter(F.col("df") > common).select(qkey, "term", "idf", "avg_len", "most")
    sets = frequent.groupBy(qkey).agg(F.sum("most").alias("_most"), F.array_sort(F.collect_list("term")).alias("_set"))
    worst = top(rare, qkey, pool, F.desc("_rare"), F.asc(key), rank="_r").filter(F.col("_r") == pool).select(qkey, F.col("_rare").alias("_worst"))
    bounds = questions.select(qkey).distinct().join(worst, qkey, "left").join(sets, qkey, "left").withColumn("_most", F.coalesce("_most", F.lit(0.0)))
    near = rare.join(bounds.select(qkey, "_worst", "_most"), qkey).filter(F.col("_worst").isNull() | (F.col("_rare") + F.col("_most") >= F.col("_worst") - 1e-5))
    more = near.select(qkey, key).join(frequent.drop("most"), qkey).join(index, [key, "term"]).select(qkey, key, part.alias("_x"))
    full = near.select(qkey, key, F.col("_rare").alias("_x")).unionByName(more).groupBy(qkey, key).agg(F.round(-F.sum("_x"), 6).alias("bm"))

    open_ = bounds.filter(F.col("_set").isNotNull() & (F.col("_worst").isNull() | (F.col("_worst") <= F.col("_most") + 1e-5))).select(qkey, "_set")
    terms = open_.select("_set").distinct().select("_set", F.explode("_set").alias("term"))
    weights = terms.join(known.select("term", "idf", "avg_len"), "term")
    listed = index.join(weights, "term").groupBy("_set", key).agg(F.round(-F.sum(part), 6).alias("bm"))
    lists = open_.join(top(listed, "_set", pool, F.asc("bm"), F.asc(key)).drop("rank"), "_set").select(qkey, key, "bm")
    both = full.unionByName(lists).groupBy(qkey, key).agg(F.min("bm").alias("bm"))
    return top(both, qkey, pool, F.asc("bm"), F.asc(key)).select(qkey, key, "bm")


def top(df: DataFrame, by: str, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; the limit is applied before the rows are dealt out too."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def coverage(tokens: Column, haystack: Column) -> Column:
    """Share of tokens that are part of the text."""
    return F.size(F.filter(tokens, lambda t: F.contains(haystack, t))) / F.greatest(F.size(tokens), F.lit(1))


def score_chunk(tokens: Column, text: Column, title: Column, source_type: Column, bm: Column) -> Column:
    """Coverage, title and source, then a factor of 0.5 to 1 for BM25; 4 decimals."""
    bonus = F.lit(0.0)
    for name, value in SOURCE_BONUS.items():
        bonus = F.when(source_type == name, value).otherwise(bonus)
    base = F.least(F.lit(1.0), coverage(tokens, text) * 0.62 + F.least(F.lit(0.2), coverage(tokens, title) * 0.2) + bonus)
    weighted = F.when(F.coalesce(bm, F.lit(0.0)) == 0, base).otherwise(base * (1 - 0.5 / (1 + F.greatest(-bm, F.lit(0.0)))))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), weighted)), 4)


def score_fact(df: DataFrame, tokens: str = "tokens", title: str = "title_norm", haystack: str = "haystack", question: str = "question_norm", confidence: str = "confidence") -> DataFrame:
    """df with coverage, relevance, title_coverage, entity_hit, rank_raw and rank."""
    n = F.size(tokens)
    hits = lambda where: F.size(F.filter(tokens, lambda t: F.contains(F.col(where), t)))
    cover = hits(haystack) / F.greatest(n, F.lit(1))
    in_title = F.least(F.lit(1.0), hits(title) / F.greatest(F.least(n, F.lit(3)), F.lit(1)))
    entity = vs.entity_of(F.col(title))
    hit = F.when((F.length(entity) >= 2) & F.contains(F.col(question), entity), 1.0).otherwise(0.0)
    df = df.withColumns({"entity": entity, "coverage": F.round(cover, 4), "_in_title": in_title, "entity_hit": hit})
    df = df.withColumn("relevance", F.round(cover * 0.75 + F.coalesce(F.col(confidence), F.lit(0.0)) * 0.25, 4))
    df = df.withColumn("rank_raw", F.round(F.col("relevance") + 0.35 * F.col("_in_title") + 0.5 * F.col("entity_hit"), 6))
    return df.withColumns({"title_coverage": F.round("_in_title", 4), "rank": F.round(F.least(F.lit(1.0), F.col("rank_raw")), 4)}).drop("_in_title")


def newest_in_slot(df: DataFrame, by: str, position: str = "pos", slot: str = "slot_key", version: str = "version", effective: str = "effective_from") -> DataFrame:
    """Positions within a slot are given anew, the newest first; rows without a slot keep theirs.

    The row that is the j-th newest of its slot takes the slot's j-th position, by a join on the rank.
    """
    slotted = Window.partitionBy(by, slot)
    newest = slotted.orderBy(F.desc(F.coalesce(effective, F.lit(""))), F.desc(vs.version_key(F.col(version))), F.asc(position))
    ranks = df.filter(F.coalesce(F.col(slot), F.lit("")) != "").withColumns({"_k": F.row_number().over(slotted.orderBy(position)), "_j": F.row_number().over(newest)})
    ranks = settle(ranks, "slots")
    places = ranks.select(by, slot, F.col("_k").alias("_j"), F.col(position).alias("_place"))
    moved = ranks.join(places, [by, slot, "_j"]).withColumn(position, F.col("_place")).select(df.columns)
    return moved.unionByName(df.filter(F.coalesce(F.col(slot), F.lit("")) == ""))


def entity_first(df: DataFrame, by: str, position: str = "pos") -> DataFrame:
    """The first hit of each named entity goes ahead of the rest; order within both stays."""
    first = F.row_number().over(Window.partitionBy(by, "entity", F.col("entity_hit") > 0).orderBy(position))
    ahead = (F.col("entity_hit") > 0) & (F.col("entity") != "") & (first == 1)
    df = df.withColumn("_ahead", ahead)
    return df.withColumn(position, F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_ahead"), F.asc(position)))).drop("_ahead")


def new_index(rows: DataFrame) -> TextIndex:
    """An index of rows (key, tokens, text), for as long as the session's folder stands."""
    index = TextIndex(rows.sparkSession, scratch(rows.sparkSession, "index"))
    index.upsert(rows)
    return index


def _pool(index: TextIndex, questions: DataFrame, size: int, qkey: str, like: list[Column], rows: DataFrame | None = None) -> DataFrame:
    """qkey, key and bm: the best rows that share a token; of questions that have none, rows that contain one, in the order of ``like``.

    rows: key, text and what ``like`` sorts by, those of the index if none are given. A row among the first of a question is among the first of each of its tokens
    that it contains, so no more than ``size`` rows of a token are met with its questions.
    """
    terms = questions.select(qkey, F.explode("tokens").alias("term")).distinct()
    pool = settle(index.top(terms, size, qkey), "pool")
    unmet = questions.join(pool.select(qkey).distinct(), qkey, "left_anti").select(qkey, F.explode(F.slice("tokens", 1, LIKE_TOKENS)).alias("term"))
    unmet = settle(unmet.filter(F.length("term") > 0).distinct(), "unmet")
    if unmet.isEmpty():
        return pool
    firsts = names.first_rows(index.rows().select("key", "text") if rows is None else rows, unmet, size, *like, name="term")
    found = unmet.join(firsts, "term").drop("term").distinct()
    return pool.unionByName(top(found, qkey, size, *like).select(qkey, "key", F.lit(0.0).alias("bm")))


def search_chunks(chunks: DataFrame, questions: DataFrame, k: int = 10, key: str = "chunk_id", qkey: str = "question_id", index: TextIndex | None = None) -> DataFrame:
    """qkey, key, relevance, coverage, rank and bm of the k best chunks of each question.

    chunks: key, text_norm, title_norm, source_type, and tokens unless the index of them is given; questions: qkey, tokens. Where no chunk shares a
    token, those that contain one as a substring are taken, in the order of their keys.
    """
    index = index or new_index(chunks.select(F.col(key).alias("key"), "tokens", F.col("text_norm").alias("text")))
    pool = settle(_pool(index, questions, 4 * k, qkey, [F.asc("key")]).withColumnRenamed("key", key), "chunk-pool")
    chunks = chunks.join(pool.select(key).distinct(), key, "left_semi")  # goes below the joins that chunks is made of
    full = pool.join(chunks.select(key, "text_norm", "title_norm", "source_type"), key).join(questions.select(qkey, F.col("tokens").alias("_q")), qkey)
    full = full.withColumns({"coverage": F.round(coverage(F.col("_q"), F.col("text_norm")), 4), "relevance": score_chunk(F.col("_q"), F.col("text_norm"), F.col("title_norm"), F.col("source_type"), F.col("bm"))})
    return top(full, qkey, k, F.desc("relevance"), F.asc("bm"), F.asc(key)).select(qkey, key, "relevance", "coverage", "rank", "bm")


def search_facts(facts: DataFrame, questions: DataFrame, k: int = 8, key: str = "id", qkey: str = "question_id", index: TextIndex | None = None) -> DataFrame:
    """qkey, key, relevance, rank_raw and pos of the k best facts.

    facts: key, title, title_norm, haystack, confidence, version, effective_from, slot_key, updated_at if there is one, and tokens unless the index of them is
    given; questions: qkey, tokens, question_norm. Where no fact shares a token, those whose haystack contains one are taken, the most trusted and
    then the latest first.
    """
    index = index or new_index(facts.select(F.col(key).alias("key"), "tokens", F.col("haystack").alias("text")))
    updated = F.col("updated_at") if "updated_at" in facts.columns else F.lit(None).cast("string")
    texts = facts.select(F.col(key).alias("key"), F.col("haystack").alias("text"), F.col("confidence").alias("_c"), updated.alias("_u"))
    pool = _pool(index, questions, 4 * k, qkey, [F.desc("_c"), F.desc("_u"), F.asc("key")], texts).withColumnRenamed("key", key)
    full = pool.join(facts.drop("tokens"), key).join(questions.select(qkey, "tokens", "question_norm"), qkey)
    full = settle(score_fact(full), "scored-facts")  # rows with a slot and those without are read apart
    order = Window.partitionBy(qkey).orderBy(F.desc("entity_hit"), F.desc("rank_raw"), F.round("bm", 4), F.asc(key))
    full = newest_in_slot(full.withColumn("pos", F.row_number().over(order)), qkey)
    full = entity_first(full, qkey).filter(F.col("pos") <= k)
    return full.select(qkey, key, "relevance", "rank_raw", "pos")


def relevance_floor(df: DataFrame, floor: float, column: str = "relevance") -> DataFrame:
    """Rows at the floor or above; unknown ones stay."""
    return df if floor <= 0 else df.filter(F.col(column).isNull() | (F.col(column) >= floor))


def evidence(items: DataFrame, by: str, order: str, text: str = "text", budget: int = 12000, least: int = 200) -> DataFrame:
    """Items in order while more than ``least`` characters of the budget are left; the last one is cut; index from 1."""
    full = items.filter(F.length(F.btrim(F.col(text))) > 0).withColumn(text, F.btrim(text))
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = full.withColumn("_left", budget - before).filter(F.col("_left") > least)
    full = full.withColumn(text, F.substr(F.col(text), F.lit(1), F.col("_left").cast("int")))
    return full.withColumn("index", F.row_number().over(Window.partitionBy(by).orderBy(order))).drop("_left")


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x * x).cast("double")))
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0) | size.isNull(), 0.0).otherwise(dot / size)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", qkey: str = "query_id", column: str = "embedding", block: int = cells.SLICE) -> DataFrame:
    """The k nearest of all vectors, above 0, for a stated set of queries, about ``block`` of them at a time; see ``vectors``."""
    return cells.Cells(vectors, key, column).top(queries, k, qkey, column, block).withColumnRenamed("_k", key)


def mentioned_entities(questions: DataFrame, entities: DataFrame, qkey: str = "question_id", text: str = "question_norm") -> DataFrame:
    """qkey and the entities (name) of its text, of two characters or more, leftmost and longest first, that don't overlap."""
    known = entities.select("name").filter(F.length("name") >= 2)
    return names.leftmost(names.mentions(questions, known, qkey, text), qkey)


def cited(answers: DataFrame, citations: DataFrame, key: str = "answer_id", text: str = "text") -> DataFrame:
    """The citations whose [n] stands in the answer."""
    used = answers.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), 1))).alias("_n")).select(key, F.expr("try_cast(_n AS int)").alias("index"))
    return citations.join(used, [key, "index"], "left_semi")
