"""JSON snapshots of a knowledge base: reading, export, and a guard against losing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()


def _row(*names: str) -> list[T.StructField]:
    return [T.StructField(n, _S) for n in names]


DOCUMENT = T.StructType([*_row("url", "title", "site", "source_type", "published_at", "content_hash"), T.StructField("meta", T.MapType(_S, _S)), T.StructField("chunks", T.ArrayType(_S))])
FACT = T.StructType([*_row("title", "answer", "topic", "tags", "source_url", "source_type", "extraction", "version", "effective_from", "date_kind", "status"), T.StructField("confidence", T.DoubleType())])
SNAPSHOT = T.StructType([T.StructField("version", _L), *_row("generated_at", "note"), T.StructField("sources", T.ArrayType(_S)), T.StructField("documents", T.ArrayType(DOCUMENT)), T.StructField("facts", T.ArrayType(FACT))])


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and facts of a snapshot; seq is a row's place in its list."""
    raw = spark.read.schema(SNAPSHOT).json(path, multiLine=True)
    docs = raw.select(F.posexplode("documents").alias("seq", "d")).select("seq", "d.*")
    facts = raw.select(F.posexplode("facts").alias("seq", "f")).select("seq", "f.*")
    chunks = docs.select("url", F.posexplode("chunks").alias("ord", "text"))
    return docs.drop("chunks"), chunks, facts


def fingerprint(text: Column) -> Column:
    """The first 16 hex digits of a SHA-1."""
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def export(df: DataFrame, path: str) -> None:
    """JSON lines; the number of files follows the data."""
    df.write.mode("overwrite").json(path)


def shrinks(old: DataFrame, new: DataFrame, least: float = 0.9) -> DataFrame:
    """One row: old and new counts, and whether the new snapshot lost more than it may."""
    n = old.agg(F.count("*").alias("n_old"))
    return n.crossJoin(new.agg(F.count("*").alias("n_new"))).withColumn("refused", F.col("n_new") < least * F.col("n_old"))  # a row by a row
