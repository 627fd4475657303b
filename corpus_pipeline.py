"""Documents to training sequences: five stages, each over all that the one before has kept.

Each stage takes (spark, docs, sf_dir), docs with the columns of ``documents``; all but the last return those columns.
``run`` writes a stage's result as Parquet in the cluster's shared folder and gives the reread table to the next; a table goes when
the next one is written. Columns besides those of ``documents``, of whatever names, pass every stage but the last unchanged. Empty tables give
empty ones. What each stage makes of nulls, ties and repeated rows stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules
from tidemark.llm.storage import Workspace


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, with all columns as they are.

    Null, empty and blank texts have no words and go. Ids, sources and languages may be null. Repeated rows are judged alike. A text
    of any length is judged as a whole.
    """
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; ``text`` and ``n_chars`` change, nothing else.

    A null source is no site, and a null text has no lines: such rows stay as they are, with a null n_chars for a null text. Repeated rows count as
    a page each and lose the same lines. A document all of whose lines go stays, with an empty text.
    """
    return _counted(line_dedup.drop_lines(docs, F.col("source"), counts=None))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Null ids, and texts without words, are linked with nothing and stay. Rows that share their group's smallest id all stay, as nothing tells
    which of them to keep.
    """
    return near_dedup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain nothing and stay, null items and items of under five words are in nothing. Repeated rows go or
    stay alike.
    """
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in training sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a piece of the end id alone. Null and repeated ids, and repeated rows, are documents of their own.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", sequences),
]

#: Near duplicates are found by MinHash and tokens by a byte-level BPE file; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    before = []
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
        work.drop(*before)
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
