"""Relations that the queries share: facts and pages in the engine's shape, made from the star schema's tables.

Each is written twice, as a DataFrame and as SQL, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact per order and line, the first where there are several: a part's price, as seven sites give it."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate")
    rest = F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    items = items.groupBy("l_orderkey", "l_linenumber").agg(F.min(rest).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    df = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    k, n, s = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")
    text = lambda c: c.cast("string")
    price = F.floor("p_retailprice").cast("long") + F.when(n == 7, 1).otherwise(0)
    return df.select(
        (F.col("l_orderkey") * 10 + n).alias("id"),
        F.concat(F.lit("part"), text(k), F.lit("·price")).alias("title"),
        F.concat(F.lit("part"), text(k), F.lit("|price")).alias("slot"),
        F.concat(text(price), F.lit(" USD")).alias("answer"),
        F.concat(F.lit("https://www.s"), text(s % 7), F.lit(".example.com/p/"), text(k)).alias("source_url"),
        F.when(s % 3 == 0, "official").when(s % 3 == 1, "wiki").otherwise("community").alias("source_type"),
        F.when(n == 1, "api").when(n == 2, "table").otherwise("llm").alias("extraction"),
        F.round(0.5 + n * 0.05, 2).alias("confidence"),
        F.when(k % 5 == 0, F.concat(F.lit("1."), text(n % 3))).otherwise("").alias("version"),
        F.when(k % 5 == 0, F.date_format("l_shipdate", "yyyy-MM-01")).otherwise("").alias("effective_from"),
        F.when(n == 1, F.concat(F.lit("price | 并入:m"), text(s % 2), F.lit(".example.org"))).otherwise("price").alias("tags"),
        F.when(F.col("l_returnflag") == "R", "superseded").otherwise("active").alias("status"),
        F.col("l_shipdate").alias("published"),
        (F.col("l_orderkey") * 10 + n).alias("seq"),
    )


FACTS = """facts AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'part' || l_partkey || '·price' AS title, 'part' || l_partkey || '|price' AS slot,
  (CAST(floor(p_retailprice) AS BIGINT) + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) || ' USD' AS answer,
  'https://www.s' || (l_suppkey % 7) || '.example.com/p/' || l_partkey AS source_url,
  CASE l_suppkey % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'wiki' ELSE 'community' END AS source_type,
  CASE l_linenumber WHEN 1 THEN 'api' WHEN 2 THEN 'table' ELSE 'llm' END AS extraction,
  round(0.5 + l_linenumber * 0.05, 2) AS confidence,
  CASE WHEN l_partkey % 5 = 0 THEN '1.' || (l_linenumber % 3) ELSE '' END AS version,
  CASE WHEN l_partkey % 5 = 0 THEN strftime(l_shipdate, '%Y-%m-01') ELSE '' END AS effective_from,
  CASE WHEN l_linenumber = 1 THEN 'price | 并入:m' || (l_suppkey % 2) || '.example.org' ELSE 'price' END AS tags,
  CASE WHEN l_returnflag = 'R' THEN 'superseded' ELSE 'active' END AS status, l_shipdate AS published, l_orderkey * 10 + l_linenumber AS seq
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag, l_shipdate) AS rn FROM lineitem) JOIN part ON l_partkey = p_partkey AND rn = 1)"""


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files split into fewer parts, as one file of one row group does; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def with_facts(body: str) -> str:
    return f"WITH {FACTS}, {body}" if not body.lstrip().upper().startswith("SELECT") else f"WITH {FACTS} {body}"
