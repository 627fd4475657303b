"""A step's result as a written table, for what several later steps read.

The table is Parquet in the folder that the cluster shares (``spark.checkpoint.dir``), so that a lost executor costs its tasks only and
nothing is worked out twice. Where the setting is absent and Spark runs on one machine, as in the bench, the rows are kept
by Spark's cache instead, which is worked out again if it is lost; a cluster without the setting is refused.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame, name: str) -> DataFrame:
    """df, worked out once."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a step's files: in the shared folder, or of this machine where none is set and Spark runs on it alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = tempfile.gettempdir()
    return f"{folder.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
