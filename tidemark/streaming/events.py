"""Event-time windows and the topic queue as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import topics


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of event files as a stream, with a timestamp that can carry a watermark."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Events and their values' sum for each window and type; the same plan for a table and for a stream."""
    events = events.withWatermark("ts", late) if late and events.isStreaming else events
    out = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    out = events.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", by: str = "user_id") -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def run_once(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """All that is there, in order, then stop; the checkpoint makes a second run go on from there."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


_OUT = "topic string, retry_count int, next_retry_at double, hits int, done boolean"
_STATE = "retry_count int, next_retry_at double, hits int"


def _attempts(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A topic's retries over attempts (at, ok), in time order."""
    retries, at, hits = state.get if state.exists else (0, 0.0, 0)
    done = False
    for row in pd.concat(list(batches)).sort_values("at").itertuples():
        if row.ok:
            retries, at, hits, done = 0, 0.0, hits + 1, True
        else:
            at = row.at + min(topics.MAX_DELAY, topics.FIRST_DELAY * 2 ** min(retries, topics.DOUBLINGS))
            retries, done = retries + 1, False
    state.update((retries, at, hits))
    yield pd.DataFrame([(key[0], retries, at, hits, done)], columns=["topic", "retry_count", "next_retry_at", "hits", "done"])


def retry_state(attempts: DataFrame) -> DataFrame:
    """The state of each topic after a stream of attempts (topic, at, ok)."""
    return attempts.groupBy("topic").applyInPandasWithState(_attempts, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def ingest(docs: DataFrame, known: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str) -> None:
    """New and changed documents of a stream, by content hash against what is known, in batches."""

    def batch(df: DataFrame, _: int) -> None:
        write(df.join(known().select("url", "content_hash"), ["url", "content_hash"], "left_anti"))

    run_once(docs, batch, checkpoint)
