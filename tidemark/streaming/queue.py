"""The topic queue as a stream with timers in event time.

Events (topic, at, kind) of three kinds: ``ask`` opens a topic or makes a waiting one due at once, ``fail`` defers it by the delay of its retries,
``done`` ends it. A topic comes out as ``due`` once the watermark has passed its time, and as ``expired`` when it has been due for ``KEEP`` seconds
and nothing came of it. The state of a topic that is done or expired goes, so the state holds open topics only.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import topics

#: Seconds that a due topic is kept for.
KEEP = 7 * 86400
KINDS = ("ask", "fail", "done")
_OUT = "topic string, event string, at timestamp, retry_count int"
#: The state's provider; timers need it.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Queue(StatefulProcessor):
    """State of a topic: retries, the time in ms at which it is due, whether it came out."""

    def __init__(self, keep: int):
        self.keep = keep * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.topic = handle.getValueState("topic", "retries int, due long, told boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # times and kinds as numbers, nine bytes an event; a batch is bounded by the files that a trigger takes
        parts = [(x["ms"].to_numpy(np.int64), x["code"].to_numpy(np.int8)) for x in rows]
        at, kind = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((kind, at))
        at, kind = at[order], kind[order]
        yield from self._passed(key, timerValues.getCurrentWatermarkInMs())  # timers come after rows, but these were due before them
        retries, due, told = self.topic.get() if self.topic.exists() else (0, None, False)
        ends = np.flatnonzero(kind == KINDS.index("done"))
        if len(ends):  # what was before the end is over
            at, kind, retries, due, told = at[ends[-1] + 1 :], kind[ends[-1] + 1 :], 0, None, False
        fails = np.flatnonzero(kind == KINDS.index("fail"))
        retries += len(fails)
        if len(at):
            last = kind[-1] == KINDS.index("fail")
            wait = min(topics.MAX_DELAY, topics.FIRST_DELAY * 2 ** min(retries - 1, topics.DOUBLINGS)) * 1000 if last else 0
            due, told = int(at[-1]) + wait, False
        self._forget_timers()
        if due is None:
            self.topic.clear()
        else:
            self.topic.update((retries, due, told))
            if not told:
                self.handle.registerTimer(due)
            self.handle.registerTimer(due + self.keep)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._passed(key, expiredTimerInfo.getExpiryTimeInMs())

    def _passed(self, key: Any, now: int) -> Iterator[pd.DataFrame]:
        """What is due or expired at a time."""
        if not self.topic.exists():
            return
        retries, due, told = self.topic.get()
        out = []
        if not told and due <= now:
            out.append(("due", due))
            self.topic.update((retries, due, True))
        if due + self.keep <= now:
            out.append(("expired", due + self.keep))
            self.topic.clear()
        if out:
            yield pd.DataFrame({"topic": key[0], "event": [e for e, _ in out], "at": pd.to_datetime([t for _, t in out], unit="ms", utc=True), "retry_count": np.int32(retries)})

    def close(self) -> None:
        pass

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside may have timers."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def due_topics(events: DataFrame, late: str = "10 minutes", keep: int = KEEP) -> DataFrame:
    """topic, event (due or expired), at and retry_count of a stream of events (topic, at, kind).

    Rows without topic, time or a known kind are left out. Events of a topic in one batch count in their order in time (an ask before a failure before an end at
    the same time); one that comes in a later batch than a later event counts as if it came with its batch. The delay is that of ``topics.defer``.
    """
    code = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    rows = events.withWatermark("at", late).filter("topic IS NOT NULL AND at IS NOT NULL").withColumn("code", code.cast("byte")).filter("code >= 0")
    rows = rows.select("topic", "at", F.unix_millis("at").alias("ms"), "code")
    return rows.groupBy("topic").transformWithStateInPandas(_Queue(keep), _OUT, "append", "eventTime")
