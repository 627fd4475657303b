"""The topic queue as tables: entry, order, delay, lanes and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST_DELAY, MAX_DELAY, DOUBLINGS = 300, 3600, 4


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """topic, origin, priority, hits, last_run, retry_count, next_retry_at of both; a known topic takes the lower priority and is open again.

    new: topic, origin, priority, seq. A topic with many requests is one row per task before it is dealt out.
    """
    asked = new.filter(F.btrim("topic") != "").groupBy(F.btrim("topic").alias("topic")).agg(F.min("priority").alias("_p"), F.min_by("origin", "seq").alias("_o"))
    both = queue.join(asked, "topic", "full")
    seen = F.col("_p").isNotNull()
    done = F.coalesce("last_run", F.lit("")) != ""
    return both.select(
        "topic",
        F.when(F.col("origin").isNull() | (seen & done), F.col("_o")).otherwise(F.col("origin")).alias("origin"),
        F.least("priority", "_p").alias("priority"),
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.when(seen, F.lit("")).otherwise(F.col("last_run")).alias("last_run"),
        F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
        F.coalesce("next_retry_at", F.lit(0.0)).alias("next_retry_at"),
    )


def dequeue(queue: DataFrame, now: float, limit: int, include_chat: bool = True, retry_only: bool = False) -> DataFrame:
    """Topics that are due, in the order in which they are worked on."""
    due = queue.filter((F.coalesce("last_run", F.lit("")) == "") & (F.col("next_retry_at") <= now))
    due = due if include_chat else due.filter(F.col("origin") != "chat")
    due = due.filter("retry_count > 0") if retry_only else due
    first = [F.col("next_retry_at")] if retry_only else []
    return due.orderBy(*first, "priority", F.desc("hits"), "topic").limit(limit)


def delay(retries: Column, least: float = 0.0) -> Column:
    """Seconds to wait after so many failures."""
    return F.greatest(F.least(F.lit(MAX_DELAY), F.lit(FIRST_DELAY) * F.pow(F.lit(2), F.least(retries, F.lit(DOUBLINGS)))), F.lit(least)).cast("double")


def defer(queue: DataFrame, failed: DataFrame, now: float, least: float = 0.0) -> DataFrame:
    """The queue after failures: one more retry, and a later time."""
    hit = failed.select("topic").distinct().withColumn("_hit", F.lit(True))
    on = F.col("_hit").isNotNull()
    out = queue.join(hit, "topic", "left")
    return out.withColumns({"next_retry_at": F.when(on, now + delay(F.col("retry_count"), least)).otherwise(F.col("next_retry_at")), "retry_count": F.when(on, F.col("retry_count") + 1).otherwise(F.col("retry_count"))}).drop("_hit")


def mark_run(queue: DataFrame, done: DataFrame, at: str) -> DataFrame:
    """The queue after runs: a hit more, no retries."""
    hit = done.select("topic").distinct().withColumn("_hit", F.lit(True))
    on = F.col("_hit").isNotNull()
    out = queue.join(hit, "topic", "left")
    return out.withColumns({"hits": F.when(on, F.col("hits") + 1).otherwise(F.col("hits")), "last_run": F.when(on, F.lit(at)).otherwise(F.col("last_run")), "retry_count": F.when(on, 0).otherwise(F.col("retry_count")), "next_retry_at": F.when(on, 0.0).otherwise(F.col("next_retry_at"))}).drop("_hit")


def next_retry(queue: DataFrame) -> DataFrame:
    return queue.filter((F.coalesce("last_run", F.lit("")) == "") & (F.col("retry_count") > 0)).agg(F.min("next_retry_at").alias("next_retry_at"))


def interleave(lanes: DataFrame, start: int, limit: int) -> DataFrame:
    """Topics of two lanes in turn, each from a rotating start; a topic comes once. lanes: lane (0, 1), seq, topic."""
    sizes = lanes.groupBy("lane").agg(F.count("*").alias("_n"))
    turned = lanes.join(F.broadcast(sizes), "lane").withColumn("_turn", F.pmod(F.col("seq") - start, F.col("_n")))  # two rows
    order = turned.groupBy("topic").agg(F.min(F.struct("_turn", "lane")).alias("x"))
    return order.select("topic", F.col("x.lane").alias("lane"), F.col("x._turn").alias("turn")).orderBy("turn", "lane", "topic").limit(limit)


def page_budgets(runs: DataFrame, total: int, by: str = "run", order: str = "seq", wanted: str = "wanted") -> DataFrame:
    """Pages that each topic of a run may fetch: what is left, divided by the topics left; a run's topics are a bounded list."""
    listed = runs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, wanted))).alias("_x"))
    n = F.size("_x")
    zero = F.struct(F.lit(total).cast("long").alias("left"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        share = F.floor(s["left"] / F.greatest(n - F.size(s["out"]), F.lit(1)))
        used = F.least(share, x[wanted].cast("long"))
        return F.struct((s["left"] - used).alias("left"), F.concat(s["out"], F.array(used)).alias("out"))

    spent = listed.withColumn("_b", F.aggregate("_x", zero, step)["out"])
    return spent.select(by, F.explode(F.arrays_zip("_x", "_b")).alias("z")).select(by, F.col(f"z._x.{order}").alias(order), F.col("z._b").alias("pages"))


def throttle(requests: DataFrame, interval: float, host: str = "host", at: str = "at") -> DataFrame:
    """When each request of a host may go: its own time, or the interval after the one before."""
    w = Window.partitionBy(host).orderBy(at, "id")
    n = F.row_number().over(w) - 1
    slack = F.max(F.col(at) - n * interval).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return requests.withColumn("go_at", F.round(slack + n * interval, 6))


def cache_sweep(files: DataFrame, cap: int, size: str = "size", age: str = "modified") -> DataFrame:
    """The newest files whose sizes add up to the cap; sums per day first, so that only one day is summed file by file."""
    day = F.floor(F.col(age) / 86400)
    days = files.groupBy(day.alias("_d")).agg(F.sum(size).alias("_s"))
    later = days.withColumn("_before", F.sum("_s").over(Window.orderBy(F.desc("_d"))) - F.col("_s")).select("_d", "_before")
    inside = F.sum(size).over(Window.partitionBy("_d").orderBy(F.desc(age), "name"))
    return files.withColumn("_d", day).join(later, "_d").withColumn("_sum", inside + F.col("_before")).filter(F.col("_sum") <= cap).drop("_d", "_before", "_sum")
