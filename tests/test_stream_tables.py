"""Tables that a stream changes together, the update of topics, and the queue with timers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import update
from tidemark.streaming import events as ev
from tidemark.streaming import queue
from tidemark.streaming.commits import Tables

BODY = "Every page of this test says something of its own, with words that no gate minds, and at some length so that nothing is too short. " * 3
PAGE = "topic string, url string, title string, text string, published string, seq int"


def page(url, text, topic="a", seq=0):
    return (topic, f"https://x.example/{url}", "pages", text, "", seq)


def tabled(*rows):
    return BODY + "\n\n| name | size | kind |\n|---|---|---|\n" + "\n".join(f"| {n} | {s} | stone |" for n, s in rows)


@pytest.fixture
def kept(spark, tmp_path):
    return Tables(spark, str(tmp_path / "tables"), update.SCHEMAS, update.KEYS)


def change(kept):
    return lambda df, n: (update.changes({t: kept.read(t) for t in update.SCHEMAS}, df, n), {})


def present(kept):
    return {t: sorted(map(tuple, kept.read(t).collect()), key=repr) for t in update.SCHEMAS}


def write(spark, folder, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(folder)


def test_update_of_topics(spark, kept):
    first = [page("1", tabled(("amber", 3), ("jet", 4))), page("2", BODY + "two"), page("3", "short"), page("4", "x" * 210 + "|" * 900, "b"), ("b", None, None, None, None, None)]
    put, _ = change(kept)(spark.createDataFrame(first, PAGE), 0)
    assert kept.commit("q", 0, put)
    runs = {r.topic: r for r in kept.read("runs").collect()}
    assert (runs["a"].fetched, runs["a"].failed, runs["a"].pages, runs["a"].facts_added) == (2, 1, 2, 2)
    assert (runs["b"].failed, runs["b"].filtered, runs["b"].pages, runs["b"].chunks) == (1, 1, 0, 0)
    second = [page("1", tabled(("amber", 3), ("jet", 5)), seq=1), page("1", BODY, seq=0), page("2", BODY + "two")]
    put, _ = change(kept)(spark.createDataFrame(second, PAGE), 1)
    assert kept.commit("q", 1, put)
    facts = {(r.answer.split("size：")[1][0], r.status) for r in kept.read("facts").collect()}
    assert facts == {("3", "active"), ("4", "superseded"), ("5", "active")}
    run = kept.read("runs").filter("run = 1").first()
    assert (run.pages, run.skipped, run.facts_added) == (1, 1, 1)
    assert kept.read("documents").count() == 2
    assert kept.read("chunks").filter("text LIKE '%jet | 4%'").count() == 0 and kept.read("chunks").filter("text LIKE '%jet | 5%'").count() == 1


def test_facts_by_hand_stay(spark, kept):
    put, _ = change(kept)(spark.createDataFrame([page("1", tabled(("amber", 3)))], PAGE), 0)
    put["facts"] = put["facts"].withColumn("extraction", F.lit("manual"))
    kept.commit("q", 0, put)
    put, _ = change(kept)(spark.createDataFrame([page("1", tabled(("jet", 3)))], PAGE), 1)
    kept.commit("q", 1, put)
    assert {(r.extraction, r.status) for r in kept.read("facts").collect()} == {("manual", "active"), ("table", "active")}


def test_refused_pages(spark, kept):
    put = update.changes({t: kept.read(t) for t in update.SCHEMAS}, spark.createDataFrame([page("1", BODY), page("2", BODY)], PAGE), 0, F.col("url").endswith("/2"))
    kept.commit("q", 0, put)
    assert [(r.fetched, r.skipped_by_policy, r.pages) for r in kept.read("runs").collect()] == [(1, 1, 1)]


def test_killed_and_repeated_batches_equal_a_clean_run(spark, tmp_path):
    source = str(tmp_path / "pages")
    write(spark, source, [page("1", tabled(("amber", 3))), page("2", BODY)], [page("1", tabled(("jet", 3)), seq=1), page("3", BODY + "three", "b")])
    stream = lambda: spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).parquet(source)
    clean, torn = (Tables(spark, str(tmp_path / n), update.SCHEMAS, update.KEYS) for n in ("clean", "torn"))
    clean.stream(stream(), "q", str(tmp_path / "c0"), change(clean))

    def dies(df, n):
        put, gone = change(torn)(df, n)
        if n == 1:  # some tables are written, then the job is gone
            for t in ("documents", "facts"):
                put[t].write.parquet(f"{torn.path}/{t}/change=2")
            raise RuntimeError("killed")
        return put, gone

    with pytest.raises(Exception, match="killed"):
        torn.stream(stream(), "q", str(tmp_path / "c1"), dies)
    assert len(torn.commits()) == 1 and torn.read("runs").filter("run = 1").count() == 0
    assert torn.read("documents").count() == 2
    torn.stream(stream(), "q", str(tmp_path / "c1"), change(torn))
    assert present(torn) == present(clean)
    torn.stream(stream(), "q", str(tmp_path / "c2"), change(torn))  # a lost checkpoint brings both batches again
    assert present(torn) == present(clean) and len(torn.commits()) == 2
    torn.compact()
    assert present(torn) == present(clean) and len(torn.commits()) == 1 and torn.done("q", 1)


def test_gone_keys_and_null_keys(spark, tmp_path):
    kept = Tables(spark, str(tmp_path / "t"), {"rows": "k string, v int"}, {"rows": ["k"]})
    put = lambda *rows: {"rows": spark.createDataFrame(list(rows), "k string, v int")}
    assert kept.read("rows").count() == 0
    kept.commit("q", 0, put(("a", 1), ("a", 2), ("b", 3), (None, 4)))
    kept.commit("q", 1, put((None, 5)), {"rows": spark.createDataFrame([("a",)], "k string")})
    assert sorted(map(tuple, kept.read("rows").collect()), key=repr) == [("b", 3), (None, 5)]
    kept.commit("q", 2, put(("a", 6)))
    assert sorted(map(tuple, kept.read("rows").collect()), key=repr) == [("a", 6), ("b", 3), (None, 5)]
    assert not kept.commit("q", 2, put(("a", 7)))


def test_topics_come_out_when_the_watermark_passes(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    batches = [
        [("ended", at(0), "fail"), ("ended", at(1), "done"), ("waits", at(0), "fail"), ("waits", at(1), "fail"), ("now", at(0), "ask"), ("never", at(0), "odd"), (None, at(0), "ask"), ("null", None, "ask")],
        [("clock", at(60), "done"), ("later", at(60), "fail"), ("later", at(61), "done")],
        [("clock", at(300), "done"), ("waits", at(290), "fail")],
        [("clock", at(3000), "done")],
    ]
    source = str(tmp_path / "events")
    for rows in batches:
        spark.createDataFrame(rows, "topic string, at timestamp, kind string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("topic string, at timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(source)
    due = queue.due_topics(stream, "0 seconds", keep=3600 * 3)
    out = str(tmp_path / "out")
    with queue.timers(spark):
        ev.run_once(due, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "stream"))
    got = {(r.topic, r.event, (r.ms - int((start - datetime(1970, 1, 1)).total_seconds()) * 1000) / 60000, r.retry_count) for r in spark.read.parquet(out).select("*", F.unix_millis("at").alias("ms")).collect()}
    # two failures wait for ten minutes from the second, a third one for twenty; the batch that brings it comes after the first wait is over
    assert got == {("now", "due", 0, 0), ("now", "expired", 180, 0), ("waits", "due", 11, 2), ("waits", "due", 310, 3), ("waits", "expired", 490, 3)}
