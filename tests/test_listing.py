"""A listing as a source of tables and streams."""

import json

import pytest

from tidemark.sources import listing
from tidemark.streaming import events as ev


def body(titles, token=None):
    return json.dumps({"query": {"allpages": [{"title": t} for t in titles]}, **({"continue": {"apcontinue": token}} if token else {})})


@pytest.fixture
def stored(spark, tmp_path):
    answers = [("a", "", body(["A1", "A2"], "x y/z")), ("a", "x y/z", body(["A3"], "é")), ("a", "é", body(["A4", "A5"])), ("b", "", body([])), ("c", "", "no json"), ("d", "", body(["D1"], "t")), ("d", "t", body(["D2"], "t"))]
    path = str(tmp_path / "answers")
    listing.store(spark.createDataFrame(answers, "name string, token string, body string"), path)
    spark.dataSource.register(listing.Listing)
    return path


WANT = [("a", f"A{i + 1}", i) for i in range(5)] + [("d", "D1", 0), ("d", "D2", 1)]


def test_read(spark, stored):
    df = spark.read.format("listing").options(path=stored, names="a,b, c,d,missing,a").load()
    assert df.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, df.collect())) == WANT
    assert spark.read.format("listing").options(path=stored, names="").load().count() == 0


def test_stream_stops_and_goes_on_without_repeats(spark, stored, tmp_path):
    out, seen = str(tmp_path / "out"), []
    for _ in range(5):
        rows = spark.readStream.format("listing").options(path=stored, names="a,b,c,d", hops="1").load()
        ev.run_once(rows, lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "stream"))
        seen.append(spark.read.parquet(out).count())
    assert seen[0] == 3 and seen[-1] == len(WANT) and seen == sorted(seen)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == WANT


def test_a_batch_that_failed_is_read_again(spark, stored, tmp_path):
    rows = lambda hops: spark.readStream.format("listing").options(path=stored, names="a", hops=hops).load()

    def dies(df, n):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        ev.run_once(rows("2"), dies, str(tmp_path / "stream"))
    got = []
    ev.run_once(rows("9"), lambda df, n: got.append((n, sorted(r.title for r in df.collect()))), str(tmp_path / "stream"))
    titles = [t for _, batch in got for t in batch]
    assert got[0] == (0, ["A1", "A2", "A3"])  # the batch keeps its end, whatever is asked for now
    assert titles == sorted(set(titles))


def test_parse_of_odd_answers():
    assert listing.parse(body(["x"], "t")) == (["x"], "t")
    for odd in ("", "[]", "null", '{"query": null}', '{"query": {"allpages": 3}}'):
        assert listing.parse(odd) == ([], None)
    assert listing.parse('{"query": {"allpages": [{"title": 1}, {"title": "y"}]}, "continue": {"apcontinue": ""}}') == (["y"], None)
