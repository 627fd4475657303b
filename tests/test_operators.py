"""Search, votes, lifecycle, queue, sources and streaming on small tables, with the properties that the SQL checks can't show."""

import math
import random
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, dedupe, facts_py, ingest, lifecycle, names, search, topics, vote
from tidemark.sources import pages, providers, snapshot
from tidemark.streaming import events as ev


def test_bm25_equals_the_full_text_engine(spark):
    docs = [(1, "the cat sat on the mat"), (2, "dog and cat"), (3, "bird"), (4, "the the the dog"), (5, "mat")]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(x)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    db.executemany("insert into t(rowid, x) values (?, ?)", docs)
    df = spark.createDataFrame(docs, "id long, x string").withColumn("tokens", F.split("x", " "))
    for q in (["cat", "dog"], ["the", "mat"], ["bird"]):
        want = dict(db.execute("select rowid, bm25(t) from t where t match ?", (" OR ".join(f'"{w}"' for w in q),)).fetchall())
        asked = spark.createDataFrame([(0, w) for w in q], "q int, term string")
        got = {r.id: r.bm for r in search.bm25(search.postings(df, "id", F.col("tokens")), df.select("id", F.size("tokens").alias("len")), asked, "id", "q").collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], abs_tol=2e-6) for i in want)


@pytest.mark.parametrize(("common", "pool"), [(0, 4), (3, 1), (8, 5), (20, 12), (10**6, 5)])
def test_pool_equals_the_best_of_all(spark, common, pool):
    """Whatever counts as common, the pool is that of scoring every row; ties go by key."""
    rng = random.Random(common)
    words = [f"w{i}" for i in range(40)]
    data = [(i, [w for w in words if rng.random() < 1 / (1 + words.index(w))] + rng.choices(words[:5], k=rng.randrange(4))) for i in range(150)]
    df = spark.createDataFrame(data, "id long, tokens array<string>")
    asked = spark.createDataFrame([(q, w) for q in range(25) for w in {*rng.sample(words, rng.randrange(1, 5)), "w0"}] + [(90, "none"), (91, "w0"), (92, "w0"), (92, "w1")], "q int, term string")
    index, sizes = search.postings(df, "id", F.col("tokens")), df.select("id", F.size("tokens").alias("len"))
    want = search.top(search.bm25(index, sizes, asked, "id", "q"), "q", pool, F.asc("bm"), F.asc("id"))
    got = search.bm25_pool(index, sizes, asked, "id", "q", pool, common)
    rows = lambda x: sorted((r.q, r.id, round(r.bm, 5)) for r in x.collect())
    assert rows(got) == rows(want)


def test_cosine_in_blocks(spark):
    rng = random.Random(3)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)], "vec_id long, embedding array<double>")
    asked = vectors.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(search.cosine_topk(vectors, asked, 3, block=4)) == rows(search.cosine_topk(vectors, asked, 3))


def test_like_fallback_and_floor(spark):
    chunks = spark.createDataFrame([(1, "onion soup", "", "wiki", ["onion", "soup"]), (2, "bread", "", "wiki", ["bread"])], "chunk_id long, text_norm string, title_norm string, source_type string, tokens array<string>")
    asked = spark.createDataFrame([(0, ["nio"]), (1, ["bread"]), (2, [])], "question_id int, tokens array<string>")
    got = {(r.question_id, r.chunk_id) for r in search.search_chunks(chunks, asked, 5).collect()}
    assert got == {(0, 1), (1, 2)}
    rows = spark.createDataFrame([(1, 0.01), (2, None), (3, 0.5)], "i int, relevance double")
    assert sorted(r.i for r in search.relevance_floor(rows, 0.05).collect()) == [2, 3]


def test_newest_in_slot_moves_only_within_a_slot(spark):
    rows = [(1, 1, "s", "1.9", ""), (1, 2, "t", "", ""), (1, 3, "s", "1.10", ""), (1, 4, "", "9", ""), (1, 5, "s", "", "2026-01-01")]
    df = spark.createDataFrame(rows, "q int, pos int, slot_key string, version string, effective_from string").withColumn("old", F.col("pos"))
    got = {r.old: r.pos for r in search.newest_in_slot(df, "q").collect()}
    assert got == {5: 1, 3: 3, 1: 5, 2: 2, 4: 4}


def test_evidence_budget(spark):
    items = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([400, 0, 500, 250, 10])], "q int, ord int, text string")
    got = [(r.ord, r["index"], len(r.text)) for r in search.evidence(items, "q", "ord", budget=1100, least=20).orderBy("index").collect()]
    assert got == [(0, 1, 400), (2, 2, 500), (3, 3, 200)]


def test_entities(spark):
    asked = spark.createDataFrame([(0, "早雾和娜娜莉的技能"), (1, "没有")], "question_id int, question_norm string")
    names = spark.createDataFrame([("早雾",), ("娜娜",), ("娜娜莉",)], "name string")
    assert {r.question_id: r.entities for r in search.mentioned_entities(asked, names).collect()} == {0: ["早雾", "娜娜莉"]}


def test_citations(spark):
    answers = spark.createDataFrame([(1, "a [2] and [9999999999999] [2]")], "answer_id int, text string")
    marks = spark.createDataFrame([(1, 1, "u"), (1, 2, "v")], "answer_id int, index int, url string")
    assert [r.url for r in search.cited(answers, marks).collect()] == ["v"]


FACT = "id long, slot string, title string, answer string, source_url string, confidence double, version string, effective_from string, tags string, status string, seq long"


def facts(spark, rows):
    return spark.createDataFrame([(i, "e|hp", "e·hp", a, u, 0.5, v, "", t, s, i) for i, a, u, v, t, s in rows], FACT)


@pytest.mark.parametrize(
    ("rows", "verdict"),
    [
        ([(1, "8424 点", "http://a.com/1", "", "", "active"), (2, "8,424 点", "http://www.b.com/2", "", "", "active")], "multi"),
        ([(1, "8424 点", "http://a.com/1", "", "", "active"), (2, "8425 点", "http://b.com/2", "", "", "active")], "conflict"),
        ([(1, "8424 点", "http://a.com/1", "1.1", "", "active"), (2, "8425 点", "http://b.com/2", "1.2", "", "active")], "versioned"),
        ([(1, "8424 点", "http://a.com/1", "", "", "active"), (2, "8425 点", "http://b.com/2", "", "", "superseded")], "single"),
        ([(1, "8424 点", "http://a.com/1", "", "多源 | 并入:m.b.com", "active")], "multi"),
        ([(1, "8424 点", "http://a.com/1", "", "叙事来源", "active"), (2, "8424 点", "http://b.com", "", "", "active")], "single"),
        ([(1, "8424 点", "http://a.com/1", "", "", "active"), (2, "8425 点", "http://b.com/2", "", "", "revoked")], "single"),
    ],
)
def test_verdicts(spark, rows, verdict):
    for order in (rows, rows[::-1]):
        (got,) = vote.vote(vote.candidates(facts(spark, order))).collect()
        assert got.verdict == verdict


def test_revoked_rows_can_vote_if_asked(spark):
    rows = [(1, "8424 点", "http://a.com/1", "", "", "active"), (2, "8425 点", "http://b.com/2", "", "", "revoked")]
    (got,) = vote.vote(vote.candidates(facts(spark, rows), include_revoked=True)).collect()
    assert got.verdict == "conflict"


def test_reconcile_is_idempotent(spark):
    rows = [(1, "8424 点", "http://a.com/1", "", "", "active"), (2, "8424 点", "http://b.com/2", "", "", "active")]
    once = vote.reconcile(facts(spark, rows))
    shown = lambda df: sorted((r.id, r.tags, r.confidence, r.status) for r in df.collect())
    assert shown(once) == shown(vote.reconcile(once)) == [(1, "多源确认", 0.58, "active"), (2, "多源确认", 0.58, "active")]


def test_neighbours_within_two_bits_are_all_found(spark):
    base = 0x0F0F << 48
    rows = [(0, base)] + [(i + 1, base ^ (1 << (48 + i % 16))) for i in range(16)] + [(50, base ^ (7 << 50)), (51, base ^ 7)]
    rows = [(i, h - 2**64 if h >= 2**63 else h) for i, h in rows]
    df = spark.createDataFrame(rows, "id long, simhash long")
    got = {r.other: r.distance for r in dedupe.simhash_neighbours(df.filter("id = 0"), df, limit=100).collect()}
    assert got == {**dict.fromkeys(range(1, 17), 1), 51: 3}


def test_find_duplicate(spark):
    known = spark.createDataFrame([(1, "t", "原价 2480 钻", 0.9, "", 0), (2, "t", "开放世界动作角色扮演游戏", 0.5, "", 0)], "id long, title string, answer string, confidence double, updated_at string, simhash long")
    new = spark.createDataFrame([(7, "T", "动作角色扮演游戏", 1 << 62), (8, "t", "原价 3280 钻", 1 << 62)], "cid long, title string, answer string, simhash long")
    got = {r.cid: (r.id, r.action) for r in dedupe.find_duplicate(new, known).collect()}
    assert got == {7: (2, "duplicate"), 8: (1, "conflict")}


def test_upsert_twice_is_a_touch(spark):
    old = spark.createDataFrame([("u", "h1", 1), ("v", "h2", 1)], "url string, content_hash string, n int")
    new = spark.createDataFrame([("u", "h9", 2), ("w", "h3", 2)], "url string, content_hash string, n int")
    once = lifecycle.upsert(old, new)
    assert {r.url: r.change for r in once.collect()} == {"u": "update", "v": "keep", "w": "insert"}
    assert {r.change for r in lifecycle.upsert(once.drop("change"), new).collect()} == {"keep", "touch"}
    assert {r.url: r.n for r in lifecycle.latest(old.unionByName(new), "url", "n").collect()} == {"u": 2, "v": 1, "w": 2}


def test_registry(spark):
    rows = spark.createDataFrame([("u", "a", "active"), ("u", "b", "active")], "url string, title string, status string")
    registry = spark.createDataFrame([("u", "a")] * 2, "url string, title string")
    assert {r.title: r.status for r in lifecycle.apply_revocations(rows, registry, ["url", "title"]).collect()} == {"a": "revoked", "b": "active"}
    assert [r.title for r in lifecycle.without_revoked(rows, registry, ["url", "title"]).collect()] == ["b"]


def test_copies_by_prefix_equal_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from all the hounds of the county " * 3
    rows = [(1, "a", base), (2, "b", base), (3, "c", base + "x"), (4, "d", base.replace("fox", "cat")), (5, "a", base + "y"), (6, "e", "short")]
    df = spark.createDataFrame(rows, "id long, g string, t string")
    got = {(r.id_a, r.id_b) for r in audit.copies(df, "id", "g", "t").collect()}
    assert {(1, 2), (1, 3), (2, 3), (2, 5), (3, 5)} <= got and not any(6 in p for p in got)


def test_copies_in_blocks_equal_brute_force_and_few_are_compared(spark, monkeypatch):
    """Texts in an alphabet of few bigrams share all of their rarest bigrams; few pairs may be compared in full all the same."""
    from collections import Counter

    monkeypatch.setattr(audit, "BLOCK", 20)
    rng, texts = random.Random(5), []
    for _ in range(60):
        base = [rng.choice("abcd") for _ in range(rng.choice([120, 130, 900, 4000]))]
        texts.append("".join(base))
        for _ in range(rng.choice([0, 1, 3])):
            other = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 150])):
                other[rng.randrange(len(other))] = rng.choice("abcdé")
            texts.append("".join(other) + rng.choice(["", "a", "中"]))
    rows = [(i, f"g{i % 7}", t) for i, t in enumerate(texts)]
    bags = [Counter(zip(t, t[1:], strict=False)) for t in texts]
    firsts = {}
    for i, t in enumerate(texts):
        firsts.setdefault((t, i % 7), i)
    want = set()
    for (s, g), i in firsts.items():
        for (t, h), j in firsts.items():
            if i < j and g != h and round(2 * (bags[i] & bags[j]).total() / (len(s) + len(t) - 2), 4) >= 0.99:
                want.add((i, j))
    near = []
    keep = audit.settle
    monkeypatch.setattr(audit, "settle", lambda df, name: (near.append(df.count()) if name == "near-copies" else None, keep(df, name))[1])
    got = {(r.id_a, r.id_b) for r in audit.copies(spark.createDataFrame(rows, "id long, g string, t string"), "id", "g", "t").collect()}
    assert got == want and len(want) > 20
    assert near and near[0] < 2 * len(want) + 60


def test_delays_and_queue(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "n int")
    assert [r.d for r in df.select(topics.delay(F.col("n")).alias("d")).collect()] == [300.0, 600.0, 1200.0, 2400.0, 3600.0, 3600.0, 3600.0]
    lanes = spark.createDataFrame([(0, i, f"a{i}") for i in range(3)] + [(1, i, f"b{i}") for i in range(2)], "lane int, seq int, topic string")
    assert [r.topic for r in topics.interleave(lanes, 1, 4).collect()] == ["a1", "b1", "a2", "b0"]
    runs = spark.createDataFrame([(1, 0, 2), (1, 1, 99), (1, 2, 99)], "run int, seq int, wanted int")
    assert [r.pages for r in topics.page_budgets(runs, 10).orderBy("seq").collect()] == [2, 4, 4]
    files = spark.createDataFrame([(f"f{i}", 10, float(i * 40000)) for i in range(6)], "name string, size int, modified double")
    assert sorted(r.name for r in topics.cache_sweep(files, 35).collect()) == ["f3", "f4", "f5"]


def test_provider_rules(spark):
    df = spark.createDataFrame([("30", "2026-01-01 00:00:00"), ("Thu, 01 Jan 2026 00:01:00 GMT", "2026-01-01 00:00:00"), ("soon", "2026-01-01 00:00:00")], "v string, t string")
    assert [r.s for r in df.select(providers.retry_after(F.col("v"), F.col("t").cast("timestamp")).alias("s")).collect()] == [30.0, 60.0, 0.0]
    blocks = spark.createDataFrame([("q", i, n) for i, n in enumerate([3000, 2500, 1000, 500, 100])], "q string, seq int, size int")
    got = {r.seq: r.batch for r in providers.batches(blocks, "q", "seq", "size").collect()}
    assert got == {0: 0, 1: 0, 2: None, 3: 0, 4: 1}
    results = spark.createDataFrame([("q", 1, "http://a/x#1", "community"), ("q", 2, "http://a/x/", "official"), ("q", 3, "http://b", "official")], "query string, seq int, url string, source_type string")
    assert [(r.url, r.rank) for r in providers.search_dedupe(results).orderBy("rank").collect()] == [("http://b", 1), ("http://a/x#1", 2)]


def test_crawl(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "url string, to string")
    got = {r.url: r.round for r in pages.crawl(spark.createDataFrame([("a",)], "url string"), links, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_snapshot(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"version": 1, "documents": [{"url": "u", "title": "t", "chunks": ["x", "y"]}], "facts": [{"title": "f", "answer": "a", "confidence": 0.5}]}')
    docs, chunks, facts_ = snapshot.read_snapshot(spark, str(tmp_path / "s.json"))
    assert [(r.url, r.ord, r.text) for r in chunks.collect()] == [("u", 0, "x"), ("u", 1, "y")] and docs.count() == facts_.count() == 1
    snapshot.export(facts_, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert snapshot.shrinks(chunks, docs).first().refused


def test_streams(spark, tmp_path):
    folder, out = str(tmp_path / "in"), []
    spark.createDataFrame([(1, "2026-01-01 00:10:00", 5, "view", 1.0), (2, "2026-01-01 00:50:00", 5, "view", 2.0), (3, "2026-01-01 03:00:00", 5, "click", 3.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(folder)
    ev.run_once(ev.tumbling(ev.read_events(spark, folder)), lambda df, _: out.extend(df.collect()), str(tmp_path / "c1"))
    assert [(r.event_type, r.n, r.total) for r in out] == [("view", 2, 3.0)]
    spark.createDataFrame([("t", 100.0, False), ("t", 500.0, False), ("u", 1.0, True)], "topic string, at double, ok boolean").coalesce(1).write.parquet(str(tmp_path / "at"))
    seen = []
    attempts = spark.readStream.schema("topic string, at double, ok boolean").parquet(str(tmp_path / "at"))
    ev.run_once(ev.retry_state(attempts), lambda df, _: seen.extend(df.collect()), str(tmp_path / "c2"), "update")
    assert {(r.topic, r.retry_count, r.next_retry_at, r.done) for r in seen} == {("t", 2, 1100.0, False), ("u", 0, 0.0, True)}


@pytest.mark.parametrize("chars", [4_000_000, 40])
def test_names_equal_a_search_for_each(spark, monkeypatch, chars):
    monkeypatch.setattr(names, "NAME_CHARS", chars)
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("ab甲é𝄞") for _ in range(n))
    known = [*{make(rng.choice([1, 2, 3, 5])) for _ in range(40)}, "aa", "aaa"]
    texts = [(i, make(rng.choice([0, 3, 30]))) for i in range(60)] + [(60, None), (61, "aaaaaaa"), (61, "aa")]
    frame = spark.createDataFrame(texts, "id long, t string")
    listed = spark.createDataFrame([(n,) for n in [*known, None, "", "aa"]], "name string")
    got = sorted((r.id, r.name, r.at, r.n) for r in names.mentions(frame, listed, "id", "t").collect())
    assert got == sorted((i, n, t.index(n) + 1, t.count(n)) for i, t in texts if t for n in set(known) if n in t)
    shown = {r.id: r.names for r in names.present(frame.filter("id < 60"), listed, "id", "t", 3).collect()}
    assert shown == {i: x for i, t in texts[:60] if len(x := sorted(n for n in set(known) if n in t)) >= 3}
    assert names.mentions(frame, listed.limit(0), "id", "t").count() == 0 and names.mentions(frame.limit(0), listed, "id", "t").count() == 0
    rows = spark.createDataFrame([(1, "aaa", "b aa aa b"), (2, "b", "b aa aa"), (3, "é", "aa"), (4, "", "aa aa")], "id int, own string, t string")
    assert [(r.id, r.other, r.n) for r in audit.misattributed(rows, spark.createDataFrame([("aa",), ("b",)], "name string"), "id", "own", "t").collect()] == [(1, "aa", 2)]


def test_fold_finds_the_keepers_that_a_serial_fold_finds():
    rng = random.Random(6)
    for _ in range(60):
        alphabet = rng.choice(["ab", "abc12", "甲乙丙。；，12 "])
        rows = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 8, 20]))) for _ in range(40)]
        kept, serial = facts_py.Keepers(), []
        for text in rows:
            new = facts_py.Answer(text)
            want = next((i for i, k in enumerate(serial) if facts_py.compare(k, text)[0] == "duplicate"), None)
            assert kept.first_repeated_by(new) == want
            if want is None:
                kept.add(new)
                serial.append(text)
            else:
                serial[want] = facts_py.merge_answers(serial[want], text)
                assert kept.merge(want, new) == serial[want]
        assert [k.text for k in kept.answers] == [s.strip() for s in serial]


def test_simhash_keys_and_brute_force(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = list({x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for x in base for _ in range(12)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame(list(enumerate(signed)), "id long, simhash long")
    got = [(r.id, r.other, r.distance) for r in dedupe.simhash_neighbours(rows, rows).collect()]
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(values) for j, b in enumerate(values) if i != j and (a ^ b).bit_count() <= 3 and ((a ^ b) >> 48).bit_count() <= 2}
    assert set(got) == want and len(got) == len(want) > 100
    masks = {m & (1 << 64) - 1 for m in dedupe._key_masks()}
    assert len(masks) == 20 and {m.bit_count() for m in masks} <= {31, 32, 33}


def test_fingerprints_that_differ_in_neighbouring_bits_share_few_keys():
    """Each key has bits of the whole fingerprint: half of it equal in all rows doesn't put them all under one key."""
    rng = random.Random(3)
    for at in (0, 16, 32):
        values = [rng.getrandbits(32) << at for _ in range(3000)]
        for m in dedupe._key_masks():
            assert max(Counter(v & m for v in values).values()) < 30


def test_votes_of_long_texts():
    rng = random.Random(5)
    rows = [["a"], [], ["a"] * 255 + ["b"] * 254, ["b"] * 70_000 + ["c"] * 70_000, [], [f"w{rng.randrange(40)}" for _ in range(1021)], ["x"] * 256 + ["y"] * 256]

    def plain(tokens):
        votes = [sum(n if dedupe.fnv1a64(w.encode()) >> i & 1 else -n for w, n in Counter(tokens).items()) for i in range(64)]
        return sum(1 << i for i, v in enumerate(votes) if v > 0)

    assert [int(h) % 2**64 for h in dedupe.simhashes(rows)] == [plain(r) for r in rows]


def test_simhash_neighbours_are_all_pairs_and_members(spark, tmp_path):
    from tidemark.operators import dedupe
    from tidemark.plans import catalog

    hashes = [0] + [1 << i for i in range(30)]
    rows = spark.createDataFrame(list(enumerate(hashes)), "id long, simhash long")
    got = {(r.id, r.other, r.distance) for r in dedupe.simhash_neighbours(rows, rows).collect()}
    assert got == {(i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i != j}
    texts = ["the same words here again"] * 25 + ["quite another text about boats"]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = catalog.queries()["simhash_neighbours"](spark, str(tmp_path)).filter("member").collect()
    assert {(r.id, r.other, r.distance) for r in out} == {(i, 0, 0) for i in range(1, 25)}


def test_duplicates_are_found_without_broadcast_facts(spark):
    """The planner takes a fact's twenty keys for one row, so its facts' keys went through the driver."""
    from tidemark.operators import dedupe

    facts = spark.createDataFrame([(1, "a", "one two 3", 0.5, "", 5)], "id long, title string, answer string, confidence double, updated_at string, simhash long")
    asked = spark.createDataFrame([(7, "a", "one two 3", 5), (8, "b", "one two 3", 5)], "cid long, title string, answer string, simhash long")
    found = dedupe.find_duplicate(asked, facts)
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.cid, r.id, r.action) for r in found.collect()) == [(7, 1, "duplicate"), (8, 1, "duplicate")]


def test_made_up_reply_stands_in_no_page(spark, tmp_path):
    """A page may well have a third of plain words, which makes them grounded."""
    from tidemark.plans import store_queries

    text = "nothing of this is new. " + "some words of a page that go on for a while " * 6
    spark.createDataFrame([(1, text, "en", "s"), (2, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.title for r in store_queries.extract_facts(spark, str(tmp_path)).collect()} == {"one"}


def test_added_facts_are_rows_beside_stored_ones(spark):
    """A new fact's number may be taken; the stored fact under it goes its own way."""
    from tidemark.operators import store

    facts = spark.createDataFrame([(1, "a", "x", "active", None), (11, "b", "y", "active", None), (2, "c", "z", "active", None)], "id long, title string, answer string, status string, superseded_by long")
    changes = [(1, "supersede", 1, "a", "", 11), (11, "add", 1, "a", "new", None), (11, "supersede", 1, "b", "", 21), (21, "add", 1, "b", "newer", None), (2, "delete", 1, "c", "", None), (5, "update", 1, "e", "v", None), (6, "add", 1, "f", "w", None), (6, "delete", 2, "f", "", None)]
    got = store.apply_changes(facts, spark.createDataFrame(changes, "id long, op string, seq int, title string, answer string, new_id long"))
    rows = sorted(tuple(r) for r in got.select("id", "title", "answer", "status", F.coalesce("superseded_by", F.lit(0))).collect())
    assert rows == [(1, "a", "x", "superseded", 11), (11, "a", "new", "active", 0), (11, "b", "y", "superseded", 21), (21, "b", "newer", "active", 0)]


def test_no_copy_is_lost(spark):
    """Copies in one group, texts under their own template heads, marks that count, rows without a group and repeated keys: pairs and members give all pairs of rows."""
    base = "the quick brown fox jumps over the lazy dog and runs away from all the hounds of the county " * 2
    rows = [(1, "a", base), (2, "a", base), (3, "b", base), (4, "b", base + " "), (5, None, base), (6, None, base), (7, "c", "Fox：" + base), (8, "d", "Dog: " + base)]
    rows += [(20, "a", "-" * 400 + "one end of it"), (21, "b", "-" * 400 + "one and of it"), (30, "a", "I am: a " * 5 + "x"), (31, "b", "a b c d e f g h i j k l m n o p q r s t u"), (32, "c", "a b c d e f g h i j k l m n o p q r s t u")]
    rows += [(40, "a", "y" * 39), (41, "b", "y" * 39), (42, "e", None), (43, "e", "\u3000 "), (50, "a", "first " + base[::-1]), (50, "b", "again " + "z" * 90), (51, "c", "first " + base[::-1]), (52, "d", "again " + "z" * 90)]

    def body(t):
        for mark in "：:":
            head, sep, tail = (t or "").partition(mark)
            if sep and len(head) <= 40:
                return tail.strip()
        return (t or "").strip()

    def dice(s, t):
        x, y = (Counter(zip(u, u[1:], strict=False)) for u in ("".join(s.split()), "".join(t.split())))
        return 2 * (x & y).total() / max(1, x.total() + y.total())

    told = [(i, g, body(t)) for i, g, t in rows if len(body(t)) >= 40]
    want = {tuple(sorted((i, j))) for n, (i, g, s) in enumerate(told) for j, h, t in told[:n] if g != h and dice(s, t) >= 0.99}
    df = spark.createDataFrame(rows, "id long, g string, t string").repartition(3)
    pairs = audit.copies(df, "id", "g", "t")
    members = audit.copy_members(df, pairs, "id", "g", "t").collect()
    of = lambda i: [i, *(m.id for m in members if m.first == i)]
    got = {tuple(sorted((i, j))) for r in pairs.collect() for i in of(r.id_a) for j in of(r.id_b)}
    assert got == want and {(2, 4), (5, 8), (20, 21), (31, 32), (50, 51), (50, 52)} <= want


def test_facts_are_stored_one_after_the_other(spark):
    """Later facts meet what earlier ones have added or changed, in their title and by fingerprint; trust, version, status and confirmations follow."""
    far = lambda i: facts_far[i]
    facts_far = [random.Random(i).getrandbits(63) for i in range(100)]
    stored = [(1, "早雾·攻击力", "攻击力为 90 点", None, "https://a.example/x#top", 0.5, "", far(1), "active"), (2, "薄荷·攻击力", "攻击力为 90 点", "", "", 0.9, "", far(2), "revoked")]
    same, day = "从北边的山口往下走到湖边再往东", "2027-01-05"
    rows = [
        (10, " 早雾·攻击力 ", "攻击力为 90 点", "t", "https://b.example/y", far(10), None),  # confirms 1
        (11, "早雾·攻击力", "攻击力为 95 点", "t", "https://b.example/y", far(11), None),  # in conflict with 1
        (12, "早雾·攻击力", "攻击力为 95 点。", "t", "https://c.example/z", far(12), None),  # repeats 11
        (13, "薄荷·攻击力", "攻击力为 90 点", "t", "u", far(13), None),  # 2 isn't usable
        (14, "1.4版本活动", "何时开始", "t", "u", far(14), None),
        (15, "空", " ", "t", "u", far(15), None),
        (16, "日程", "写明出处的一条", "t | 叙事", "u", far(16), day),
        (20, "路线甲", same, "t", "https://a.example/x", far(20), None),
        (21, "路线乙", same + "走", "t", "https://a.example/x/", far(20) ^ 1, None),  # repeats 20, from the same page
        (22, "路线丙", same + "走", "t", "https://d.example/", far(20) ^ 3, None),  # repeats 20 as 21 was merged into it
    ]
    facts = spark.createDataFrame(stored, "id long, title string, answer string, tags string, source_url string, confidence double, updated_at string, simhash long, status string")
    fresh = spark.createDataFrame(rows, "cid long, title string, answer string, tags string, source_url string, simhash long, published string").withColumn("source_type", F.lit("wiki")).repartition(4)
    out, changed = ingest.store(facts, fresh, "api", as_of=F.lit("2027-02-01").cast("timestamp"), extra_tag="叙事")
    got = {r.cid: r for r in out.collect()}
    assert {i: (r.outcome, r.target, r.target_cid) for i, r in got.items()} == {
        10: ("merged", 1, None), 11: ("conflict", 1, None), 12: ("merged", None, 11), 13: ("added", None, None), 14: ("added", None, None),
        16: ("added", None, None), 20: ("added", None, None), 21: ("merged", None, 20), 22: ("merged", None, 20),
    }
    plain = round(0.45 * 0.75 + 0.25 + 0.2 * 0.6 + 0.1 * 0.7, 4)
    assert (got[11].status, got[11].tags, got[11].confidence) == ("conflict", "t | 冲突:numbers | 叙事 | 并入:c.example | 多源确认", round(plain + 0.08, 4))
    assert (got[13].status, got[13].confidence, got[10].status, got[10].confidence) == ("active", plain, None, None)
    assert (got[14].version, got[14].confidence) == ("1.4", round(plain - 0.07 + 0.1 * 0.49, 4))
    assert (got[16].tags, got[16].confidence) == ("t | 叙事", round(plain + 0.03, 4))
    assert got[20].answer == same + "走" and got[20].tags == "t | 叙事 | 并入:a.example | 并入:d.example | 多源确认"
    assert [tuple(r) for r in changed.collect()] == [(1, "攻击力为 90 点", "并入:b.example | 多源确认", 0.58)]
