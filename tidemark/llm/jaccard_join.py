"""N-gram Jaccard join (op 13): all links of documents at or above a similarity, by a grouped prefix join.

A text's set is its distinct shingles of three lower-cased words. In one order of all shingles, two sets of a similarity of 0.9 or more have a shingle in common
among the first n - ceil(0.9 n) + 1 of each, their prefixes.

1. The order. Shingles are counted by slot, the 16 top bits of their hash: in how many documents' sets the slot's shingles stand, over all documents. A task
   sums its own slots, so 65,536 numbers a task are dealt out, and as many go to every task. The order is by the count of the slot, then by hash: whatever
   very many documents share stands last and is in few prefixes. The order decides what is compared, never what is found.
2. Documents with equal sets are one node.
3. What meets. One shingle is in ever more prefixes as a corpus grows, so nodes don't meet on shingles one by one but on groups of them. In a class of sizes two linked
   sets differ in at most d shingles. A set is dealt by hash into half as many groups again as d + 1, so all but d groups of two linked sets are equal, and the first d + 1 groups
   of each, in one order of all groups, the one that weighs most by its shingles' places in the order of counts first, have an equal one: a prefix of groups. Each has a row.
   A set that fits sets of the next class of sizes has rows there too.
4. In a bucket (nodes with an equal group) of up to ``SMALL`` nodes all are paired; of a larger one each node is paired with the first. Pairs are merged, then filtered by the prefixes of
   shingles: a shingle of the one that stands before the other's last one and isn't in the other is missing there, which bounds what the two can share. What is left is verified on
   the full sets of their texts. Links are joined to components.
5. Rest: large buckets whose nodes are still in different components. The links between those are found exactly by the join on
   differences from a cluster's middle, see ``near_dedup.rest_pairs``. So no bucket is expanded to all pairs, and none is capped.

Any linked pair shares a bucket, so it is compared, or both have one component already, or both are in the rest: no link between components
is lost.

Edge cases: null, empty and blank texts have size 0 and are linked with nothing; a null key is linked with nothing and has a null component. Fewer than
three words are one shingle. Rows that share a key are one node where that key is the smallest of its component. Keys are whole numbers. Other columns, of
whatever names, don't reach the operator. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.near_dedup import PICK_IDS, confirm, fits, rest_pairs, sets_of
from tidemark.llm.storage import Workspace, prepare
from tidemark.llm.words import mix

#: Words of a shingle; links have 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 3, 90
#: Bits of a hash that name its slot.
SLOT_BITS = 16
#: Nodes of a bucket up to which all are paired.
SMALL = 16
#: The sizes of a class are up to so many times the least, unless sizes that fit differ by more.
WIDTH = 1.4

_TOP = np.uint64(1 << 63)


def _slots(shingle: int):
    """Batches of text to slot and n: in how many sets of the task's documents the slot's shingles stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for _, sets in sets_of(batch.column("text"), shingle):
                if sets:
                    seen += np.bincount((np.concatenate(sets) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
        slots = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(seen[slots])], names=["slot", "n"])

    return run


def slot_ranks(docs: DataFrame, shingle: int) -> np.ndarray:
    """The place of each slot in the order of counts: at most 65,536 sums, whatever the documents."""
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for row in docs.select("text").mapInArrow(_slots(shingle), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[row.slot] = row.n
    ranks = np.empty(1 << SLOT_BITS, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(1 << SLOT_BITS, dtype=np.uint64)
    return ranks


def _classes(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest size of each class, and the most shingles in which two linked sets differ whose larger one is in the class.

    Linked sets of na and nb share percent * (na + nb) / (100 + percent) or more, so they differ in (na + nb) * (100 - percent) / (100 + percent) at most. In the
    first class that is none: its linked sets are equal.
    """
    high = [largest if percent == 100 else -(-(100 + percent) // (2 * (100 - percent))) - 1]
    while high[-1] < largest:
        high.append(max(int(high[-1] * WIDTH), 100 * high[-1] // percent, high[-1] + 1))
    high = np.array(high, np.int64)
    return high, 2 * high * (100 - percent) // (100 + percent)


def _group_keys(sets: list[np.ndarray], which: np.ndarray, place: np.ndarray, differ: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the first groups of sets[which], each in its class (place), end to end, and how many each has."""
    if not len(which):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    every, sizes = np.concatenate([sets[i] for i in which]), np.fromiter((len(sets[i]) for i in which), np.int64, len(which))
    need = differ[place] + 1
    groups = need + (need + 1) // 2
    base = np.cumsum(groups) - groups
    at = np.repeat(base, sizes) + (every % np.repeat(groups, sizes).astype(np.uint64)).astype(np.int64)
    weight = np.bincount(at, weights=(1 << SLOT_BITS) - ranks[every >> np.uint64(64 - SLOT_BITS)].astype(np.float64), minlength=int(groups.sum()))
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
    content = np.zeros(len(weight), np.uint64)
    content[at[order[starts]]] = np.add.reduceat(mix(every, ~every)[order], starts)
    of = np.repeat(np.arange(len(which)), groups)
    keys = mix(content, (place[of] << 40 | (np.arange(len(weight)) - base[of])).astype(np.uint64))
    order = np.lexsort((keys, -weight, of))
    return keys[order][np.arange(len(weight)) - base[of] < need[of]], need


def _keys(sets: list[np.ndarray], sizes: np.ndarray, percent: int, ranks: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The keys by which each set meets others, those of its own class first, and how many these are."""
    high, differ = _classes(percent, int(sizes.max(initial=0)) * 100 // percent + 1)
    place = np.searchsorted(high, sizes)
    own = np.flatnonzero((sizes > 0) & (differ[place] > 0))
    guests = np.flatnonzero((sizes > 0) & (100 * sizes // percent > high[place]))
    parts = [_group_keys(sets, own, place[own], differ, ranks), _group_keys(sets, guests, place[guests] + 1, differ, ranks)]
    of = np.concatenate([np.repeat(own, parts[0][1]), np.repeat(guests, parts[1][1])])
    owned = np.zeros(len(sets), np.int32)
    owned[own] = parts[0][1]
    order = np.argsort(of, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sets)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([parts[0][0], parts[1][0]])[order].view(np.int64))), pa.array(owned)


def _prefixed(shingle: int, percent: int, ranks: np.ndarray, keyed: bool = False):
    """Batches of key and text to key, set size, two hashes of the set, its prefix, and the keys by which it meets others if wanted.

    A shingle's hash gets its slot's rank for top bits, which names it as well, and makes the order that of numbers.
    """
    low = np.uint64((1 << (64 - SLOT_BITS)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sets in sets_of(batch.column("text"), shingle):
                sizes, marks, prefixes = np.fromiter(map(len, sets), np.int64, len(sets)), np.zeros((2, len(sets)), np.uint64), []
                for i, own in enumerate(sets):
                    if len(own):
                        marks[0, i], marks[1, i] = mix(own, own).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(own, ~own))
                    k = len(own) - -(-percent * len(own) // 100) + 1 if len(own) else 0
                    ordered = (ranks[own >> np.uint64(64 - SLOT_BITS)] << np.uint64(64 - SLOT_BITS)) | (own & low)
                    ordered = np.sort(np.partition(ordered, k - 1)[:k] if 0 < k < len(ordered) else ordered[:k])
                    prefixes.append((ordered ^ _TOP).view(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *prefixes])))
                keys = batch.column("doc_id").slice(int(rows[0]), len(rows))
                more = _keys(sets, sizes, percent, ranks) if keyed else ()
                names = ["doc_id", "n", "h1", "h2", "prefix", "keys", "owned"]
                yield pa.RecordBatch.from_arrays([keys, pa.array(sizes), *(pa.array(m.view(np.int64)) for m in marks), listed, *more], names=names[: 5 + len(more)])

    return run


def _may_share(percent: int) -> Column:
    """Two sets (n_a, prefix_a and n_b, prefix_b) can still be similar enough, as far as the prefixes tell."""
    total = percent * (F.col("n_a") + F.col("n_b"))

    def enough(n: str, own: str, other: str) -> Column:
        last = F.element_at(other, -1)
        missing = F.size(F.filter(F.array_except(own, other), lambda e: e < last))
        return (100 + percent) * (F.col(n) - missing) >= total

    return enough("n_a", "prefix_a", "prefix_b") & enough("n_b", "prefix_b", "prefix_a")


def link_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id: a row for each of docs."""
    spark = docs.sparkSession
    prepare(spark)
    work = Workspace(spark, "jaccard")
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    run = _prefixed(shingle, percent, slot_ranks(docs, shingle), keyed=True)
    signed = work.write(docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, prefix array<long>, keys array<long>, owned int"), "signatures")
    linked = signed.filter("n > 0 AND doc_id IS NOT NULL")
    first = [F.first(c).alias(c) for c in ("prefix", "keys", "owned")]
    nodes = work.write(linked.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node"), *first), "nodes")

    dealt = nodes.select("node", "n", "owned", F.posexplode("keys").alias("at", "key"))
    # dealt out once, for the counts and for the rows that meet; a guest of a class is one of the class before
    dealt = dealt.select("key", "node", "n", (F.col("at") >= F.col("owned")).alias("guest")).repartition("key")
    shared = dealt.groupBy("key").agg(F.count("*").alias("total"), F.min(F.struct("guest", "n", "node")).alias("first")).filter("total > 1 AND NOT first.guest")
    buckets = work.write(dealt.join(shared, "key").select("key", "node", "n", "guest", "total", "first"), "buckets")

    both = buckets.filter(F.col("total") <= SMALL)
    x, y = (both.select("key", F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("guest").alias(f"guest_{c}")) for c in "ab")
    small = x.join(y, "key").filter((F.col("a") < F.col("b")) & ~(F.col("guest_a") & F.col("guest_b")) & fits("n_a", "n_b", percent)).select("a", "b")
    large = buckets.filter((F.col("total") > SMALL) & (F.col("node") != F.col("first.node")) & fits("n", "first.n", percent))
    large = large.select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b"))
    met = work.write(small.unionByName(large).distinct(), "met")
    a, b = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("prefix").alias(f"prefix_{c}")) for c in "ab")
    pairs = work.write(met.join(a, "a").join(b, "b").filter(_may_share(percent)).select("a", "b"), "pairs")

    # the nodes of large buckets may stay in different components: their texts are picked too
    crowds = work.write(buckets.filter(F.col("total") > SMALL).select("key", "node"), "crowds")
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowds.select("node"))
    ids = work.write(ids.distinct(), "ids")
    picked = F.broadcast(ids) if ids.count() <= PICK_IDS else ids
    texts = work.write(docs.join(picked, docs.doc_id == picked.node, "left_semi"), "texts")

    def confirmed(wanted: DataFrame, name: str) -> DataFrame:
        first = wanted.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        both = first.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        return work.write(both.select("a", "text_a", "b", "text_b").mapInArrow(confirm(shingle, percent), "a long, b long"), name)

    labels = components(confirmed(pairs, "links"), work)
    placed = work.write(crowds.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "placed")
    split = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key", "low")
    open_ = work.write(placed.join(split, "key").select("node", "label", "low").distinct(), "open")
    if not open_.isEmpty():
        more = confirmed(work.write(rest_pairs(open_, texts, work, shingle, percent), "rest-pairs"), "rest-links")
        named = open_.select("node", "label").distinct()
        left, right = (named.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in "ab")
        joined = components(more.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")), work, "joined")
        joined = joined.select(F.col("node").alias("label"), F.col("label").alias("_joined"))
        labels = labels.unionByName(named).distinct().join(joined, "label", "left").select("node", F.coalesce("_joined", "label").alias("label"))
    named = nodes.select("h1", "h2", "n", "node").join(work.write(labels, "node-labels"), "node", "left").select("h1", "h2", "n", F.coalesce("label", "node").alias("component_id"))
    named = work.write(named, "named")  # so that the copies of one text are the hot side of a plain join, which Spark can split
    work.drop("nodes", "buckets", "met", "pairs", "crowds", "ids", "texts", "links", "placed", "open", "members", "sizes", "prefixes", "rest-pairs", "rest-links", "labels-0", "node-labels")
    alone = signed.filter("NOT (n > 0 AND doc_id IS NOT NULL)").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"]).select("doc_id", "n", "component_id").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def query(spark, sf_dir):
    return link_sets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
e AS (SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {SHINGLE} + 2), lambda i: array_to_string(ws[i:i + {SHINGLE} - 1], ' ')) END)) AS s FROM d WHERE len(ws) > 0),
n AS (SELECT min(rid) AS node, min(doc_id) AS doc_id, s, len(s) AS n FROM e GROUP BY s),
g AS (SELECT node, n, unnest(s) AS x FROM n),
p AS (SELECT a.node AS a, b.node AS b FROM g a JOIN g b ON a.x = b.x AND a.node <> b.node AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
r(a, b) AS (SELECT node, node FROM n UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT r.a AS node, min(n.doc_id) AS component_id FROM r JOIN n ON n.node = r.b GROUP BY r.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM d LEFT JOIN e USING (rid) LEFT JOIN n ON n.s = e.s LEFT JOIN c ON c.node = n.node
"""
