"""MinHash near-dedup (op 8) with tensored banding.

A text's set is its distinct shingles of five lower-cased words. Two small collections of ``KEYS`` keys each, of
``HASHES`` minhashes a key, are computed; the table keys are all pairs of a key of the first and one of the second
collection. So KEYS * KEYS tables of 2 * HASHES minhashes each cost 2 * KEYS * HASHES minhashes instead of their product. With
8 and 3, a pair at similarity 0.85 meets in some table with probability 0.999, at 0.9 with 0.99994.

1. One pass over the texts writes a row per document: set size, two 64-bit set hashes, the two collections.
2. Documents with equal sets become one node, so that groups of copies cost one row. Counts are merged before dealing.
3. Nodes are counted by table key. In a bucket of two nodes or more each is paired with the bucket's first one by set size:
   a pair a member, never all pairs of a group. Pairs are confirmed on the full sets of their texts, and links are joined to
   components.
4. Rest: buckets whose members are still in different components may hold further links. They are joined to clusters
   (each component to the bucket's smallest), and in each cluster the links between components are found exactly, whatever its
   size: see ``rest_pairs``.

The rest's join. For a set R, let a member A have r = |R - A| and a = |A - R|, w = 100 r + 85 a, and D = (R - A) + (A - R). For two
members, |A & B| = |R| - r_A - r_B + |D_A & D_B|, so the two are linked just if

    w_A + w_B - 185 |D_A & D_B| <= 15 |R|

R is the middle of a cluster, so D is small where a crowd stands around one text. Two members whose w alone are small enough are
both linked with the member of least w, which is compared with all. All others must share t = (w_A + w_B - 15 |R|) / 185
elements of D or more, so among the first |D| - t + 1 of each in one order of all elements some are shared. They meet in an equi-join
on these, with the least w that a partner can have for t: for the smaller one its own, for the larger one 0. The order puts what
few members have first, and the places in it bound what a pair can still share, so that texts that have just the crowd's common
part in common hardly ever meet. R and the order are taken from ``MIDDLE`` members at most: they decide what is compared, never what is found.

Edge cases: null, empty and blank texts have size 0 and are linked with nothing; a null doc_id is linked with nothing,
has a null component and is kept. Fewer than five words are one shingle. Rows that share a doc_id are one node where that id
is the smallest of its group. Keys are whole numbers; texts that aren't end in Spark's cast error. Extra columns, of any names, pass through ``keep_first``. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.storage import Workspace, prepare, spare
from tidemark.llm.words import blocks, mix

SHINGLE, KEYS, HASHES = 5, 8, 3
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Members and bytes of text of a part of a cluster, and members that give a cluster's middle.
PART, PART_BYTES, MIDDLE = 200, 8_000_000, 64
#: Up to so many ids, the texts to confirm are picked by a broadcast of the ids (8 bytes each), beyond by a shuffle.
PICK_IDS = 500_000

_rng = np.random.Generator(np.random.PCG64(8))
_XOR = _rng.integers(0, 2**64, 2 * KEYS * HASHES, np.uint64)
_MUL = _rng.integers(0, 2**64, 2 * KEYS * HASHES, np.uint64) | np.uint64(1)
_SIGNED = pa.list_(pa.int64())


def sets_of(texts, shingle: int = SHINGLE) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Row numbers and their sets, as sorted 64-bit hashes."""
    for block in blocks(texts, lower=True):
        hashes, bounds = block.shingles(shingle)
        yield block.rows, [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, sets in sets_of(batch.column("text")):
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            keys = np.zeros((len(sets), 2 * KEYS), np.uint64)
            marks = np.zeros((2, len(sets)), np.uint64)
            full = np.flatnonzero(sizes)
            if len(full):
                every = np.concatenate(sets)
                at = (np.cumsum(sizes) - sizes)[full]
                lows = [np.minimum.reduceat((every ^ x) * m, at) for x, m in zip(_XOR, _MUL, strict=True)]
                for k in range(2 * KEYS):
                    key = lows[k * HASHES]
                    for low in lows[k * HASHES + 1 : (k + 1) * HASHES]:
                        key = mix(key, low)
                    keys[full, k] = key
                marks[0, full] = np.add.reduceat(mix(every, every), at)
                marks[1, full] = np.bitwise_xor.reduceat(mix(every, ~every), at)
            signed = keys.view(np.int64)
            offsets = np.arange(len(sets) + 1, dtype=np.int32) * KEYS
            lists = [pa.ListArray.from_arrays(offsets, np.ascontiguousarray(part).ravel()) for part in (signed[:, :KEYS], signed[:, KEYS:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(int(rows[0]), len(rows)), pa.array(sizes), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)), *lists],
                names=["doc_id", "n", "h1", "h2", "left", "right"],
            )


def confirm(shingle: int = SHINGLE, percent: int = PERCENT):
    """Batches of a, text_a, b and text_b to the pairs whose sets are similar enough; of each batch, each text is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = {}, []
            for side in ("a", "b"):
                own = batch.column(side).to_numpy()
                _, first = np.unique(own, return_index=True)
                new = [i for i in first if own[i] not in ids]
                texts = batch.column(f"text_{side}").take(pa.array(new, pa.int64()))
                for _, got in sets_of(texts, shingle):
                    sets += got
                for i in new:
                    ids[own[i]] = len(ids)
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            good = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                p, q = sets[ids[x]], sets[ids[y]]
                shared = len(np.intersect1d(p, q, assume_unique=True))
                good[i] = 100 * shared >= percent * (len(p) + len(q) - shared) and shared > 0
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return run


def _middle(shingle: int):
    """Of some members of a cluster: what a quarter of them or more have, in order of how many differ in it, and which of that half of them have."""

    def run(table: pa.Table) -> pa.Table:
        sets = [x for _, part in sets_of(table.column("text"), shingle) for x in part]
        every, count = np.unique(np.concatenate(sets), return_counts=True)
        common = 4 * count > len(sets)
        every, count = every[common], count[common]
        order = np.argsort(np.minimum(count, len(sets) - count), kind="stable")
        half = (2 * count > len(sets))[order]
        return pa.table({"cluster": table.column("cluster").slice(0, 1), "common": pa.array([every[order].tobytes()], pa.binary()), "half": pa.array([np.packbits(half).tobytes()], pa.binary())})

    return run


_PREFIX = "cluster long, node long, label long, w long, size long, middle long, place int, element long, indexed boolean"


def _parts_of_cluster(shingle: int, percent: int):
    """For each member of a part, the elements of its difference from the middle by which it may meet others."""

    def run(members: pa.Table, middle: pa.Table) -> pa.Table:
        common = np.frombuffer(middle.column("common")[0].as_py(), np.uint64)
        half = np.unpackbits(np.frombuffer(middle.column("half")[0].as_py(), np.uint8), count=len(common)).astype(bool)
        center, place = np.sort(common[half]), np.argsort(common)
        known, n = common[place], len(center)
        columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        nodes, labels = members.column("node").to_numpy(), members.column("label").to_numpy()
        sets = [x for _, part in sets_of(members.column("text"), shingle) for x in part]
        for node, label, own in zip(nodes, labels, sets, strict=True):
            lacks, more = np.setdiff1d(center, own, assume_unique=True), np.setdiff1d(own, center, assume_unique=True)
            w, size = 100 * len(lacks) + percent * len(more), len(lacks) + len(more)
            # one order for all members: elements outside the common ones by hash, then the common ones as given; an element that
            # one member lacks and another has beyond the middle can't be, so a plain hash names it
            diff = np.concatenate([lacks, more])
            at = np.searchsorted(known, diff)
            at[at == len(known)] = 0
            listed = known[at] == diff if len(known) else np.zeros(len(diff), bool)
            rank = np.where(listed, place[at] + 1 if len(known) else 0, 0)
            diff = diff[np.lexsort((diff, rank))]
            probe = min(size, size - max(1, -(-(w - (100 - percent) * n) // (100 + percent))) + 1)
            index = min(size, size - max(1, -(-(2 * w - (100 - percent) * n) // (100 + percent))) + 1)
            # a member without any difference meets others by its least w only; it has one row all the same
            k = max(1, probe)
            for c, x in zip(columns, (np.full(k, node), np.full(k, label), np.full(k, w), np.full(k, size), np.arange(k), diff[:k].view(np.int64) if probe > 0 else np.zeros(1, np.int64), np.arange(k) < index), strict=True):
                c.append(x)
        got = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns]
        cluster = np.full(len(got[0]), members.column("cluster")[0].as_py() if len(members) else 0)
        arrays = [pa.array(x, pa.int64()) for x in (cluster, *got[:4], np.full(len(cluster), n))]
        usable = pa.array(got[3].astype(np.int64) > 0)
        return pa.Table.from_arrays([*arrays, pa.array(got[4], pa.int32()), pa.array(got[5], pa.int64()), pa.compute.and_(pa.array(got[6].astype(bool)), usable)], names=[x.split()[0] for x in _PREFIX.split(", ")])

    return run


def fits(n: str, m: str, percent: int = PERCENT):
    """Sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def rest_pairs(open_: DataFrame, texts: DataFrame, work: Workspace, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """a and b that may be linked, of different components, for all links within the open buckets."""
    chain = open_.select(F.col("low").alias("a"), F.col("label").alias("b"))
    clusters = components(chain, work, "clusters").select(F.col("node").alias("label"), F.col("label").alias("cluster"))
    members = open_.select("node", "label").distinct().join(clusters, "label")
    members = members.join(texts.select(F.col("doc_id").alias("node"), F.octet_length("text").alias("bytes")), "node")
    members = work.write(members.select("cluster", "node", "label", "bytes"), "members")
    # a cluster of two nodes is a bucket of two, whose pair has been looked at
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).filter("n > 2")
    parts = F.ceil(F.greatest(F.col("n") / PART, F.col("bytes") / PART_BYTES)).cast("int")
    sizes = work.write(sizes.select("cluster", parts.alias("parts")), "sizes")
    dealt = members.join(sizes, "cluster").select("cluster", "node", "label", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    some = dealt.groupBy("cluster", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(MIDDLE)).alias("_i")).agg(F.min("node").alias("node"))
    told = texts.select(F.col("doc_id").alias("node"), "text")
    middles = some.select("cluster", "node").join(told, "node").groupBy("cluster").applyInArrow(_middle(shingle), "cluster long, common binary, half binary")
    middles = middles.join(sizes, "cluster").select("cluster", "common", "half", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = dealt.join(told, "node").groupBy("cluster", "part").cogroup(middles.groupBy("cluster", "part"))
    prefix = work.write(both.applyInArrow(_parts_of_cluster(shingle, percent), _PREFIX), "prefixes")

    x = prefix.select("cluster", "element", *(F.col(c).alias(f"{c}_x") for c in ("node", "label", "w", "size", "place")), "middle")
    y = prefix.filter("indexed").select("cluster", "element", *(F.col(c).alias(f"{c}_y") for c in ("node", "label", "w", "size", "place")))
    can_share = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
    first = (F.col("w_y") < F.col("w_x")) | ((F.col("w_y") == F.col("w_x")) & (F.col("node_y") < F.col("node_x")))
    enough = F.col("w_x") + F.col("w_y") - (100 + percent) * can_share <= (100 - percent) * F.col("middle")
    met = x.filter("size_x > 0").join(y, (x.cluster == y.cluster) & (x.element == y.element) & first & (F.col("label_x") != F.col("label_y")) & enough)
    pairs = met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))
    own = prefix.filter("place = 0").select("cluster", "node", "label", "w", "middle")
    least = own.groupBy("cluster").agg(F.min(F.struct("w", "node", "label")).alias("l"))
    near = own.join(least, "cluster").filter((F.col("w") + F.col("l.w") <= (100 - percent) * F.col("middle")) & (F.col("label") != F.col("l.label")))
    return pairs.unionByName(near.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b"))).distinct()


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept: a row for each of docs."""
    spark = docs.sparkSession
    prepare(spark)
    work = Workspace(spark, "near")
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = work.write(docs.mapInArrow(_signatures, "doc_id long, n long, h1 long, h2 long, left array<long>, right array<long>"), "signatures")
    linked = signed.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = work.write(linked.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node"), F.first("left").alias("left"), F.first("right").alias("right")), "nodes")

    tables = F.flatten(F.transform("left", lambda x, i: F.transform("right", lambda y, j: F.xxhash64(i, j, x, y))))
    dealt = nodes.select("node", "n", F.explode(tables).alias("key"))
    # a key's count and first node, summed before they are dealt; few keys have two nodes
    shared = dealt.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("n", "node")).alias("first")).filter("members > 1")
    buckets = work.write(dealt.join(shared, "key").select("key", "node", "n", "first"), "buckets")

    ids = work.write(buckets.select("node").distinct(), "ids")
    picked = F.broadcast(ids) if ids.count() <= PICK_IDS else ids
    texts = work.write(docs.join(picked, docs.doc_id == picked.node, "left_semi"), "texts")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        one = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        two = one.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        return work.write(two.select("a", "text_a", "b", "text_b").mapInArrow(confirm(), "a long, b long"), name)

    near = buckets.filter(fits("n", "first.n")).select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b"))
    links = confirmed(work.write(near.filter("a < b").distinct(), "pairs"), "links")
    labels = components(links, work)

    placed = work.write(buckets.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "placed")
    split = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key", "low")
    open_ = work.write(placed.join(split, "key").select("node", "label", "low").distinct(), "open")
    if not open_.isEmpty():
        more = confirmed(work.write(rest_pairs(open_, texts, work), "rest-pairs"), "rest-links")
        named = open_.select("node", "label").distinct()
        a, b = (named.select(F.col("node").alias(x), F.col("label").alias(f"_{x}")) for x in "ab")
        joined = components(more.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")), work, "joined")
        joined = joined.select(F.col("node").alias("label"), F.col("label").alias("_joined"))
        every = labels.unionByName(named).distinct()
        labels = every.join(joined, "label", "left").select("node", F.coalesce("_joined", "label").alias("label"))
    labels = work.write(labels, "node-labels")
    named = nodes.select("h1", "h2", "n", "node").join(labels, "node", "left").select("h1", "h2", "n", F.coalesce("label", "node").alias("component_id"))
    named = work.write(named, "named")  # so that the copies of one text are the hot side of a plain join, which Spark can split
    work.drop("nodes", "node-labels", "texts", "buckets", "placed", "open", "pairs", "ids", "prefixes", "members", "links", "rest-pairs", "rest-links", "labels-0")
    alone = signed.filter("NOT (n > 0 AND doc_id IS NOT NULL)").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"]).select("doc_id", "n", "component_id").union(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that a smaller doc_id of their component stands for."""
    (name,) = spare(docs.columns, "gone")
    gone = link_documents(docs, key, text).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[key] == gone[name], "left_anti")


def query(spark, sf_dir):
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
