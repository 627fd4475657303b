"""Benchmark decontamination (op 10): containment search with size-partitioned MinHash.

Test items are partitioned by the number of their shingles, in classes of powers of two. Plain MinHash can't see a short
item in a long document, as their similarity is next to nothing; so a document is searched, for each class of at most u
shingles, in blocks of 2u that overlap by u. Any place of an item lies in one block, and there an item of which four fifths
are contained has a similarity of 0.19 or more: of ``HASHES`` minhashes, one agrees with probability 1 - 4e-5. That holds from
``EXACT`` shingles on; shorter items are too small for the least block and are looked up without minhashes: of n shingles of which
k must be shared, some of any n - k + 1 are, so the rarest n - k + 1 are an exact index. Block minima of all classes are put together from the minima of tiles of 16 shingles, so a shingle is hashed ``HASHES`` times, not
more. Pairs of document and item with an equal minimum are confirmed: all of the document's shingles, against all of
the item's.

Documents are read in one pass without shuffle. The items' shingle hashes go to the tasks; their size is checked: beyond
``PART_BYTES`` of item text, the items are searched in parts of about that size, each over all documents, one part after the
other: the driver holds one part at a time, and what a part finds is a written table.

Edge cases: items of fewer than five words, null ones included, have no shingle of five words and are in nothing. Null and
empty documents contain nothing. Equal items, and equal documents, are reported each. Extra columns pass through
``keep_clean``. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.storage import Workspace, prepare
from tidemark.llm.words import Block, blocks

SHINGLE, HASHES, TILE = 5, 48, 16
#: Items of fewer shingles are looked up by the shingles themselves.
EXACT = TILE // 2
#: Contained if 10 * shared >= SHARE * the item's shingles.
SHARE = 8
PART_BYTES = 4_000_000

_rng = np.random.Generator(np.random.PCG64(10))
_XOR = _rng.integers(0, 2**32, HASHES, np.uint32)
_MUL = _rng.integers(0, 2**32, HASHES, np.uint32) | np.uint32(1)
_HALF = np.uint64(32)
_COARSE = np.uint32(16)
_TOP = np.uint64(48)


class Items:
    """Some test items and their index: for each size class and minhash function the items' minima, sorted."""

    def __init__(self, ids: list, sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None
        self.short: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def build(self) -> Items:
        """Minima per class, made where they are used; what is sent is the sets."""
        if self.classes is None:
            self.classes = {}
            self._build_short()
            sizes = [max(TILE, 1 << int(len(s) - 1).bit_length()) if len(s) >= EXACT else 0 for s in self.sets]
            for u in sorted(set(sizes) - {0}):
                members = np.array([i for i, x in enumerate(sizes) if x == u])
                low = np.array([[int((((self.sets[i] >> _HALF).astype(np.uint32) ^ x) * m).min()) for i in members] for x, m in zip(_XOR, _MUL, strict=True)], np.uint32)
                order = np.argsort(low, axis=1, kind="stable")
                coarse = np.zeros((HASHES, 1 << 16), bool)
                for k in range(HASHES):
                    coarse[k, low[k] >> _COARSE] = True
                self.classes[u] = (members[order], np.take_along_axis(low, order, 1), coarse)
        return self

    def _build_short(self) -> None:
        """Sorted shingles of which each text that contains a short item has one, their items, and a coarse filter."""
        own = [(i, s) for i, s in enumerate(self.sets) if len(s) < EXACT]
        if not own:
            return
        known, often = np.unique(np.concatenate([s for _, s in own]), return_counts=True)
        keys, members = [], []
        for i, s in own:
            n = len(s) - -(-SHARE * len(s) // 10) + 1
            rare = s[np.argsort(often[np.searchsorted(known, s)], kind="stable")[:n]]
            keys.append(rare)
            members += [i] * n
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        coarse = np.zeros(1 << 16, bool)
        coarse[flat >> _TOP] = True
        self.short = flat[order], np.array(members)[order], coarse

    def _short_found(self, hashes: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """Row and item, for the rows that may contain a short item."""
        if self.short is None:
            return set()
        keys, members, coarse = self.short
        maybe = np.flatnonzero(coarse[hashes >> _TOP])
        a, b = np.searchsorted(keys, hashes[maybe]), np.searchsorted(keys, hashes[maybe], "right")
        hit = np.flatnonzero(a < b)
        rows = np.searchsorted(bounds, maybe[hit], "right") - 1
        return {(int(r), int(x)) for r, i in zip(rows, hit, strict=True) for x in members[a[i] : b[i]]}

    def search(self, block: Block) -> Iterator[tuple[int, int, int]]:
        """Row, item and shared shingles, for the block's rows that contain an item."""
        hashes, places = block.windows(SHINGLE)
        bounds = np.searchsorted(places, block.starts)
        n = np.diff(bounds)
        tiles = -(-n // TILE)
        first_tile = np.cumsum(tiles) - tiles
        total = int(tiles.sum())
        if not total:
            return
        # each row's shingles, its last one repeated to fill the last tile; a column is a tile
        row_of_tile = np.repeat(np.arange(len(n)), tiles)
        at = (np.arange(total) - first_tile[row_of_tile]) * TILE + bounds[row_of_tile]
        grid = np.minimum(at + np.arange(TILE)[:, None], bounds[row_of_tile + 1] - 1)
        small = (hashes >> _HALF).astype(np.uint32)[grid]
        minima = np.empty((HASHES, total + 1), np.uint32)
        minima[:, -1] = np.uint32(2**32 - 1)
        for k in range(HASHES):
            np.min((small ^ _XOR[k]) * _MUL[k], axis=0, out=minima[k, :-1])
        found = self._short_found(hashes, bounds)
        for u, (members, low, coarse) in self.classes.items():
            step = u // TILE
            counts = np.maximum(1, -(-tiles // step) - 1) * (tiles > 0)
            row = np.repeat(np.arange(len(n)), counts)
            start = first_tile[row] + (np.arange(len(row)) - (np.cumsum(counts) - counts)[row]) * step
            end = np.minimum(start + 2 * step, first_tile[row] + tiles[row])
            cuts = np.empty(2 * len(row), np.int64)
            cuts[::2], cuts[1::2] = start, end
            for k in range(HASHES):
                block_min = np.minimum.reduceat(minima[k], cuts)[::2]
                maybe = np.flatnonzero(coarse[k][block_min >> _COARSE])
                if len(maybe):
                    a, b = np.searchsorted(low[k], block_min[maybe]), np.searchsorted(low[k], block_min[maybe], "right")
                    for i in np.flatnonzero(a < b):
                        r = int(row[maybe[i]])
                        found.update((r, int(x)) for x in members[k][a[i] : b[i]])
        own, last = None, -1
        for r, item in sorted(found):
            if r != last:
                own, last = np.unique(hashes[bounds[r] : bounds[r + 1]]), r
            shared = len(np.intersect1d(own, self.sets[item], assume_unique=True))
            if 10 * shared >= SHARE * len(self.sets[item]):
                yield r, item, shared


def _parts(benchmark: DataFrame, key: str, text: str) -> tuple[int, Iterator[Items]]:
    """How many parts of about PART_BYTES of text the items have, and the parts, each made when it's asked for."""
    rows = benchmark.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))

    def made() -> Iterator[Items]:
        for i in range(parts):
            own = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == i).orderBy("id", "text").collect()  # PART_BYTES or so
            ids, sets = [], []
            for block in blocks(pa.array([r.text for r in own], pa.string()), lower=True):
                hashes, places = block.windows(SHINGLE)
                cuts = np.searchsorted(places, block.starts)
                for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if b > a:
                        ids.append(own[int(block.rows[j])].id)
                        sets.append(np.unique(hashes[a:b]))
            yield Items(ids, sets)

    return parts, made()


def find_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item key, n_shared, n_item and containment: a row for each document and item that it contains."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([docs.schema[0], benchmark.schema[item_key], T.StructField("n_shared", T.LongType()), T.StructField("n_item", T.LongType())])

    def pairs(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items.build()
            for batch in batches:
                rows, got, shared = [], [], []
                for block in blocks(batch.column("_text"), lower=True):
                    for r, item, n in items.search(block):
                        rows.append(int(block.rows[r]))
                        got.append(item)
                        shared.append(n)
                taken = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, pa.array([items.ids[i] for i in got], item_type), pa.array(shared, pa.int64()), pa.array([len(items.sets[i]) for i in got], pa.int64())], names=names)

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    names, item_type = schema.names, to_arrow_type(schema[1].dataType)
    n, parts = _parts(benchmark, item_key, item_text)
    if n == 1:
        out = docs.mapInArrow(pairs(next(parts)), schema)
    else:
        work = Workspace(docs.sparkSession, "items")
        out = reduce(DataFrame.unionAll, [work.write(docs.mapInArrow(pairs(items), schema), f"part-{i}") for i, items in enumerate(parts)])
    return out.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that contain an item; no shuffle, as each row is judged where it is read."""
    prepare(docs.sparkSession)

    place = docs.columns.index(text)

    def clean(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items.build()
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for block in blocks(batch.column(0).field(place), lower=True):
                    for r, _, _ in items.search(block):
                        good[block.rows[r]] = False
                yield batch.filter(pa.array(good))

        return run

    n, parts = _parts(benchmark, item_key, item_text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # whatever the columns' names
    if n == 1:
        rows = rows.mapInArrow(clean(next(parts)), rows.schema)
    else:
        work = Workspace(docs.sparkSession, "clean")
        for i, items in enumerate(parts):
            rows = work.write(rows.mapInArrow(clean(items), rows.schema), f"part-{i}")
            work.drop(f"part-{i - 1}")
    return rows.select("_row.*")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = f"""
WITH b AS (SELECT item_id, row_number() OVER () AS iid, {_WORDS} AS w FROM benchmark),
bs AS (SELECT DISTINCT iid, item_id, array_to_string(w[p + 1 : p + 5], ' ') AS x FROM (SELECT *, unnest(range(greatest(len(w) - 4, 0))) AS p FROM b)),
bn AS (SELECT iid, count(*) AS n_item FROM bs GROUP BY iid),
d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
ds AS (SELECT rid, doc_id, array_to_string(w[p + 1 : p + 5], ' ') AS x FROM (SELECT *, unnest(range(greatest(len(w) - 4, 0))) AS p FROM d)),
m AS (SELECT DISTINCT rid, doc_id, iid, item_id, x FROM ds JOIN bs USING (x)),
c AS (SELECT doc_id, item_id, iid, rid, count(*) AS n_shared FROM m GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment FROM c JOIN bn USING (iid) WHERE 10 * n_shared >= {SHARE} * n_item
"""
