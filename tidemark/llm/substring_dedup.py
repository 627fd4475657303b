"""Substring dedup (op 5): words in a window of ``WINDOW`` words that also stands elsewhere are removed.

It is relative Lempel-Ziv parsing: the corpus is cut into reference blocks, each is indexed, and each document is factored from left to right
against all blocks, its own included.

1. A block's index is its anchors. A window's anchor is the least hash of its runs of ``WINDOW // 2 + 1`` words, so equal windows have equal
   anchors, and neighbours mostly share theirs: about a tenth as many anchors as windows. The indexes are dealt out by ranges of the anchor,
   which tells each block which of its anchors stand elsewhere too.
2. A document's parse extends each such anchor to the run of windows around it that may stand elsewhere: a factor of WINDOW words or
   more, as long as it goes. A factor follows one anchor after the other, so it may take its parts from different places of the reference; a parse
   that follows one place at a time would lose the windows across its boundaries, which the result may not.
3. What a factor covers, its boundaries above all, is checked window by window: of all windows within factors, two more hashes of 64 bits each
   are dealt out in the same way. Windows that stand elsewhere by anchor and both hashes are duplicate spans, and their words go.

Windows are taken for equal by 128 bits besides the anchor, all made of 64-bit word hashes: of n windows, two different ones by chance with
probability n * n / 2**129, which is 10**-12 for 10**13 windows.

Skew: a block sends each hash once, however often it has it. So a passage that a third of all documents share is a row
per block, and a block and a range have a bounded size. Rows are numbered and dealt to blocks by their number, so repeated rows and null keys
spread over all blocks. Blocks and ranges number with the input, so they exchange fewer rows than there are hashes, with some tens of hashes in a row: from
64 GB on both grow in size with the root of the input, up to 16 times at 16 TB.

Edge cases: null, empty and blank texts have no words. Texts of fewer words than a window lose nothing. Repeated rows are
documents of their own, so equal texts of WINDOW words or more both lose all. Keys may be null, repeated, or of any type. Only key and text
are read. An empty table gives an empty one. A text longer than a block is a block of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.storage import Workspace, prepare
from tidemark.llm.words import Block, blocks, mix, window_hashes

WINDOW, BLOCK_CHARS, RANGE_WINDOWS = 35, 4_000_000, 1_000_000
#: Characters from which blocks and ranges grow, and by how much at most.
GROW_CHARS, GROW = 64_000_000_000, 16
#: Windows for an anchor, at least.
ANCHORED = 8
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FOUND = "_kind int, _range int, _block int, _bits binary"


def _least(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each n consecutive values, and where the first such stands."""
    places, size = np.arange(len(values)), 1

    def lower(ahead: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(values) - ahead
        left = values[:m] <= values[ahead:]
        return np.where(left, values[:m], values[ahead:]), np.where(left, places[:m], places[ahead:])

    while 2 * size <= n:
        (values, places), size = lower(size), 2 * size
    return lower(n - size) if size < n else (values, places)


def _anchors(block: Block, window: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor and where it stands in the block."""
    k = window // 2 + 1
    if len(block.hashes) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    values, at = _least(window_hashes(block.hashes, k), window - k + 1)
    return values[places] * _SPREAD, at[places]


def _pairs(block: Block, window: int, first: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Two hashes of each window, as rows."""
    second = window_hashes(mix(block.hashes, ~block.hashes), window)
    return np.stack([first, second[places] if len(places) else first], axis=1)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different rows, each row's number among them, and how often each stands."""
    if rows.shape[1] == 1:
        values, number, count = np.unique(rows[:, 0], return_inverse=True, return_counts=True)
        return values[:, None], number, count
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], number, np.bincount(number, minlength=int(new.sum()))


def _cuts(rows: np.ndarray, n: int) -> np.ndarray:
    """Bounds of n equal ranges of the first column in sorted rows."""
    edges = np.array([(2**64 * i) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(rows[:, 0], edges), [len(rows)]]).astype(np.int64)


def _dealt(rows: np.ndarray, block: int, n: int) -> pa.Table:
    """A block's hashes by range, for the exchange."""
    at = _cuts(rows, n)
    used = [i for i in range(n) if at[i] < at[i + 1]]
    prints = pa.array([rows[at[i] : at[i + 1]].tobytes() for i in used], pa.binary())
    return pa.table({"_range": pa.array(used, pa.int32()), "_block": pa.array([block] * len(used), pa.int32()), "_prints": prints})


def _lookup(kind: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        """For each block of a range, a bit for each of its hashes that another block has too."""
        lists = [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, width) for x in table.column("_prints").combine_chunks()]
        _, number, count = _distinct(np.concatenate(lists))
        hit, at, bits = count[number] > 1, 0, []
        for x in lists:
            own = hit[at : at + len(x)]
            at += len(x)
            bits.append(np.packbits(own).tobytes() if own.any() else None)
        bits = pa.array(bits, pa.binary())
        kinds = pa.array(np.full(len(lists), kind), pa.int32())
        return pa.table({"_kind": kinds, "_range": table.column("_range"), "_block": table.column("_block"), "_bits": bits}).filter(pc.is_valid(bits))

    return run


def _known(rows: np.ndarray, found: list[tuple[int, bytes]], n: int) -> np.ndarray:
    """Of each row of a block whether it stands elsewhere, in the block or in others."""
    values, number, count = _distinct(rows)
    known, at = count > 1, _cuts(values, n)
    for i, bits in found:
        a, b = at[i], at[i + 1]
        known[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=int(b - a)).astype(bool)
    return known[number]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """Key, n_words, n_removed, kept (the kept words joined by a space) of each document."""
    spark = docs.sparkSession
    prepare(spark)
    work = Workspace(spark, "substring")
    numbered = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    rows = work.write(numbered, "rows")  # numbers of rows must not change between the steps
    chars = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    grown = min(GROW, max(1.0, (chars / GROW_CHARS) ** 0.5))
    n_blocks = int(-(-chars // int(block_chars * grown))) or 1
    n_ranges = int(-(-chars // int(6 * range_windows * grown))) or 1
    n_anchored = -(-n_ranges // ANCHORED)
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(n_blocks)).cast("int"))

    def parts(table: pa.Table):
        table = table.take(pc.sort_indices(table, [("_row", "ascending")]))
        out = [(b, *b.windows(window)) for b in blocks(table.column("_text"))]
        values, at, words = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        for b, _, p in out:
            value, place = _anchors(b, window, p)
            values.append(value)
            at.append(place + words)
            words += len(b.words)
        # windows side by side share an anchor's place: it is one anchor of the block
        at, first, number = np.unique(np.concatenate(at), return_index=True, return_inverse=True)
        return table, out, (np.concatenate(values)[first][:, None], number)

    def bits_of(found: pa.Table, kind: int) -> list[tuple[int, bytes]]:
        return [(r["_range"], r["_bits"]) for r in found.to_pylist() if r["_kind"] == kind]

    def index(table: pa.Table) -> pa.Table:
        _, _, anchors = parts(table)
        return _dealt(_distinct(anchors[0])[0], table.column("_block")[0].as_py(), n_anchored)

    def factored(out: list, anchors: tuple[np.ndarray, np.ndarray], found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Which windows lie in factors, and these windows' hashes."""
        inside = _known(anchors[0], bits_of(found, 0), n_anchored)[anchors[1]]
        pairs = [_pairs(b, window, h, p) for b, h, p in out]
        return inside, np.concatenate(pairs)[inside] if pairs else np.empty((0, 2), np.uint64)

    def boundaries(table: pa.Table, found: pa.Table) -> pa.Table:
        if not len(table):
            return _dealt(np.empty((0, 2), np.uint64), 0, n_ranges)
        _, out, anchors = parts(table)
        _, pairs = factored(out, anchors, found)
        return _dealt(_distinct(pairs)[0], table.column("_block")[0].as_py(), n_ranges)

    schema = T.StructType([T.StructField("_key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    arrow = to_arrow_schema(schema)

    def parse(table: pa.Table, found: pa.Table) -> pa.Table:
        table, out, anchors = parts(table)
        inside, pairs = factored(out, anchors, found)
        known = np.zeros(len(inside), bool)
        known[inside] = _known(pairs, bits_of(found, 1), n_ranges)
        n, removed, kept, used = [], [], [], 0
        for block, hashes, places in out:
            hit = places[known[used : used + len(hashes)]]
            used += len(hashes)
            edge = np.zeros(len(block.words) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
            covered = np.cumsum(edge[:-1]) > 0
            for a, b in zip(block.starts[:-1], block.starts[1:], strict=True):
                gone = covered[a:b]
                lost = int(gone.sum())
                words = block.words[a:b] if not lost else [block.words[a + i] for i in np.flatnonzero(~gone)]
                n.append(int(b - a))
                removed.append(lost)
                kept.append(b" ".join(words).decode())
        return pa.table([table.column("_key"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, arrow.field("kept").type)], schema=arrow)

    # one plan, in which texts are dealt out to blocks once and read by all three steps
    grouped = dealt.groupBy("_block")
    shape = "_range int, _block int, _prints binary"
    near = grouped.applyInArrow(index, shape).groupBy("_range").applyInArrow(_lookup(0, 1), _FOUND)
    exact = grouped.cogroup(near.groupBy("_block")).applyInArrow(boundaries, shape).groupBy("_range").applyInArrow(_lookup(1, 2), _FOUND)
    found = near.unionByName(exact)
    return grouped.cogroup(found.groupBy("_block")).applyInArrow(parse, schema).withColumnRenamed("_key", key)


def query(spark, sf_dir):
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, p, md5(array_to_string(w[p + 1 : p + {WINDOW}], ' ')) AS x FROM (SELECT rid, w, unnest(range(greatest(len(w) - {WINDOW - 1}, 0))) AS p FROM d)),
r AS (SELECT rid, p, count(*) OVER (PARTITION BY x) AS c FROM g),
hit AS (SELECT rid, p, coalesce(lead(p) OVER (PARTITION BY rid ORDER BY p), p + {WINDOW}) AS q FROM r WHERE c > 1),
cover AS (SELECT rid, list(i) AS gone FROM (SELECT rid, unnest(range(p, least(q, p + {WINDOW}))) AS i FROM hit) GROUP BY rid),
e AS (SELECT rid, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
k AS (SELECT e.rid, coalesce(string_agg(word, ' ' ORDER BY e.i) FILTER (c.i IS NULL), '') AS kept, count(c.i) AS n FROM e
  LEFT JOIN (SELECT rid, unnest(gone) AS i FROM cover) c ON e.rid = c.rid AND e.i = c.i GROUP BY e.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""
