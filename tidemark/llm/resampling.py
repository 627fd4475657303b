"""Target-distribution importance resampling (op 11): draw the documents that look most like a target's texts.

A text's features are its runs of ``ngrams`` consecutive words, each hashed into a bucket. A bucket's gain is the log ratio of its smoothed share in
the target and in the documents; a document's weight is the sum of its features' gains; a draw without replacement by weight is the top of
weight plus Gumbel noise, which is made of the key, so that a rerun draws the same.

1. External sort-count. One pass over the texts packs each document's buckets as uint16, end to end with the next one's, and writes them as a table of
   blocks: packed stream, the documents' keys, and their offsets. A task then sorts the streams of an Arrow batch, and run-length encodes them: a row a
   bucket and batch is dealt out and summed, so a count moves at most ``buckets`` rows a batch, whatever the texts hold.
2. Gains, at most 65,536 numbers, go to every task. It gathers the gains of a block's stream, and ``np.add.reduceat`` at the offsets sums
   them to weights. Texts are read once.
3. The draw. A quantile with a guaranteed error leaves out what can't be drawn; the rest is range-partitioned by (score, key, row) and numbered
   within partitions; the counts of earlier partitions are added. Nothing is sorted in one task, and rows of one score are parted by their keys.

Edge cases: a null or empty text has no features and weight 0; a null key hashes as the empty string and comes last among equal scores. Rows that share a key
are scored and drawn each for itself, repeats of the whole row in the order in which they were read. Empty documents give an empty table; an empty
target (or null texts in it) leaves only the smoothing, which is the same for all seen and unseen buckets. Other columns of ``docs``, of whatever names, don't reach the
operator; ``draw`` returns them unchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import Workspace, prepare, spare

#: Features, buckets, the share drawn, the words that a document must have, and the seed of the noise.
NGRAMS, BUCKETS, PERCENT, MIN_WORDS, SEED = (1, 1), 10_000, 10, 20, 2024
#: Features of a block; a document is never cut, so a longer one is a block of its own.
BLOCK = 1 << 16
#: Features whose bucket a task remembers, and their longest.
KNOWN, KNOWN_BYTES = 200_000, 64
#: Share of the rows by which the draw's lower bound may be off.
SLACK = 0.01

#: Bytes of a word: digits, a-z and all of other alphabets; A-Z become a-z, the rest separates.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORDS).split() if text else []


class _Buckets(dict):
    """The bucket of a feature; a task keeps those of short ones."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, gram: bytes) -> int:
        bucket = zlib.crc32(gram) % self.buckets
        if len(gram) <= KNOWN_BYTES:
            if len(self) >= KNOWN:
                self.clear()
            self[gram] = bucket
        return bucket


def _grams(own: list[bytes], ngrams: tuple[int, int]) -> Iterator[bytes]:
    for n in range(ngrams[0], ngrams[1] + 1):
        yield from own if n == 1 else map(b" ".join, zip(*(own[i:] for i in range(n)), strict=False))


def _pack(ngrams: tuple[int, int], buckets: int):
    """Batches of key and text to blocks: keys, rows' first number, words and features of each document, and the packed stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of, number = _Buckets(buckets), TaskContext.get().partitionId() << 40

        def block(keys: pa.Array, n_words: list[int], streams: list[np.ndarray]) -> pa.RecordBatch:
            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            sizes = pa.array([len(s) for s in streams], pa.int64())
            arrays = [whole(keys), pa.array([number], pa.int64()), whole(pa.array(n_words, pa.int64())), whole(sizes), pa.array([np.concatenate(streams).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["keys", "first", "n_words", "sizes", "stream"])

        for batch in batches:
            texts, keys, start = batch.column("text"), batch.column("key"), 0
            n_words, streams, held = [], [], 0
            for i in range(batch.num_rows):
                own = words(texts[i].as_py())
                stream = np.fromiter(map(bucket_of.__getitem__, _grams(own, ngrams)), np.uint16)
                if streams and held + len(stream) > BLOCK:
                    yield block(keys.slice(start, i - start), n_words, streams)
                    number, start, n_words, streams, held = number + i - start, i, [], [], 0
                n_words.append(len(own))
                streams.append(stream)
                held += len(stream)
            if streams:
                yield block(keys.slice(start), n_words, streams)
                number += len(streams)

    return run


def _stream(binary) -> np.ndarray:
    return np.frombuffer(binary.as_buffer(), np.uint16)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed streams of a batch, sorted and run-length encoded: bucket and n."""
    for batch in batches:
        packed = np.concatenate([np.empty(0, np.uint16), *map(_stream, batch.column("stream"))])
        packed.sort(kind="stable")
        starts = np.flatnonzero(np.diff(packed, prepend=packed[:1] + np.uint16(1)))
        yield pa.RecordBatch.from_arrays([pa.array(packed[starts].astype(np.int32)), pa.array(np.diff(starts, append=len(packed)))], names=["bucket", "n"])


def _gather(gains: np.ndarray, key_type: pa.DataType):
    """Blocks to documents: row, key, n_words, n_features and weight, the sum of its features' gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = batch.column("sizes")[i].values.to_numpy()
                weight, full = np.zeros(len(sizes), np.int64), np.flatnonzero(sizes)
                if len(full):
                    offsets = np.cumsum(sizes) - sizes
                    weight[full] = np.add.reduceat(gains[_stream(batch.column("stream")[i])], offsets[full])
                rows = np.arange(len(sizes)) + batch.column("first")[i].as_py()
                arrays = [pa.array(rows), batch.column("keys")[i].values.cast(key_type), batch.column("n_words")[i].values, pa.array(sizes), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "key", "n_words", "n_features", "weight"])

    return run


def _packed(docs: DataFrame, work: Workspace, name: str, ngrams: tuple[int, int], buckets: int) -> DataFrame:
    kind = docs.schema["key"].dataType.simpleString()
    return work.write(docs.mapInArrow(_pack(ngrams, buckets), f"keys array<{kind}>, first long, n_words array<long>, sizes array<long>, stream binary"), name)


def bucket_counts(streams: DataFrame) -> DataFrame:
    """bucket and n of packed streams."""
    return streams.select("stream").mapInArrow(_runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _gains(own: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln ratio) of each bucket; both tables have a row a bucket at most."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((own, s), (target, t)):
        for row in counts.collect():
            into[row.bucket] = row.n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _ranked(top: DataFrame, work: Workspace) -> DataFrame:
    """top with rank, from 1, in the order of the draw."""
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("row")]
    placed = top.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = work.write(placed.select("*", F.shiftrightunsigned("_at", 33).alias("_part")), "placed")
    before, offsets = 0, []
    for row in placed.groupBy("_part").count().orderBy("_part").collect():  # a row a partition
        offsets.append((row["_part"], before))
        before += row["count"]
    if not offsets:
        return placed.withColumn("rank", F.lit(None).cast("long")).drop("_at", "_part")
    first = F.broadcast(placed.sparkSession.createDataFrame(offsets, "_part long, _before long"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(first, "_part").withColumn("rank", rank).drop("_at", "_part", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    ngrams: tuple[int, int] = NGRAMS,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """key, n_features, weight, score and rank of every document; rank is null where a document isn't drawn."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are packed as uint16: 1 to 65536")
    spark = docs.sparkSession
    prepare(spark)
    work = Workspace(spark, "resample")
    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    target = target.select(F.lit(0).alias("key"), F.col(f"`{target_text}`").alias("text"))
    own, wanted = _packed(docs, work, "streams", ngrams, buckets), _packed(target, work, "target", ngrams, buckets)
    gains = _gains(bucket_counts(own), bucket_counts(wanted), buckets)
    kind = docs.schema["key"].dataType
    weighted = own.mapInArrow(_gather(gains, _arrow(kind)), f"row long, key {kind.simpleString()}, n_words long, n_features long, weight long")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(-1000 * F.log(-F.log(uniform)))
    known = work.write(weighted.withColumn("score", F.col("weight") + noise), "scored")
    work.drop("streams", "target")

    able = known.filter(F.col("n_words") >= min_words)
    n_drawn = able.count() * percent // 100
    columns = [F.col("key").alias(key), "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not n_drawn:
        return known.select(*columns, none)
    # the quantile's rank is off by SLACK at most, so what lies under it can't be drawn
    low = able.approxQuantile("score", [max(0.0, 1 - percent / 100 - 2 * SLACK)], SLACK)[0]
    placed = _ranked(able.filter(F.col("score") >= low), work)
    last = placed.filter(F.col("rank") == n_drawn).first()
    if last is None:  # the bound was no bound: rank all
        placed = _ranked(able, work)
        last = placed.filter(F.col("rank") == n_drawn).first()
    later = F.col("row") > last.row if last.key is None else (F.col("key") > last.key) | F.col("key").isNull() | ((F.col("key") == last.key) & (F.col("row") > last.row))
    later = later if last.key is not None else F.col("key").isNull() & later
    undrawn = (F.col("n_words") < min_words) | (F.col("score") < last.score) | ((F.col("score") == last.score) & later)
    return placed.filter(F.col("rank") <= n_drawn).select(*columns, "rank").unionByName(known.filter(undrawn).select(*columns, none))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns. Rows that share a key come together if one of them is drawn."""
    (name,) = spare(docs.columns, "drawn")
    drawn = resample(docs, target, key, **options).filter("rank IS NOT NULL").select(F.col(f"`{key}`").alias(name)).distinct()
    return docs.join(drawn, docs[f"`{key}`"].eqNullSafe(drawn[name]), "left_semi")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


#: The CRC table follows from its rule; a word's bytes are read from its hexadecimal form.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY rid, w),
gw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM g) GROUP BY w),
crc AS ({CRC_TABLE}),
v AS (SELECT w, {CRC} % {BUCKETS} AS b FROM (SELECT w, hex(encode(w)) AS hx FROM (SELECT w FROM dw UNION SELECT w FROM gw)), crc),
s AS (SELECT b, sum(n)::BIGINT AS n FROM dw JOIN v USING (w) GROUP BY b),
t AS (SELECT b, sum(n)::BIGINT AS n FROM gw JOIN v USING (w) GROUP BY b),
z AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t_all),
gain AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + {BUCKETS}) / ((s.n + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (b), z),
wt AS (SELECT rid, sum(n * gain)::BIGINT AS weight FROM dw JOIN v USING (w) JOIN gain USING (b) GROUP BY rid),
x AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN wt USING (rid)),
y AS (SELECT rid, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id, rid) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM y LEFT JOIN r USING (rid)
"""
