"""Quality classifier (op 6): a factorisation machine.

Inputs are hashed words (their counts' logarithm over the text's length) and structure statistics of the whole text. The score is

    sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

whose last term is all pairwise interactions, in time linear in the text. Labels, language, source and ids are no inputs.

Training: labelled rows whose crc32(key as text) mod ``FOLDS`` isn't 0, at most ``SAMPLE`` of them, picked by a hash of their
key; it is done in the driver with Adam, from a fixed seed, on a table of bounded size. Scoring is one pass over the
texts without shuffle, with ``2**BITS * (FACTORS + 1)`` numbers as the model.

Edge cases: null and empty texts have only the bias and the statistics, and get a score. Without labels of both kinds the score is the
share of label 1 (0.5 without labels). Null labels are no labels. Null keys are scored, held out if the fold says so of
the empty text. Repeated rows are scored each; of a key with several labels each different one counts, of one with several documents the first text in order. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.storage import prepare
from tidemark.llm.words import Block, blocks

SAMPLE, FOLDS, THRESHOLD = 6000, 5, 0.3
BITS, FACTORS, EPOCHS, BATCH, RATE, DECAY = 14, 8, 12, 256, 0.02, 1e-4
STATS = 14
_SYMBOLS = b"#*$%&|<>!"


def _features(block: Block, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, feature numbers and values: statistics first, then hashed words."""
    n = np.diff(block.starts)
    row = np.repeat(np.arange(len(n), dtype=np.int64), n)
    slot = (block.hashes >> np.uint64(64 - BITS)).astype(np.int64)
    pair, count = np.unique((row << BITS) | slot, return_counts=True)
    row, slot = pair >> BITS, pair & ((1 << BITS) - 1)
    size = np.maximum(n, 1)
    values = np.log1p(count) / np.sqrt(size[row])
    stats = np.zeros((len(n), STATS))
    for i, text in enumerate(texts):
        a, b = block.starts[i], block.starts[i + 1]
        words, h = b - a, block.hashes[a:b]
        length = max(1, len(text))
        lines = text.split(b"\n")
        symbols = sum(text.count(c) for c in (bytes([x]) for x in _SYMBOLS))
        upper = length - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if text else 0
        different = len(np.unique(h)) if words else 0
        repeated = float((h[1:] == h[:-1]).mean()) if words > 1 else 0.0
        stats[i] = (
            np.log1p(words) / 8,
            min(words / 20, 1.0),
            length / max(1, words) / 10,
            min(symbols / max(1, words), 4.0),
            upper / length,
            different / max(1, words),
            repeated,
            (text.count(b".") + text.count(b",")) / max(1, words),
            len(lines) / max(1, words) * 10,
            text.count(b"|") / max(1, words),
            sum(text.count(bytes([d])) for d in b"0123456789") / length * 10,
            1 - len(set(lines)) / len(lines),
            np.sqrt(different) / max(1.0, np.sqrt(words)),
            1.0 if not words else 0.0,
        )
    order = np.argsort(np.concatenate([np.repeat(np.arange(len(n)), STATS), row]), kind="stable")
    number = np.concatenate([np.tile(np.arange(STATS), len(n)), slot + STATS])[order]
    value = np.concatenate([stats.ravel(), values])[order]
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=len(n)) + STATS, out=bounds[1:])
    return bounds, number, value


class Model:
    def __init__(self, bias: float = 0.0, linear: np.ndarray | None = None, factors: np.ndarray | None = None):
        size = (1 << BITS) + STATS
        self.bias = bias
        self.linear = np.zeros(size, np.float32) if linear is None else linear
        self.factors = np.zeros((size, FACTORS), np.float32) if factors is None else factors

    def logits(self, bounds: np.ndarray, number: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The sum-of-squares identity; every row has its statistics, so no row is empty."""
        at = bounds[:-1]
        vx = self.factors[number] * value[:, None].astype(np.float32)
        sums, squares = np.add.reduceat(vx, at), np.add.reduceat(np.einsum("ij,ij->i", vx, vx), at)
        return self.bias + np.add.reduceat(self.linear[number] * value, at) + 0.5 * (np.einsum("ij,ij->i", sums, sums) - squares)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> Model:
    """Adam on the logistic loss with weight decay. rows: numbers and values of each row."""
    share = float(labels.mean()) if len(labels) else 0.5
    model = Model(float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))))
    if len(labels) == 0 or share in (0.0, 1.0):
        return model
    rng = np.random.Generator(np.random.PCG64(seed))
    model.factors[:] = rng.normal(0, 0.05, model.factors.shape)
    size = len(model.linear)
    m1, m2 = np.zeros((size, FACTORS + 1), np.float32), np.zeros((size, FACTORS + 1), np.float32)
    b1 = b2 = 0.0
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            pick = order[at : at + BATCH]
            bounds = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in pick])])
            number, value = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick]).astype(np.float32)
            start = bounds[:-1]
            vx = model.factors[number] * value[:, None]
            sums = np.add.reduceat(vx, start)
            score = model.bias + np.add.reduceat(model.linear[number] * value, start) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), start))
            error = ((sigmoid(score) - labels[pick]) / len(pick)).astype(np.float32)
            each = np.repeat(np.arange(len(pick)), np.diff(bounds))
            by_value = error[each] * value
            part = np.concatenate([by_value[:, None], by_value[:, None] * (sums[each] - vx)], axis=1)
            used, place = np.unique(number, return_inverse=True)
            grad = np.zeros((len(used), FACTORS + 1), np.float32)
            np.add.at(grad, place, part)
            grad[:, 0] += DECAY * model.linear[used]
            grad[:, 1:] += DECAY * model.factors[used]
            step += 1
            m1[used] = 0.9 * m1[used] + 0.1 * grad
            m2[used] = 0.999 * m2[used] + 0.001 * grad**2
            move = RATE * (m1[used] / (1 - 0.9**step)) / (np.sqrt(m2[used] / (1 - 0.999**step)) + 1e-8)
            model.linear[used] -= move[:, 0]
            model.factors[used] -= move[:, 1:]
            g = float(error.sum())
            b1, b2 = 0.9 * b1 + 0.1 * g, 0.999 * b2 + 0.001 * g * g
            model.bias -= RATE * (b1 / (1 - 0.9**step)) / ((b2 / (1 - 0.999**step)) ** 0.5 + 1e-8)
    return model


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _row_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, texts in _with_texts(batch.column("_text")):
            bounds, number, value = _features(block, texts)
            part = batch.slice(int(block.rows[0]), len(block.rows))
            offsets = pa.array(bounds.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (number.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([part.column("_key"), part.column("_label"), *lists], names=["_key", "_label", "number", "value"])


def _with_texts(column):
    for block in blocks(column):
        texts = column.slice(int(block.rows[0]), len(block.rows)).to_pylist()
        yield block, [t.encode() if t else b"" for t in texts]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """The model, of at most ``sample`` labelled rows outside the held-out fold."""
    prepare(docs.sparkSession)
    picked = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).filter(F.col("_label").isNotNull() & F.col("_key").isNotNull() & (fold(F.col("_key")) != 0))
    picked = picked.orderBy(F.xxhash64("_key"), "_key", "_label").limit(sample)
    own = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(picked.distinct()), "_key")  # sample rows of 12 bytes
    # of documents that share a key one counts, so that what the driver gets is bounded by the sample
    own = own.groupBy("_key", "_label").agg(F.min("_text").alias("_text"))
    got = own.select("_key", "_label", "_text").mapInArrow(_row_features, T.StructType([docs.schema[key].__class__("_key", docs.schema[key].dataType), T.StructField("_label", T.IntegerType()), T.StructField("number", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))]))
    table = got.toArrow().sort_by([("_key", "ascending"), ("_label", "ascending")])
    marks = table.column("_label").to_numpy().astype(np.float32)
    rows = [(np.asarray(a.values, np.int64), np.asarray(b.values, np.float32)) for a, b in zip(table.column("number"), table.column("value"), strict=True)]
    return train(rows, marks)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Key, held_out, score and predicted of each document."""
    prepare(docs.sparkSession)
    own = docs.select(F.col(f"`{key}`"), fold(F.col(f"`{key}`")).alias("_fold"), F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([own.schema[0], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for block, texts in _with_texts(batch.column("_text")):
                scores[block.rows] = sigmoid(model.logits(*_features(block, texts)).astype(np.float64))
            held = batch.column("_fold").to_numpy() == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=schema.names)

    return own.mapInArrow(run, schema)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score(docs, fit(docs, labels))
