"""Best-fit packing (op 4), planned on a histogram of lengths.

1. One pass over the texts makes token ids and writes a row per piece: lengths, offsets and a checksum, no ids. A document
   longer than a sequence is cut so that all but the first piece fill one. Pieces get a running number within their
   length and task.
2. Pieces are counted by length: as many rows as a sequence has tokens, whatever the input. Best fit in order of falling
   length is planned on these counts: a run of equal pieces goes to a run of sequences with equal room, the least room
   that fits. The plan has runs, not pieces.
3. A piece's rank within its length is its number plus the pieces of that length in earlier tasks. Its slot is found by
   looking its length and rank up in the plan. Nothing is sorted by length, so a length that a third of all pieces
   have costs no more than others.

Edge cases: null and empty texts are one piece of the end id alone. Null and repeated doc_ids, and repeated rows, are
documents of their own. Only key and text are read. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.storage import Workspace, prepare

CAPACITY, END_ID = 1024, 2
#: Rows of the plan; a histogram of CAPACITY lengths makes some thousands.
PLAN_ROWS = 2_000_000
# Fixed value: the pre-token pattern of byte-level BPE.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of() -> dict[str, int]:
    """The byte of each character in the vocabulary's spelling: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a text as little-endian 32-bit words.

    The vocabulary file is that of the ``tokenizers`` library. Where it cuts and spells texts as plain byte-level BPE does and its
    ids follow the order of its merges, the ids are ranks, and ``tiktoken`` gives the same ids from them in a third of the time. Texts that hold a special
    token's spelling, and other files, go through ``tokenizers``.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cutter = file["model"], file["pre_tokenizer"] or {}
        vocabulary, spelled = model["vocab"], _bytes_of()
        plain = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space", True) and cutter.get("use_regex", True) and not file["normalizer"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ", 1)) for m in model["merges"]]
        self.fast = None
        if plain and model["type"] == "BPE" and not model.get("dropout") and all(vocabulary.get(w) == 256 + i for i, w in enumerate(merged)):
            import tiktoken

            ranks = {bytes(spelled[c] for c in w): i for w, i in vocabulary.items() if w not in self.special}
            self.fast = tiktoken.Encoding("own", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of a document's pieces; the first is the rest."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, first sequence, offset, pieces, pieces a sequence, sequences' step) of best fit.

    Pieces of a run: rank r takes sequence first + (r - first rank) // each, at offset + ((r - first rank) % each) * length.
    """
    room: dict[int, list[list[int]]] = {}  # room left -> runs [first sequence, sequences]
    runs, sequences = [], 0

    def place(length: int, rank: int, n: int, first: int, left: int) -> None:
        """n pieces go to sequences from first on, that have this much left, each as many as fit."""
        each = left // length
        full, rest = divmod(n, each)
        runs.append((length, rank, first, capacity - left, n, each))
        if full and left - each * length:
            room.setdefault(left - each * length, []).append([first, full])
        if rest:
            if over := left - rest * length:
                room.setdefault(over, []).append([first + full, 1])

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while n:
            fitting = [r for r in room if r >= length]
            if not fitting:
                place(length, rank, n, sequences, capacity)
                sequences += -(-n // (capacity // length))
                break
            left = min(fitting)
            run = room[left].pop()
            if not room[left]:
                del room[left]
            each = left // length
            used = min(run[1], -(-n // each))
            some = min(n, used * each)
            if run[1] > used:
                room.setdefault(left, []).append([run[0] + used, run[1] - used])
            place(length, rank, some, run[0], left)
            rank, n = rank + some, n - some
    return np.array(runs, np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, and part and number for its rank."""
    prepare(docs.sparkSession)
    path = path or tokenizer_file()
    own = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([own.schema[0], *(T.StructField(n, T.LongType() if n != "piece" else T.IntegerType()) for n in ("piece", "start", "length", "ids_crc32", "number"))])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column("_text")):
                ids = encode(t.as_py() or "") + end
                for j, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append(i)
                    out.append((j, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), seen[n]))
                    seen[n] += 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))]
            arrays += [pa.array(np.array(c, np.int64), pa.int64()).cast(pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return own.mapInArrow(run, schema).withColumn("part", F.spark_partition_id())


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Key, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    work = Workspace(docs.sparkSession, "packing")
    cut_up = work.write(pieces(docs, key, text, capacity, path), "pieces")
    by_part = cut_up.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    counts = {r.length: r.n for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = plan(counts, capacity)
    if len(runs) > PLAN_ROWS:
        raise ValueError(f"a plan of {len(runs)} runs")
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    lengths, first_rank = runs[:, 0].copy(), runs[:, 1].copy()
    bounds = np.searchsorted(lengths, np.arange(capacity + 2))
    ranked = cut_up.join(by_part.select("length", "part", before.alias("_before")), ["length", "part"]).withColumn("_rank", F.col("number") + F.col("_before"))
    schema = T.StructType([docs.schema[key], *(cut_up.schema[n] for n in ("piece", "start", "length", "ids_crc32")), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.empty(len(n), np.int64)
            for length in np.unique(n):
                rows = n == length
                a, b = bounds[length], bounds[length + 1]
                at[rows] = a + np.searchsorted(first_rank[a:b], rank[rows], "right") - 1
            _, first, sequence, offset, _, each = runs[at].T
            k = rank - first
            arrays = [batch.column(c) for c in (key, "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence + k // each), pa.array(offset + k % each * n)], names=schema.names)

    return ranked.select(key, "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(slots, schema)


def query(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
