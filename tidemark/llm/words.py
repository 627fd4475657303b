"""Words, word hashes and window hashes of many texts at once, as numpy arrays.

A word is a longest run of bytes outside space, \\t, \\n, \\v, \\f and \\r, which is what ``bytes.split`` gives;
``bytes.lower`` changes A-Z only. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S29, _S31, _S32 = np.uint64(29), np.uint64(31), np.uint64(32)
#: Bytes of text whose words are held as objects at one time.
BLOCK_BYTES = 1_500_000


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, which depends on their order."""
    x = (a ^ (a >> _S29)) * _K1
    x += (b ^ (b >> _S31)) * _K2
    x ^= x >> _S32
    x *= _K3
    x ^= x >> _S29
    return x


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive hashes, in about 2 log2(k) passes; empty if there are fewer than k."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    power, size, out, done = h, 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, done = power, size
            else:
                n = len(h) - (done + size) + 1
                out, done = mix(out[:n], power[done : done + n]), done + size
        if done == k:
            return out
        power, size = mix(power[: len(power) - size], power[size:]), 2 * size


@dataclass
class Block:
    """Some rows of a table: their words end to end; row i has the words starts[i]:starts[i + 1]."""

    rows: np.ndarray
    words: list[bytes]
    starts: np.ndarray
    hashes: np.ndarray

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of k words that lie within one row, and where each starts."""
        all_hashes = window_hashes(self.hashes, k)
        inside = np.ones(len(all_hashes), bool)
        for back in range(1, k):  # a window that starts this short before the next row reaches into it
            at = self.starts[1:-1] - back
            at = at[(at >= 0) & (at < len(inside))]
            inside[at] = False
        # rows shorter than k: the starts above cover them, as each lies within k - 1 words of a later row's start
        places = np.flatnonzero(inside)
        return all_hashes[places], places

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each row's shingles with repeats, and bounds per row. A row of 1 to k-1 words has one shingle: all it has."""
        hashes, places = self.windows(k)
        n = np.diff(self.starts)
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            own = np.empty(len(short), np.uint64)
            for i, row in enumerate(short):
                a, b = self.starts[row], self.starts[row + 1]
                own[i] = window_hashes(self.hashes[a:b], int(b - a))[0] ^ np.uint64(int(b - a) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            order = np.argsort(np.concatenate([places, self.starts[short]]), kind="stable")
            hashes, places = np.concatenate([hashes, own])[order], np.concatenate([places, self.starts[short]])[order]
        return hashes, np.searchsorted(places, self.starts)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def blocks(texts: pa.Array | pa.ChunkedArray, lower: bool = False, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive rows of a string column, as many at a time as have block_bytes of text, or one. Nulls have no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + block_bytes, "right")))
        part = texts.slice(at, stop - at).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
        if lower:
            per_row = [x.lower().split() if x else [] for x in part]
        else:
            per_row = [x.split() if x else [] for x in part]
        starts = np.zeros(len(per_row) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, per_row), np.int64, len(per_row)), out=starts[1:])
        words = [w for row in per_row for w in row]
        yield Block(np.arange(at, stop), words, starts, hash_words(words))
        at = stop
