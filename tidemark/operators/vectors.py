"""Nearest vectors by cosine, exactly, with cells around pivots.

Vectors are taken at length one, where a larger cosine is a shorter distance, and each goes to the cell of its nearest pivot. A cell knows its least and its
largest distance to the pivot, so by the triangle inequality no member is nearer to a query than the query's own distance to the pivot less the largest
(or the least less it). A query is scored in its nearest cells first; its k-th result there rules out all cells that can't hold a better one or an equal one.
What is left is scored by matrix products, a piece of a cell with a slice of queries at a time, and a task keeps a query's k best. How many cells are ruled out depends on
the vectors: of clustered ones most, of vectors without any structure in many dimensions none, and then every piece meets every slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.steps import settle

#: Pivots at most, and vectors for each of them in smaller tables; vectors of a piece and queries of a slice, about; cells that a query is scored in first.
PIVOTS, MEMBERS, PIECE, SLICE, FIRST_CELLS = 1024, 256, 4096, 4096, 2
#: Half a unit of the last of four decimals, and what floating point may add to a distance.
HALF, SLACK = 0.00005, 1e-7
_ROWS = 256


def _unit(column: str):
    """The vector at length one; null for one without length, or with a null or a number in it that isn't finite."""
    plain = F.transform(column, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(plain, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(plain, lambda x: x / norm))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list())


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


def _choose(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by dimension: a sample by hash, one for ``MEMBERS`` rows and ``PIVOTS`` at most, without repeats; one for a table of a piece's size."""
    count = vectors.count()
    n = 1 if count <= PIECE else min(PIVOTS, count // MEMBERS + 1)
    rows = vectors.select("_v").orderBy(F.xxhash64("_v")).limit(n).collect()
    by: dict[int, dict[tuple, None]] = {}
    for r in rows:
        by.setdefault(len(r[0]), {})[tuple(r[0])] = None
    return {d: np.array(list(x)) for d, x in by.items()}


def _to_cells(pivots: dict[int, np.ndarray]):
    """Rows with _dim, _cell and _r; a dimension without a pivot has one cell, about nothing."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            dims = rows["_v"].map(len)
            for dim, own in rows.groupby(dims):
                cell, r = np.full(len(own), -1), np.zeros(len(own))
                if dim in pivots:
                    far = _distance(_matrix(own["_v"]), pivots[dim])
                    cell = far.argmin(1)
                    r = far[np.arange(len(own)), cell]
                yield own.assign(_dim=np.int32(dim), _cell=cell.astype(np.int32), _r=r)

    return assign


def _pairs(pivots: dict[int, np.ndarray], cells: pd.DataFrame, later: bool):
    """For each query the cells to be scored: the nearest ones, or later those beside them that may hold a result as good as its k-th (_t)."""

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for dim, own in rows.groupby(rows["_v"].map(len)):
                known = cells[cells["_dim"] == dim]
                if known.empty:
                    continue
                ids = known["_cell"].to_numpy()
                if dim in pivots:
                    far = _distance(_matrix(own["_v"]), pivots[dim][ids])
                    bound = np.maximum(far - known["_far"].to_numpy(), known["_near"].to_numpy() - far)
                else:
                    bound = far = np.zeros((len(own), len(ids)))
                first = np.argsort(far, axis=1, kind="stable")[:, :FIRST_CELLS]
                mask = np.zeros(far.shape, bool)
                np.put_along_axis(mask, first, True, axis=1)
                if later:
                    t = own["_t"].to_numpy(float)
                    reach = np.sqrt(2 - 2 * np.where(np.isnan(t), 0.0, np.maximum(t - HALF, 0.0))) + SLACK
                    mask = ~mask & (bound <= reach[:, None])
                i, j = np.nonzero(mask)
                yield pd.DataFrame({"_q": own["_q"].to_numpy()[i], "_dim": np.int32(dim), "_cell": ids[j].astype(np.int32)})

    return pair


def _best(k: int):
    """The k best of a piece for each query of a slice, ties by key."""

    def score(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.sort_values("_k")
        keys, right, n = vectors["_k"].to_numpy(), _matrix(vectors["_v"]) if len(vectors) else None, len(vectors)
        out = []
        for at in range(0, len(queries) if n else 0, _ROWS):
            own = queries.iloc[at : at + _ROWS]
            names = own["_q"].to_numpy()
            cos = np.floor((_matrix(own["_v"]) @ right.T) * 10000 + 0.5).astype(np.int64)
            cos[keys[None, :] == names[:, None]] = 0
            rank = (20000 - cos) * n + np.arange(n)  # one number for each vector: its cosine first, then its key
            best = np.argpartition(rank, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), rank.shape)
            i = np.repeat(np.arange(len(own)), best.shape[1])
            j = best.ravel()
            good = cos[i, j] > 0
            out.append(pd.DataFrame({"_q": names[i[good]], "_k": keys[j[good]], "relevance": cos[i[good], j[good]] / 10000}))
        return pd.concat(out) if out else pd.DataFrame({"_q": [], "_k": [], "relevance": []})

    return score


class Cells:
    """vectors (key, column) in cells, written once; keys of one type with the queries', nulls are left out."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", column: str = "embedding"):
        own = vectors.select(F.col(key).alias("_k"), _unit(column).alias("_v")).filter("_k IS NOT NULL AND _v IS NOT NULL")
        own = settle(own, "units")
        self.pivots = _choose(own)
        schema = f"_k {own.schema['_k'].dataType.simpleString()}, _v array<double>, _dim int, _cell int, _r double"
        self.rows = settle(own.mapInPandas(_to_cells(self.pivots), schema), "cells")
        #: A row a cell: at most ``PIVOTS``, and one for each dimension that has no pivot.
        self.cells = self.rows.groupBy("_dim", "_cell").agg(F.min("_r").alias("_near"), F.max("_r").alias("_far"), F.count("*").alias("_n")).toPandas()

    def pairs(self, queries: DataFrame, later: bool = False) -> DataFrame:
        """_q, _dim and _cell of the cells in which queries (_q, _v, and _t later) are scored."""
        key = queries.schema["_q"].dataType.simpleString()
        return queries.mapInPandas(_pairs(self.pivots, self.cells, later), f"_q {key}, _dim int, _cell int")

    def top(self, queries: DataFrame, k: int, qkey: str = "query_id", column: str = "embedding", block: int = SLICE) -> DataFrame:
        """qkey, _k and relevance of each query's k nearest vectors above 0, itself apart; ties by key."""
        asked = queries.select(F.col(qkey).alias("_q"), _unit(column).alias("_v")).filter("_q IS NOT NULL AND _v IS NOT NULL")
        asked = settle(asked, "queries")
        slices = max(1, -(-asked.count() // block))
        if self.cells.empty or self.cells.groupby("_dim").size().max() <= FIRST_CELLS:  # the first cells are all
            return self._scored(asked, self.pairs(asked), k, slices).withColumnRenamed("_q", qkey)
        first = settle(self._scored(asked, self.pairs(asked), k, slices), "first")
        kth = first.groupBy("_q").agg(F.count("*").alias("_n"), F.min("relevance").alias("_t")).filter(F.col("_n") >= k)
        more = self._scored(asked, self.pairs(asked.join(kth.select("_q", "_t"), "_q", "left"), later=True), k, slices)
        return self._first(first.unionByName(more), k).withColumnRenamed("_q", qkey)

    def _first(self, df: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("_q").orderBy(F.desc("relevance"), "_k")
        return df.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= k).drop("_i")

    def _scored(self, asked: DataFrame, pairs: DataFrame, k: int, slices: int) -> DataFrame:
        spark = asked.sparkSession
        sizes = F.broadcast(spark.createDataFrame(self.cells[["_dim", "_cell", "_n"]], "_dim int, _cell int, _n long"))  # a row a cell
        pieces = F.ceil(F.col("_n") / PIECE).cast("int")
        part = F.pmod(F.xxhash64("_q"), F.lit(slices)).cast("int")
        own = pairs.join(sizes, ["_dim", "_cell"]).join(asked, "_q").withColumn("_slice", part)
        own = own.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).select("_q", "_v", "_dim", "_cell", "_piece", "_slice")
        piece = self.rows.join(sizes, ["_dim", "_cell"]).withColumn("_piece", F.pmod(F.xxhash64("_k"), pieces).cast("int"))
        met = own.select("_dim", "_cell", "_piece", F.col("_slice").alias("_part")).distinct()
        piece = piece.join(met, ["_dim", "_cell", "_piece"]).select("_k", "_v", "_dim", "_cell", "_piece", "_part")
        by = ["_dim", "_cell", "_piece"]
        kinds = [asked.schema["_q"].dataType.simpleString(), self.rows.schema["_k"].dataType.simpleString()]
        found = piece.groupBy(*by, "_part").cogroup(own.groupBy(*by, "_slice")).applyInPandas(_best(k), f"_q {kinds[0]}, _k {kinds[1]}, relevance double")
        return self._first(found, k)
