"""Connected components of a table of links, by contraction, without collecting anything.

Each round maps every node to the smallest of itself and its neighbours, follows that map to its ends by squaring it, and rewrites
the links between the ends; links within one end are dropped and equal ones merged. Of two neighbours one is no end, so
the nodes that are left halve at least, and a crowd around few nodes is gone after one round. The rounds' maps, joined one after the
other, give the labels. Every round is a written table, which cuts the lineage. A join gives a row a link or a row a node.

Edge cases: links of a node with itself and repeated links count for nothing; null ends are left out; no links give no labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import Workspace


def _squared(hops: DataFrame) -> DataFrame:
    """A map (node, up) applied to its own result."""
    far = hops.select(F.col("node").alias("up"), F.col("up").alias("far"))
    return hops.join(far, "up").select("node", F.col("far").alias("up"))


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def components(links: DataFrame, work: Workspace, name: str = "labels") -> DataFrame:
    """node and label, the smallest node that can be reached, for all nodes of links (a, b) between different nodes."""
    left = work.write(_ends(links), f"{name}-links-0")
    labels = None
    rounds = 0
    while not left.isEmpty():
        low = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        own = left.select(F.col("a").alias("node"), F.col("a").alias("up")).distinct()
        up = work.write(low.unionByName(own).groupBy("node").agg(F.min("up").alias("up")), f"{name}-map-{rounds}-0")
        hops = 0
        while True:
            more = _squared(_squared(up)).withColumnRenamed("up", "end").join(up, "node")
            hops += 1
            more = work.write(more.select("node", F.col("end").alias("up"), (F.col("end") != F.col("up")).alias("moved")), f"{name}-map-{rounds}-{hops}")
            work.drop(f"{name}-map-{rounds}-{hops - 1}")
            up = more.select("node", "up")
            if more.filter("moved").isEmpty():
                break
        a, b = (up.select(F.col("node").alias(x), F.col("up").alias(f"_{x}")) for x in "ab")
        new = work.write(_ends(left.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))), f"{name}-links-{rounds + 1}")
        work.drop(f"{name}-links-{rounds}")
        if labels is None:
            labels = work.write(up.withColumnRenamed("up", "label"), f"{name}-0")
        else:
            far = up.select(F.col("node").alias("label"), F.col("up").alias("far"))
            labels = work.write(labels.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label")), f"{name}-{rounds}")
            work.drop(f"{name}-{rounds - 1}")
        work.drop(f"{name}-map-{rounds}-{hops}")
        left, rounds = new, rounds + 1
    return left.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels
