"""Names in texts: one operator for all that looks up a set of names, by an Aho-Corasick automaton in Arrow batches.

A task builds the automaton once and reads each text once, whatever the number of names. The set is checked: up to ``NAME_CHARS`` letters go
to every task; more names are parted by hash, and each part is a pass over the texts whose hits are written before the next one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.steps import settle

#: Letters of the names that one automaton holds.
NAME_CHARS = 4_000_000


def _find(names: list[str]):
    """Batches of key and text to key, name, at and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, name in enumerate(names):
            automaton.add_word(name, i)
        automaton.make_automaton()
        for batch in batches:
            rows, found, places, counts = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                first, ends, times = {}, {}, {}
                for end, i in automaton.iter(text or ""):
                    start = end - len(names[i]) + 1
                    if start > ends.get(i, -1):
                        first.setdefault(i, start)
                        ends[i], times[i] = end, times.get(i, 0) + 1
                rows += [row] * len(first)
                found += [names[i] for i in first]
                places += [start + 1 for start in first.values()]
                counts += [times[i] for i in first]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(places, pa.int32()), pa.array(counts, pa.int32())], names=["key", "name", "at", "n"])

    return run


def _firsts(names: list[str], size: int):
    """Batches of text and other columns, in their order, to the name and the others of the first ``size`` rows that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        left = [size] * len(names)
        automaton, idle = None, len(names) + 1
        for batch in batches:
            # names that have all their rows are left out again, once they are met more often than it costs to build
            if idle > len(names):
                automaton, idle = ahocorasick.Automaton(), 0
                for i, name in enumerate(names):
                    if left[i]:
                        automaton.add_word(name, i)
                automaton.make_automaton()
            rows, found = [], []
            for row, text in enumerate(batch.column("text").to_pylist() if len(automaton) else []):
                for i in {i for _, i in automaton.iter(text or "")}:
                    if left[i]:
                        left[i] -= 1
                        rows.append(row)
                        found.append(names[i])
                    else:
                        idle += 1
            others = [c for c in batch.schema.names if c != "text"]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(batch.column(c).take(at) for c in others)], names=["name", *others])

    return run


def _by_parts(known: DataFrame, rows: DataFrame, finder, schema: T.StructType | str, step: str) -> DataFrame:
    """The rows that finder(names) gives of Arrow batches, a pass for about ``NAME_CHARS`` letters of the names."""
    parts = max(1, -(-(known.agg(F.sum(F.length("name"))).first()[0] or 0) // NAME_CHARS))

    def part(i: int) -> DataFrame:
        own = [r.name for r in known.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == i).collect()]  # about NAME_CHARS letters
        if not own:
            return rows.sparkSession.createDataFrame([], schema)
        hits = rows.mapInArrow(finder(own), schema)
        return hits if parts == 1 else settle(hits, step)

    return reduce(DataFrame.unionByName, map(part, range(parts)))


def first_rows(rows: DataFrame, names: DataFrame, size: int, *order: Column, name: str = "name") -> DataFrame:
    """name and rows' columns but the text: the first ``size`` rows (text and others), in the order, whose text has the name as a part.

    The rows of a partition are put in order and read once, and of a name no more than ``size`` of them go on, so a name that most texts have
    costs no more than a rare one. Empty names are in no text.
    """
    known = settle(names.select(F.col(name).alias("name")).filter(F.length("name") > 0).distinct(), "names")
    schema = T.StructType([T.StructField("name", T.StringType()), *(f for f in rows.schema if f.name != "text")])
    firsts = _by_parts(known, rows.sortWithinPartitions(*order), lambda own: _firsts(own, size), schema, "first-rows")
    best = F.row_number().over(Window.partitionBy("name").orderBy(*order))
    return firsts.withColumn("_r", best).filter(F.col("_r") <= size).drop("_r").withColumnRenamed("name", name)


def mentions(texts: DataFrame, names: DataFrame, key: str, text: str, name: str = "name") -> DataFrame:
    """key, name, at and n: each name that a text has, its first place (from 1), and how often it stands without overlapping itself.

    Null texts and null or empty names have no mentions; repeated names are one. Rows are judged each for itself, also those that share a key.
    """
    known = settle(names.select(F.col(name).alias("name")).filter(F.length("name") > 0).distinct(), "names")
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, name string, at int, n int"
    return _by_parts(known, rows, _find, schema, "mentions").withColumnRenamed("key", key)


def present(texts: DataFrame, names: DataFrame, key: str, text: str, least: int = 1) -> DataFrame:
    """key and names, sorted, of the texts that have ``least`` different ones or more; a key must be unique."""
    found = mentions(texts, names, key, text).groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("names"))
    return found.filter(F.size("names") >= least)


def leftmost(hits: DataFrame, key: str) -> DataFrame:
    """key and entities: of a text's names (key, name, at) those that don't overlap, the first and of these the longest first."""
    listed = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", (-F.length("name")).alias("len"), "name"))).alias("_x"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("names"))
    step = lambda s, x: F.when(x["at"] >= s["end"], F.struct((x["at"] - x["len"]).alias("end"), F.concat(s["names"], F.array(x["name"])).alias("names"))).otherwise(s)
    return listed.select(key, F.aggregate("_x", start, step)["names"].alias("entities"))
