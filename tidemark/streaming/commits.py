"""Several tables changed at once, and once for each batch of a stream.

A folder holds, as Parquet, ``<table>/change=n`` with the rows that change n puts, ``<table>-gone/change=n`` with the keys that it takes away, and
``commits``, a row a change, written last: its number, the tables it touches, and the query and batch that it comes from. What no commit names is not read, so
all tables of a change show at once or none does. A stream may bring a batch again, after a stop or with a lost checkpoint: its query
and number stand in ``commits`` then, and nothing is done. A change that was stopped before its commit is written again over its files.

A key's rows are those of the last change that names it; so a document's chunks are replaced as a whole by naming their document. ``compact``
writes the present rows as one change. There is one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming import events as ev

_COMMIT = "number int, since int, query string, batch long, touched array<string>"
_GONE = "-gone"


class Tables:
    """Tables at a path. schemas: a table's columns as DDL; keys: the columns whose rows are replaced together."""

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, str], keys: Mapping[str, list[str]]):
        self.spark, self.path, self.schemas, self.keys = spark, path.rstrip("/"), dict(schemas), dict(keys)

    def commits(self) -> list[Row]:
        """The commits that are read, in order: those since the last ``compact``, a row a change."""
        rows = self._all()
        since = max((r.since for r in rows), default=0)
        return [r for r in rows if r.number >= since]

    def done(self, query: str, batch: int) -> bool:
        """Whether the query's batch has been committed, before or since ``compact``."""
        return any(r.query == query and r.batch == batch for r in self._all())

    def read(self, table: str) -> DataFrame:
        """The table's present rows."""
        rows, gone = self._parts(table), self._parts(table + _GONE)
        if not rows:
            return self._empty(table)
        keys = self.keys[table]
        put = self._union(table, rows, self.schemas[table])
        if len(rows) == 1 and (not gone or max(gone) < rows[0]):
            return put.drop("_change")
        named = put.select(*keys, "_change").distinct()
        if gone:
            named = named.unionByName(self._union(table + _GONE, gone, self._key_schema(table)))
        last = named.groupBy(*keys).agg(F.max("_change").alias("_last"))
        same = reduce(lambda a, b: a & b, [put[k].eqNullSafe(last[k]) for k in keys])
        return put.join(last, same & (put["_change"] == last["_last"]), "left_semi").drop("_change")

    def commit(self, query: str, batch: int, put: Mapping[str, DataFrame], gone: Mapping[str, DataFrame] | None = None) -> bool:
        """put: new rows of tables; gone: keys of tables that go. False, and nothing is written, if the batch has been committed."""
        if self.done(query, batch):
            return False
        self._write(query, batch, put, gone or {}, None)
        return True

    def compact(self) -> None:
        """All present rows as one change; the files of earlier ones may go once nobody reads them."""
        self._write("compact", -1, {t: self.read(t) for t in self.schemas}, {}, "self")

    def stream(self, df: DataFrame, query: str, checkpoint: str, change: Callable[[DataFrame, int], tuple[Mapping[str, DataFrame], Mapping[str, DataFrame]]]) -> None:
        """All that the stream has, a commit a batch. change: of a batch and its number, the rows to put and the keys that go."""

        def batch(rows: DataFrame, number: int) -> None:
            if not self.done(query, number):
                self.commit(query, number, *change(rows, number))

        ev.run_once(df, batch, checkpoint)

    # --- files -----------------------------------------------------------------------------------------------------

    def _all(self) -> list[Row]:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return []
        return sorted(self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits").collect(), key=lambda r: r.number)

    def _parts(self, table: str) -> list[int]:
        return [r.number for r in self.commits() if table in r.touched]

    def _key_schema(self, table: str) -> str:
        named = {f.name: f.dataType.simpleString() for f in self._empty(table).schema}
        return ", ".join(f"`{k}` {named[k]}" for k in self.keys[table])

    def _empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], self.schemas[table])

    def _union(self, table: str, parts: list[int], schema: str) -> DataFrame:
        """One scan of the parts' files, with the number of the change."""
        paths = [f"{self.path}/{table}/change={n}" for n in parts]
        return self.spark.read.schema(f"{schema}, change int").option("basePath", f"{self.path}/{table}").parquet(*paths).withColumnRenamed("change", "_change")

    def _write(self, query: str, batch: int, put: Mapping[str, DataFrame], gone: Mapping[str, DataFrame], since: str | None) -> None:
        before = self._all()
        number = max((r.number for r in before), default=0) + 1
        keys = {t + _GONE: df.select(*self.keys[t]).distinct() for t, df in gone.items()}
        rows = {t: df.select(*self._empty(t).columns) for t, df in put.items()}
        for table, df in {**rows, **keys}.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{table}/change={number}")
        start = number if since else max((r.since for r in before), default=0)
        record = [(number, start, query, batch, sorted([*rows, *keys]))]
        self.spark.createDataFrame(record, _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
