"""A wiki's listing of pages as a source of ``spark.read`` and ``spark.readStream``.

    spark.dataSource.register(listing.Listing)
    spark.read.format("listing").option("opener", "package.module:function").option("names", "a,b").load()

The opener (name, token) gives a listing's answer of one hop as JSON: titles, and the token of the next hop, if any. It is a function that every worker can
import; nothing here reaches the network by itself. Instead of it the option ``path`` names a folder of answers that ``store`` has written.

A table's partitions are the names, so sources are read side by side, and a task holds one hop's titles at a time. A stream's offset is, for each name, the next token and how
many titles came before; a batch takes ``hops`` answers of each name, and the next run goes on from the checkpoint, without repeats. A listing that is at its end
stays there; a token that comes again within a batch ends it. Answers must be the same whenever they are asked for, as a repeated batch asks again.
Maintenance pages are rows too; ``wiki.meta_title`` filters them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from importlib import import_module
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: A listing's first token, and the mark of its end.
FIRST, END = "", None
Opener = Callable[[str, str], str]


def _folder(token: str) -> str:
    return "t" + token.encode().hex().upper()


def store(answers: DataFrame, path: str) -> None:
    """answers (name, token, body), one of each name and token, as a folder that the source reads; the first token is empty."""
    token = F.concat(F.lit("t"), F.hex(F.encode("token", "utf-8")))
    rows = answers.select(F.concat(F.lit("t"), F.hex(F.encode("name", "utf-8"))).alias("name"), token.alias("token"), F.regexp_replace("body", r"[\r\n]+", " "))
    rows.repartition("name", "token").write.mode("overwrite").partitionBy("name", "token").text(path)


def _stored(path: str) -> Opener:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def answer(name: str, token: str) -> str:
        folder = f"{root}/name={_folder(name)}/token={_folder(token)}"
        files = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        found = sorted(f.path for f in files if f.base_name.startswith("part-"))
        return "".join(store.open_input_stream(f).read().decode("utf-8") for f in found)

    return answer


def _opener(options: dict[str, str]) -> Opener:
    if "path" in options:
        return _stored(options["path"])
    module, _, function = options["opener"].partition(":")
    return getattr(import_module(module), function)


def parse(body: str) -> tuple[list[str], str | None]:
    """An answer's titles and the token of the next hop; an answer that can't be read ends the listing."""
    try:
        answer = json.loads(body)
        rows = answer.get("query", {}).get("allpages", [])
        token = answer.get("continue", {}).get("apcontinue")
        return [r["title"] for r in rows if isinstance(r.get("title"), str)], token if isinstance(token, str) and token else END
    except (ValueError, AttributeError, TypeError):
        return [], END


class _Part(InputPartition):
    """A name's answers from a token up to another."""

    def __init__(self, name: str, token: str, place: int, until: str | None):
        self.name, self.token, self.place, self.until = name, token, place, until


def _walk(opener: Opener, name: str, token: str | None, place: int) -> Iterator[tuple[list[str], str | None, int]]:
    """Titles, next token and the place of the first title of each answer from a token on."""
    seen = set()
    while token is not END:
        seen.add(token)
        titles, token = parse(opener(name, token))
        token = END if token in seen else token
        yield titles, token, place
        place += len(titles)


def _rows(opener: Opener, part: _Part) -> Iterator[tuple[str, str, int]]:
    for titles, following, place in _walk(opener, part.name, part.token, part.place):
        yield from ((part.name, title, place + i) for i, title in enumerate(titles))
        if following == part.until:
            return


class Listing(DataSource):
    """source, title and place (from 0). Options: names (comma-joined), opener or path, hops (of a stream's batch, 1 unless given)."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "source string, title string, place long"

    def names(self) -> list[str]:
        return list(dict.fromkeys(n.strip() for n in self.options.get("names", "").split(",") if n.strip()))

    def reader(self, schema) -> _Table:
        return _Table(self)

    def streamReader(self, schema) -> _Stream:  # noqa: N802
        return _Stream(self)


class _Table(DataSourceReader):
    def __init__(self, source: Listing):
        self.options, self.names = dict(source.options), source.names()

    def partitions(self) -> list[InputPartition]:
        return [_Part(n, FIRST, 0, END) for n in self.names]

    def read(self, partition: _Part) -> Iterator[tuple[str, str, int]]:
        if partition is not None:
            yield from _rows(_opener(self.options), partition)


class _Stream(DataSourceStreamReader):
    """Offsets: name to [next token, titles before it]. The driver walks tokens; titles are read by tasks, which ask for the same answers."""

    def __init__(self, source: Listing):
        self.options, self.names = dict(source.options), source.names()
        self.hops = int(source.options.get("hops", "1"))
        self.at: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {n: [FIRST, 0] for n in self.names}

    def latestOffset(self) -> dict:  # noqa: N802
        start, opener = self.at or self.initialOffset(), _opener(self.options)
        new = {}
        for name in self.names:
            token, place = start.get(name, [FIRST, 0])
            for titles, following, before in islice(_walk(opener, name, token, place), self.hops):
                token, place = following, before + len(titles)
            new[name] = [token, place]
        self.at = new
        return new

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end
        parts = [(n, *start.get(n, [FIRST, 0])) for n in end]
        return [_Part(n, token, place, end[n][0]) for n, token, place in parts if token is not END and [token, place] != end[n]]

    def read(self, partition: _Part) -> Iterator[tuple[str, str, int]]:
        yield from _rows(_opener(self.options), partition)

    def commit(self, end: dict) -> None:
        pass
