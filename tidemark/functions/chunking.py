"""Retrieval chunks of a normalised text, in an Arrow batch."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import types as ty

from tidemark.functions import tables
from tidemark.functions import text as tx

SIZE, OVERLAP, LEAST = 700, 100, 10
_SENTENCE = re.compile("[^。！？!?；;\n\r]*[。！？!?；;\n\r]|[^。！？!?；;\n\r]+")


def sentences(paragraph: str) -> list[str]:
    """Each with its end mark; blank ones are left out."""
    return [s for s in _SENTENCE.findall(paragraph) if s.strip()]


def _long(paragraph: str, size: int, overlap: int) -> list[str]:
    """Sentences gathered up to size; the next piece begins with the last characters of the one before."""
    out, now = [], ""
    for sentence in sentences(paragraph):
        for at in range(0, len(sentence), size):
            piece = sentence[at : at + size]
            if len(now) + len(piece) <= size:
                now += piece
            elif now:
                out.append(now.strip())
                now = (now[-overlap:] if overlap else "") + piece
            else:
                out.append(piece.strip())
    return out + [now.strip()] if now.strip() else out


def _tabular(paragraph: str) -> bool:
    lines = [x for x in paragraph.splitlines() if x.strip()]
    return len(lines) >= 2 and sum(bool(re.match(tables.ROW, x)) for x in lines) >= max(2, len(lines) * 0.5)


def chunks_of(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    size = max(120, size)
    overlap = max(0, min(overlap, size // 2))
    out, held = [], ""
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text or ""))):
        joined = f"{held}\n{paragraph}" if held else paragraph
        if len(paragraph) <= size and len(joined) <= size:
            held = joined
            continue
        out += [held] if held else []
        held = ""
        if len(paragraph) <= size:
            held = paragraph
        else:
            out += tables.split_rows(paragraph, size) if _tabular(paragraph) else _long(paragraph, size, overlap)
    return [c for c in out + [held] if len(c) >= LEAST]


def chunk_text(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<string> of a raw text's chunks."""

    @F.pandas_udf(ty.STRINGS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks_of(t, size, overlap))

    return cut(tx.normalize(text))
