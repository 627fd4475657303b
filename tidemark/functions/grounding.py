"""Whether an answer's words stand in its source: longest common run of comparable characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import types as ty

from tidemark.operators.facts_py import comparable

LEAST, SHARE = 6, 0.3


def common_run(a: str, b: str) -> int:
    """Length of the longest string that both contain, by the suffix automaton of the shorter one; linear in both.

    Where the longer one holds the shorter one whole, no automaton is made.
    """
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return len(a)
    after: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in a:
        new, p = len(after), last
        after.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(after)
                after.append(dict(after[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    best = run = at = 0
    for c in b:
        while at and c not in after[at]:
            at = link[at]
            run = length[at]
        if c in after[at]:
            at, run = after[at][c], run + 1
            best = max(best, run)
    return best


@F.pandas_udf(ty.INT)
def longest_common_run(answers: pd.Series, sources: pd.Series) -> pd.Series:
    return pd.Series([common_run(comparable(a), comparable(s)) for a, s in zip(answers, sources, strict=True)])


@F.pandas_udf(ty.BOOLEAN)
def grounded(answers: pd.Series, sources: pd.Series) -> pd.Series:
    """A run of LEAST characters that covers SHARE of the answer; shorter answers have no ground."""

    def one(a: str | None, s: str | None) -> bool:
        a = comparable(a)
        return len(a) >= LEAST and common_run(a, comparable(s)) >= max(LEAST, SHARE * len(a))

    return pd.Series([one(a, s) for a, s in zip(answers, sources, strict=True)])
