import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.words import blocks, window_hashes


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n ", max_size=40)), max_size=8), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_windows_are_those_of_each_row(texts, k):
    want = []
    for t in texts:
        w = t.encode().split() if t else []
        want.append([tuple(w[i : i + k]) for i in range(len(w) - k + 1)])
    got, seen = [], {}
    for block in blocks(pa.array(texts, pa.string()), block_bytes=20):
        hashes, places = block.windows(k)
        cuts = np.searchsorted(places, block.starts)
        got += [list(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert [len(x) for x in want] == [len(x) for x in got]
    for a, b in zip(sum(want, []), sum(got, []), strict=True):
        assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_short_rows_are_one_shingle():
    (block,) = blocks(pa.array(["a b", "", None, "A B", "a b c d e", "a"]), lower=True)
    hashes, bounds = block.shingles(5)
    assert np.diff(bounds).tolist() == [1, 0, 0, 1, 1, 1]
    assert hashes[0] == hashes[1] and len(set(hashes.tolist())) == 3


def test_window_order_matters():
    h = np.arange(1, 9, dtype=np.uint64)
    assert window_hashes(h, 3)[0] != window_hashes(h[::-1].copy(), 3)[-1]
