import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from hypothesis import given, settings
from hypothesis import strategies as st

from siftmill.llm import textkit


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 éÉß.,-\n中 ", max_size=30)), min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = textkit.words(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        want = re.findall("[0-9a-z\x80-\U0010ffff]+", pa.compute.utf8_lower(pa.scalar(t or "")).as_py())
        got = [w.data[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.first[i], w.first[i + 1])]
        assert got == want
    by = {}
    for k in range(len(w.hash)):
        by.setdefault(w.data[w.start[k] : w.end[k]].tobytes(), set()).add(int(w.hash[k]))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_slices_and_grams():
    a = pa.array(["skip me", "one two three four", "five six"]).slice(1)
    w = textkit.words(a)
    g, ok = textkit.grams(w, 3)
    assert ok.tolist() == [True, True, False, False, False, False]
    again, _ = textkit.grams(textkit.words(pa.array(["x two three four"])), 3)
    assert g[1] == again[1] and len(np.unique(g[:2])) == 2
