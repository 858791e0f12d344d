import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siftmill.llm import suffixes
from tests.oracle import compare

from .data import frame, hard_rows, prose, save

PASSAGE = prose(77, 60, 50)


def rows():
    out = hard_rows() + [(100 + i, f"{prose(200 + i, 40)} {PASSAGE} {prose(300 + i, 40)}", "en", "s", 1) for i in range(6)]
    out += [(110, " ".join(PASSAGE.split(" ")[:49]), "en", "s", 1), (111, " ".join(PASSAGE.split(" ")[:50]), "en", "s", 1)]
    out += [(120, "again " * 400, "en", "s", 1), (121, "x " + "again " * 333, "en", "s", 1), (122, "one two three " * 90, "en", "s", 1), (123, "two three one " * 80, "en", "s", 1)]
    out += [(130, f"{prose(88, 70)} {prose(88, 70)}", "en", "s", 1)]  # repeats itself only
    return out


def test_sql(spark, tmp_path):
    d = save(spark, tmp_path, documents=frame(spark, [r for r in rows() if r[0] != 50]))  # the very long text takes SQL minutes
    compare(suffixes.query(spark, d), suffixes.SQL, d)


def test_defined_results(spark):
    docs = frame(spark, rows(), clash=True)
    got = [tuple(r) for r in suffixes.repeats(docs).collect()]
    ids = {d for d, _, _ in got}
    assert {20, 21, 100, 105, 111, 120, 121} <= ids and not {110, 130, 30, 40, 41, 43, 50, None} & ids
    assert (100, 40, 100) in got
    later = {r["doc_id"] for r in suffixes.repeats(docs, later=True).collect()}
    assert 21 in later and 20 not in later and 100 not in later and {101, 105} <= later
    assert suffixes.repeats(docs.limit(0)).count() == 0


def test_hot_names_give_the_same_spans(spark):
    docs = frame(spark, rows())
    for later in (False, True):
        want = sorted(tuple(r) for r in suffixes.repeats(docs, later=later).collect())
        assert want == sorted(tuple(r) for r in suffixes.repeats(docs, later=later, hot=3).collect())
        assert want == sorted(tuple(r) for r in suffixes.repeats(docs, later=later, hot=0).collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=12, max_size=80), st.integers(1, 6))
def test_multikey_quicksort_groups_what_shares_a_prefix(values, shallow):
    words = np.array([*values, *range(100, 120)], np.uint32)
    at = np.arange(len(values))
    got = sorted(tuple(sorted(p.tolist())) for p in suffixes.quicksort(words, at, np.zeros(len(at), np.int64), shallow))
    by = {}
    for i in at.tolist():
        by.setdefault(tuple(words[i : i + shallow].tolist()), []).append(i)
    assert got == sorted(tuple(v) for v in by.values() if len(v) > 1)


def test_blind_trie_orders():
    r = random.Random(4)
    strings = [bytes(r.choice(b"ab\x00\xff") for _ in range(9)) for _ in range(300)]
    trie = suffixes.BlindTrie()
    for i, s in enumerate(strings):
        trie.add(s, i)
    leaves = list(trie.leaves())
    assert [s for s, _ in leaves] == sorted(set(strings))
    assert all(sorted(m) == [i for i, x in enumerate(strings) if x == s] for s, m in leaves)
