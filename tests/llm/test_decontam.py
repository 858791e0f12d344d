import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from siftmill.llm import decontam, textkit

from .data import edited, frame, hard_rows, prose

ITEMS = "item_id long, text string, score string"


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def smith_waterman(a, b):
    """Plain dynamic programme: the best score."""
    before, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, before[j - 1] + (decontam.MATCH if x == y else decontam.MISS), before[j] - decontam.GAP, row[j - 1] - decontam.GAP))
            best = max(best, row[-1])
        before = row
    return best


def tables(spark):
    items = [(i, prose(1000 + i, 30, 50)) for i in range(6)]
    docs = hard_rows()
    docs += [(200, f"{prose(7, 40)} {items[0][1]} {prose(8, 40)}", "en", "s", 1), (201, f"{prose(9, 30)} {edited(items[1][1], 0.15, 4)}", "en", "s", 1)]
    half = items[2][1].split(" ")
    docs += [(202, " ".join(half[:20]), "en", "s", 1), (203, " ".join([*half[:12], "and", "then", *half[12:]]).upper(), "en", "s", 1)]
    docs += [(300 + i, f"{items[3][1]} {prose(500 + i, 20)}", "en", "s", 1) for i in range(40)]  # leaked often
    docs += [(400, " ".join(items[4][1].split(" ")[:4]) + " " + prose(11, 60), "en", "s", 1)]  # too little
    return docs, [*items, (6, None), (None, items[0][1]), (7, "two words"), (0, items[0][1])]


def test_against_brute_force(spark):
    docs, items = tables(spark)
    got = decontam.leaks(frame(spark, docs, clash=True), spark.createDataFrame([(*i, "own") for i in items], ITEMS)).collect()
    want = {}
    for d, text, *_ in docs:
        for i, item in items:
            a, b = words(item), words(text)
            if d is None or i is None or len(a) < decontam.N or not b or len(b) > 5000:
                continue
            score = smith_waterman(a, b) / (decontam.MATCH * len(a))
            if score >= decontam.LEAK:
                want[d, i] = max(score, want.get((d, i), 0))
    assert {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert {200, 201, 202, 203, 300, 339} <= {d for d, _ in want} and 400 not in {d for d, _ in want}
    span = next(r for r in got if (r["doc_id"], r["item_id"]) == (200, 0))
    assert (span["start_word"], span["end_word"]) == (40, 70)


def test_shards_change_nothing(spark):
    docs, items = tables(spark)
    a, b = frame(spark, docs), spark.createDataFrame([(*i, "own") for i in items], ITEMS)
    assert sorted(map(tuple, decontam.leaks(a, b).collect())) == sorted(map(tuple, decontam.leaks(a, b, shard_words=60).collect()))


def test_alignment_of_batches(spark):
    rng = np.random.default_rng(3)
    a = [rng.integers(0, 6, n).astype(np.uint32) for n in (5, 12, 1, 8)]
    b = [rng.integers(0, 6, n).astype(np.uint32) for n in (9, 30, 4, 8)]
    score, start, end = decontam.align(a, b)
    for i in range(4):
        assert score[i] == smith_waterman(a[i].tolist(), b[i].tolist())
        assert score[i] == smith_waterman(a[i].tolist(), b[i][start[i] : end[i]].tolist())


def test_clean(spark):
    docs, items = tables(spark)
    a, b = frame(spark, docs, clash=True), spark.createDataFrame([(*i, "own") for i in items], ITEMS)
    out = decontam.clean(a, b)
    kept = [r["doc_id"] for r in out.collect()]
    assert out.columns == a.columns and not {200, 201, 203, 300} & set(kept)
    assert {40, 41, 50, 400} <= set(kept) and kept.count(None) == 2 and kept.count(30) == 2
    assert decontam.clean(a, b.limit(0)).count() == a.count() and decontam.leaks(a.limit(0), b).count() == 0


def test_thinly_kept_copies(spark):
    """Copies that keep few or no runs of three words: each the only copy, and beside exact ones."""
    forms = [
        lambda w: [x if i % 4 != 3 else f"other{i}" for i, x in enumerate(w)],
        lambda w: [x if i % 3 != 2 else f"other{i}" for i, x in enumerate(w)],
        lambda w: [y for i, x in enumerate(w) for y in (x, f"other{i}")],
        lambda w: [x for i, x in enumerate(w) if i % 4 != 3],
        *[lambda w, s=s: edited(" ".join(w), 0.25 + 0.05 * (s % 2), s).split(" ") for s in range(6)],
    ]
    items = [(i, prose(6000 + i, 30, 50)) for i in range(2 * len(forms))]
    docs = [(i, f"{prose(6100 + i, 40)} {' '.join(forms[i // 2](t.split(' ')))} {prose(6200 + i, 40)}", "en", "s", 1) for i, t in items]
    docs += [(100 + i, f"{prose(6300 + i, 20)} {t}", "en", "s", 1) for i, t in items[1::2]]
    docs += [(200 + i, prose(6400 + i, 300), "en", "s", 1) for i in range(5)]
    want = {}
    for d, text, *_ in docs:
        for i, item in items:
            score = smith_waterman(words(item), words(text)) / (decontam.MATCH * len(words(item)))
            if score >= decontam.LEAK:
                want[d, i] = round(score, 9)
    got = decontam.leaks(frame(spark, docs), spark.createDataFrame([(*i, "own") for i in items], ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in got} == want
    assert {(i, i) for i in range(6)} <= set(want)


@settings(max_examples=300, deadline=None)
@given(st.integers(3, 40), st.lists(st.sampled_from("kkkkkkrid"), min_size=40, max_size=40), st.integers(0, 3), st.integers(2, 60), st.integers(0, 2**32 - 1))
def test_passages_hold_every_alignment_that_counts(size, edits, often, vocabulary, seed):
    """Words kept, replaced, inserted after, deleted; any frequencies of the pairs."""
    rng = np.random.default_rng(seed)
    item = [f"w{i}" for i in rng.integers(0, vocabulary, size)]
    text = [f"x{i}" for i in range(rng.integers(0, 30))]
    for i, (word, edit) in enumerate(zip(item, edits, strict=False)):
        text += {"k": [word], "r": [f"y{i}"], "i": [word, *[f"z{i}v{j}" for j in range(1 + often)]], "d": []}[edit]
    text += [f"v{i}" for i in range(rng.integers(0, 30))]
    items = decontam.Items.of([1, 2], [" ".join(item), "other words of a further item w1 w2 w3"], 3, decontam.LEAK)
    items = items.rare(rng.integers(0, 4, len(items.grams)) ** 3, decontam.KEEP)
    w = textkit.words(pa.array(["w1 w2 w0", " ".join(text), None]))
    which, lo, hi = decontam.passages(w, items, decontam.LEAK)
    best = smith_waterman(item, text)
    words_of = [t.encode() for t in ["w1", "w2", "w0", *text]]
    found = max((smith_waterman([x.encode() for x in item], words_of[a:b]) for k, a, b in zip(which, lo, hi, strict=True) if k == 0 and a >= 3), default=0)
    if best >= decontam.LEAK * decontam.MATCH * size and best > decontam.MATCH:
        assert found == best


def test_frequent_pairs_are_given_up_and_pay_for_it():
    items = decontam.Items.of([1], ["of the one of the two of the three of the four of the five"], 3, decontam.LEAK)
    frequency = np.where(items.many > 1, 1000, 1)
    rare = items.rare(frequency, decontam.KEEP)
    assert len(rare.grams) < len(items.grams) and rare.need[0] == items.need[0] - 2 * (items.many.sum() - rare.many.sum())
    assert items.rare(np.zeros(len(items.grams), np.int64), decontam.KEEP).need[0] == items.need[0]
