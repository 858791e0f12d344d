import random

import numpy as np
import pyarrow as pa
import pytest

from siftmill.llm import nbsvm, toxicity
from siftmill.llm.models import dual_descent, labelled

from .data import edited, frame, hard_rows, prose

INSULTS = "numskull blockhead dimwit buffoon".split()
LABELS = "doc_id long, quality int, toxic int, text string"


def junk(seed):
    r = random.Random(seed)
    text = prose(seed, 60)
    return text.upper().replace(" ", "!! ") if r.random() < 0.5 else text.replace(" ", "### ")


def insulted(seed):
    words = prose(seed, 80).split(" ")
    words.insert(random.Random(seed).randrange(10, 70), INSULTS[seed % 4])
    return " ".join(words)


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=80) > 0, 1, -1)
    every = np.arange(3)
    w = dual_descent([(every, r) for r in x], y, 3, 1.0, epochs=500, tolerance=1e-6)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(loss(w) <= loss(w + rng.normal(size=3) * s) + 1e-6 for s in (0.001, 0.01, 0.1) for _ in range(50))


def test_quality_on_held_out_documents(spark):
    texts = [prose(i, 60) for i in range(120)] + [junk(1000 + i) for i in range(120)]
    y = np.array([1] * 120 + [0] * 120)
    train = np.arange(240) % 2 == 0
    model = nbsvm.fit([t for t, k in zip(texts, train, strict=True) if k], y[train])
    s = model.scores(pa.array([t for t, k in zip(texts, train, strict=True) if not k])) >= 0
    assert (s == (y[~train] == 1)).mean() > 0.97


def test_quality_defined_results(spark):
    docs = frame(spark, hard_rows(), clash=True)
    model = nbsvm.fit([prose(i, 60) for i in range(30)] + [junk(900 + i) for i in range(30)], np.array([1] * 30 + [0] * 30))
    rows = nbsvm.score(docs, model).collect()
    assert len(rows) == len(hard_rows())
    by = {r["doc_id"]: r for r in rows}
    assert by[40]["score"] == by[41]["score"] == pytest.approx(model.bias)
    assert nbsvm.score(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        nbsvm.fit(["a"], np.array([1]))


@pytest.fixture(scope="module")
def toxic_model():
    texts = [prose(5000 + i, 80) for i in range(150)] + [insulted(i) for i in range(100)]
    return toxicity.fit(texts, np.array([0] * 150 + [1] * 100), landmarks=64)


def top(model, text):
    s = toxicity.stream(pa.array([text]))
    v = model.windows(s.code)[: len(s.code)]
    return v[s.code > 0].max()


def test_toxicity_on_held_out_documents(toxic_model):
    assert np.mean([top(toxic_model, insulted(2000 + i)) > 0 for i in range(60)]) >= 0.97
    assert np.mean([top(toxic_model, prose(8000 + i, 80)) > 0 for i in range(100)]) <= 0.02


def test_toxicity_with_gaps_and_insertions(toxic_model):
    forms = [str.upper, " ".join, ".".join, "-".join, lambda w: w[:3] + "*" + w[3:], lambda w: w[:4] + "x" + w[4:]]
    for form in forms:
        assert all(top(toxic_model, f"{prose(3, 20)} {form(w)} {prose(4, 20)}") > 0 for w in INSULTS), form


def test_table_equals_the_kernel(toxic_model):
    """Folding the landmarks into a table gives the kernel machine's own value."""
    rng = np.random.default_rng(2)
    marks, rows = rng.integers(1, 5, (6, toxicity.WINDOW)).astype(np.uint8), rng.integers(0, 5, (20, toxicity.WINDOW)).astype(np.uint8)
    beta = rng.normal(size=6)
    numbers, weights = toxicity._maps(marks)
    table = np.bincount(numbers.ravel(), (beta[:, None] * weights).ravel(), toxicity.SIZE)
    table[0] = 0
    model = toxicity.Model(table.astype(np.float32), 0.0)
    padded = [np.concatenate([r, np.zeros(toxicity.WINDOW, np.uint8)]) for r in rows]
    assert np.allclose([model.windows(p)[0] for p in padded], toxicity.kernel(rows, marks) @ beta, atol=1e-4)

    def brute(a, b):
        def maps(s):
            from itertools import combinations

            out = {}
            for i in combinations(range(len(s)), toxicity.K):
                if i[-1] - i[0] < toxicity.SPAN and all(s[j] for j in i):
                    key = tuple(s[j] for j in i)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (i[-1] - i[0] + 1 - toxicity.K)
            return out

        x, y = maps(a.tolist()), maps(b.tolist())
        return sum(v * y.get(k, 0) for k, v in x.items())

    assert np.allclose(toxicity.kernel(rows[:4], marks), [[brute(r, m) for m in marks] for r in rows[:4]])


def test_toxicity_defined_results(spark, toxic_model):
    docs = frame(spark, [*hard_rows(), (80, f"{prose(1, 30)}\nYou are a dimwit! {prose(2, 10)}", "en", "s", 1), (80, f"{prose(1, 30)}\nYou are a dimwit! {prose(2, 10)}", "en", "s", 1), (None, "such a blockhead", "en", "s", 1)], clash=True)
    rows = toxicity.toxic(docs, toxic_model).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 80, 80]
    assert next(r for r in rows if r["doc_id"] == 80)["sentence"] == "You are a dimwit!"
    assert toxicity.toxic(docs.limit(0), toxic_model).count() == 0
    with pytest.raises(ValueError):
        toxicity.fit(["a"], np.array([1]))


def test_sample_is_bounded_and_defined(spark):
    docs = frame(spark, [(i, f"text {i}", "en", "s", 1) for i in range(40)] + [(3, "zzz", "en", "s", 1), (None, "n", "en", "s", 1), (41, None, "en", "s", 1)])
    labels = spark.createDataFrame([(i, i % 2, 0, "own") for i in range(40)] + [(3, 0, 0, "own"), (41, 1, 1, "own"), (None, 1, 1, "own"), (5, None, None, "own"), (6, 7, 7, "own")], LABELS)
    texts, y = labelled(docs, labels, "quality", 5)
    assert len(texts) == 10 and y.sum() == 5
    texts, y = labelled(docs, labels, "quality", 1000)
    assert len(texts) == 40 and "zzz" in texts and "text 3" not in texts


def test_few_labels_are_no_error():
    """A handful of documents of each class, short insults, one document each, texts without letters."""
    for toxic, clean in ((["you git", "a git he is"], ["fine words here", "all good today"]), (["..."], ["good day to you all"]), (["xyz xyz"], ["xyz xyz"]), ([""], [""]), (["you are an absolute numbskull"] * 3, ["lovely weather for the time of year"])):
        model = toxicity.fit([*toxic, *clean], np.array([1] * len(toxic) + [0] * len(clean)))
        assert np.isfinite(model.table).all() and np.isfinite(model.bias)
        assert all(top(model, t) <= 0 for t in clean if t not in toxic)


def test_quality_model_is_that_of_plain_loops():
    texts = [prose(i, 30) for i in range(12)] + [junk(i) for i in range(12)]
    y = np.array([1] * 12 + [0] * 12)
    f, row = nbsvm.features(pa.array(texts))
    sets = [set(f[row == i].tolist()) for i in range(24)]
    size = 1 << nbsvm.BITS
    p, q = {}, {}
    for s, label in zip(sets, y, strict=True):
        for x in s:
            (p if label else q)[x] = (p if label else q).get(x, 0) + 1
    p_all, q_all = sum(p.values()) + nbsvm.ALPHA * size, sum(q.values()) + nbsvm.ALPHA * size
    ratio = {x: np.log((p.get(x, 0) + nbsvm.ALPHA) / p_all) - np.log((q.get(x, 0) + nbsvm.ALPHA) / q_all) for x in set().union(*sets)}
    names = {x: i for i, x in enumerate(sorted(ratio))}
    rows = [(np.array([*[names[x] for x in sorted(s)], len(names)]), np.array([*[ratio[x] / np.sqrt(len(s)) for x in sorted(s)], 1.0])) for s in sets]
    w = dual_descent(rows, np.where(y == 1, 1, -1), len(names) + 1, nbsvm.C)
    mean = sum(abs(w[i]) for i in names.values()) / len(names)
    weight = {x: ((1 - nbsvm.BETA) * mean + nbsvm.BETA * w[i]) * ratio[x] for x, i in names.items()}
    want = np.array([sum(weight[x] for x in s) / np.sqrt(len(s)) for s in sets])
    model = nbsvm.fit(texts, y)
    assert np.allclose(model.scores(pa.array(texts)) - model.bias, want) and ((want + model.bias >= 0) == (y == 1)).all()
