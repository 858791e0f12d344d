import numpy as np
import pyarrow as pa

from siftmill.llm import setjoin

from .data import edited, frame, hard_rows, prose


def brute(docs, threshold=setjoin.THRESHOLD):
    texts = {}
    for d, t, *_ in docs:
        if d is not None and t is not None:
            texts[d] = max(t, texts.get(d, t))
    ids = sorted(texts)
    g, row = setjoin.gram_sets(pa.array([texts[i] for i in ids]), setjoin.N)
    sets = {i: set(g[row == k].tolist()) for k, i in enumerate(ids)}
    out = {}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= threshold:
                out[a, b] = both / len(sets[a] | sets[b])
    return out


def classes(docs, links):
    """(class, number of links) of every document with a link."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    many = {}
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
        many[a], many[b] = many.get(a, 0) + 1, many.get(b, 0) + 1
    return {d: (find(d), n) for d, n in many.items()}


def linked(found):
    """The links of setjoin.pairs, copies expanded."""
    rows, copies = found
    lists = {}
    for r in copies.collect():
        lists.setdefault(r["rep"], [r["rep"]]).append(r["doc_id"])
    out = {(min(x, y), max(x, y)): r["jaccard"] for r in rows.collect() for x in lists.get(r["a"], [r["a"]]) for y in lists.get(r["b"], [r["b"]])}
    return out | {(min(x, y), max(x, y)): 1.0 for c in lists.values() for i, x in enumerate(c) for y in c[i + 1 :]}


def corpus():
    docs = hard_rows()
    for k in range(12):  # groups of edited copies
        base = prose(700 + k, 120)
        docs += [(1000 + 20 * k + j, edited(base, 0.02 * (j % 5), j), "en", "s", 1) for j in range(8)]
    shared = prose(999, 15, 50)
    docs += [(2000 + i, f"{shared} {prose(3000 + i, 60)}", "en", "s", 1) for i in range(40)]  # a common passage
    return docs


def test_recall_and_precision_against_brute_force(spark):
    docs = corpus()
    want = brute(docs)
    got = linked(setjoin.pairs(frame(spark, docs, clash=True)))
    assert not set(got) - set(want)
    assert len(set(got) & set(want)) >= 0.97 * len(want) and len(want) > 150
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_classes_and_links_are_those_of_brute_force(spark):
    docs = corpus() + [(5000 + i, prose(8000, 90), "en", "s", 1) for i in range(30)] + [(5100, edited(prose(8000, 90), 0.03, 1), "en", "s", 1)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in setjoin.joined(frame(spark, docs, clash=True)).collect()}
    want = classes(docs, brute(docs))
    assert got[5100] == (5000, 30) and got[5007] == (5000, 30)
    assert {d: c for d, (c, _) in got.items()} == {d: c for d, (c, _) in want.items()}
    assert sum(n for _, n in got.values()) >= 0.97 * sum(n for _, n in want.values()) and all(n <= want[d][1] for d, (_, n) in got.items())


def test_a_large_group_of_alike_sets_goes_to_blocks_whole(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "LIMIT", 20)
    base = prose(77, 200)
    docs = [(i, edited(base, 0.02, i), "en", "s", 1) for i in range(150)]
    want = brute(docs)
    assert len(want) > 9000
    got = linked(setjoin.pairs(frame(spark, docs)))
    assert not set(got) - set(want) and len(got) >= 0.98 * len(want)


def test_links_of_a_large_group_are_counted_not_listed(spark, monkeypatch):
    """n alike sets make about n * n / 2 links; no step may hold a row for each."""
    monkeypatch.setattr(setjoin, "UNIT", 40)
    monkeypatch.setattr(setjoin, "LIMIT", 20)
    base = prose(78, 200)
    docs = [(i, edited(base, 0.02, i), "en", "s", 1) for i in range(200)] + [(300 + i, edited(base, 0.02, 5), "en", "s", 1) for i in range(3)]
    links = brute(docs)
    assert len(links) > 15000
    most, cut = [0], setjoin.cut

    def counted(df):
        out = cut(df)
        if "path" not in out.columns:  # buckets are dealt to blocks
            most.append(out.count())
        return out

    monkeypatch.setattr(setjoin, "cut", counted)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in setjoin.joined(frame(spark, docs)).collect()}
    want = classes(docs, links)
    assert max(most) < 20 * len(docs)
    assert {d: c for d, (c, _) in got.items()} == {d: c for d, (c, _) in want.items()}
    assert all(n <= want[d][1] for d, (_, n) in got.items()) and sum(n for _, n in got.values()) >= 0.98 * sum(n for _, n in want.values())


def test_common_grams_and_filters_against_sets(monkeypatch):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 300, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool, size, replace=False)) for size in rng.integers(1, 200, 60).tolist()]
    folded = [np.unique((g >> np.uint64(32)).astype(np.uint32)) for g in sets]
    both = np.array([[len(np.intersect1d(x, y)) for x in folded] for y in folded])
    for dense in (1, 16, 1000):
        monkeypatch.setattr(setjoin, "DENSE", dense)
        assert (setjoin._common(folded[:25], folded) == both[:, :25]).all()
    size = np.array([len(g) for g in sets])
    row = np.repeat(np.arange(60), size)
    bits = setjoin._bitmap(np.concatenate(sets), row, 60).view(np.uint64)
    a, b = np.triu_indices(60, 1)
    jaccard = both[a, b] / (size[a] + size[b] - both[a, b])
    may = setjoin._may(a, b, bits, size, 0.3)
    assert set(np.flatnonzero(jaccard >= 0.3)) <= set(may.tolist()) and len(may) < len(a)


def test_sets_of_a_key_are_compared_once_in_pieces(monkeypatch):
    monkeypatch.setattr(setjoin, "UNIT", 3)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, 25)).astype(np.uint32) for _ in range(30)]
    own = np.arange(30) < 20
    ids, weight = np.arange(30), np.arange(30) % 3 + 1
    other = np.where(own, 7, 7 + (np.arange(30) > 24))
    batch = pa.record_batch(
        [pa.array(np.zeros(30, np.int64)), pa.array(own), pa.array(ids), pa.array(np.where(own, 7, other)), pa.array(np.full(30, 7)), pa.array(weight), pa.array(np.ones(30, np.int64)), pa.array([g.tobytes() for g in sets], pa.binary())],
        ["key", "own", "doc_id", "group", "other", "weight", "runs", "grams"],
    )
    want = {(i, j) for j in range(30) for i in range(min(j, 20)) if len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j]))}
    listed = pa.Table.from_batches(setjoin._exact(iter([batch]), 0.4, True)).to_pylist()
    got = [(r["a"], r["b"]) for r in listed if r["kind"] == setjoin.PAIR]
    assert len(got) == len(set(got)) and set(got) == want and want
    counted = pa.Table.from_batches(setjoin._exact(iter([batch]), 0.4, False)).to_pylist()
    links = np.zeros(30, int)
    for r in counted:
        if r["kind"] == setjoin.LINKS:
            links[r["a"]] += r["n"]
    assert links.tolist() == [sum(weight[j if i == d else i] for i, j in want if d in (i, j)) for d in range(30)]
    assert sum(r["n"] for r in counted if r["kind"] == setjoin.MET) == sum(j > 24 for _, j in want)
    edges = {(r["a"], r["b"]) for r in counted if r["kind"] == setjoin.EDGE}
    assert {d: c for d, (c, _) in classes([], edges).items()} == {d: c for d, (c, _) in classes([], want).items()}


def test_recall_on_short_documents(spark):
    """Pairs of few grams, a third of them or fewer changed at one end."""
    docs = []
    for k in range(600):
        size = 4 + k % 20
        words = [f"w{k}x{i}" for i in range(size + 2)]
        cut = max(1, size // 3)
        docs += [(2 * k, " ".join(words), "en", "s", 1), (2 * k + 1, " ".join([*words[:-cut], *(f"v{k}x{i}" for i in range(cut))]), "en", "s", 1)]
    want = brute(docs)
    got = linked(setjoin.pairs(frame(spark, docs)))
    assert len(want) == 600 and not set(got) - set(want) and len(got) >= 0.97 * len(want)


def test_sketches_drop_no_pair_at_the_threshold():
    rng = np.random.default_rng(7)
    for size in (3, 6, 9, 15, 30, 60, 120, 240, 480, 960):
        count = 400
        own = size // 4
        whole = rng.integers(0, 2**64, (count, size + own), dtype=np.uint64)
        g = np.sort(np.concatenate([whole[:, :size], whole[:, own:]]), axis=1)
        sketch = setjoin._sketch(g.ravel(), np.repeat(np.arange(2 * count), size), 2 * count)
        a = np.arange(count)
        assert len(setjoin._near(a, a + count, sketch, np.full(2 * count, size), (size - own) / (size + own))) == count


def test_large_buckets_are_split_and_still_complete(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "LIMIT", 4)
    docs = corpus()
    want = brute(docs)
    got = linked(setjoin.pairs(frame(spark, docs)))
    assert not set(got) - set(want) and len(set(got) & set(want)) >= 0.97 * len(want)


def test_every_large_bucket_is_split_somewhere():
    paths = np.arange(64, 64 * 501, 64)
    batch = pa.record_batch([pa.array(paths), pa.array(paths), pa.array(np.full(500, 9, np.int32)), pa.array([bytes(setjoin.BINS)] * 500, pa.binary())], ["path", "doc_id", "size", "sketch"])
    for level in range(setjoin.DEPTH):
        out = pa.Table.from_batches(setjoin._split(iter([batch]), 0.5, level))
        assert set(out.column("doc_id").to_pylist()) == set(paths.tolist())


def test_estimate_of_the_recall(spark):
    rows = [(i, i + 1, 0.5, 31 if i % 10 else 1 << i % 5) for i in range(5000)]
    assert setjoin._estimate(spark.createDataFrame(rows, "a long, b long, jaccard double, runs long")) < 0.1
    assert setjoin._estimate(spark.createDataFrame([r for r in rows if r[3] == 31], "a long, b long, jaccard double, runs long")) == 1
    assert setjoin._each(0.98) == 5


def test_sketches_estimate_jaccard():
    base = prose(1, 400)
    g, row = setjoin.gram_sets(pa.array([base, edited(base, 0.1, 2), prose(2, 400)]), 3)
    s = setjoin._sketch(g, row, 3)
    true = len(set(g[row == 0].tolist()) & set(g[row == 1].tolist())) / len(set(g[row < 2].tolist()))
    assert abs((s[0] == s[1]).mean() - true) < 0.15 and (s[0] == s[2]).mean() < 0.1
    assert setjoin._sketch(np.array([5], np.uint64), np.array([0]), 1).shape == (1, setjoin.BINS)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (10, 9), (9, 11), (20, 21)], "a long, b long")
    assert {r["v"]: r["root"] for r in setjoin.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9, 10: 9, 11: 9, 20: 20, 21: 20}


def test_one_of_each(spark):
    docs = frame(spark, corpus(), clash=True)
    out = setjoin.one_of_each(docs)
    kept = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns
    assert 20 in kept and not {21, 22} & set(kept) and kept.count(30) == 1 and kept.count(None) == 2
    assert {40, 41, 42, 43, 44, 50} <= set(kept) and {2000 + i for i in range(40)} <= set(kept)
    assert sum(1000 <= (d or 0) < 1240 for d in kept) == 12
    assert setjoin.one_of_each(docs.limit(0)).count() == 0 and setjoin.joined(docs.limit(0)).count() == 0
