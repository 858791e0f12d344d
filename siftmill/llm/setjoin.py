"""N-gram Jaccard self-join by chosen paths.

A document is the set of its word n-grams. In each run every set samples few of its own
grams (each with probability 1 / (threshold * size), by a hash that all sets share), and
sets that chose the same gram meet in a bucket. Two sets of Jaccard J >= threshold meet
with probability 1 - exp(-J / threshold) or more in each run. Buckets of up to ``LIMIT``
sets are compared by brute force. Larger ones are split again, up to ``DEPTH`` times, on
sampled shared grams: of the sets' sketches (the least gram of each of ``BINS`` ranges of
hashes, which two sets share with probability J) each set takes ``RATE`` / threshold, so
that a pair at the threshold shares ``RATE`` of them and is lost by a split with
probability exp(-RATE). A large bucket whose sets are alike (two of them share a
sketched gram with probability ``ALIKE`` or more) can't be split to any purpose: its sets
are dealt to blocks of ``LIMIT / 2``, and every two blocks are a bucket of their own, so
that all pairs are compared and no task holds more than one such bucket.

Sets that are alike are put in groups first: each set has the least gram of each of ``MARKS``
ranges of hashes, the lowest doc_id that has a mark leads it, and a set joins the leader
of at least ``AGREE`` of its marks. Groups are only a way to compare many sets at once: what
the buckets find are pairs of groups (most sets are alone in theirs), each pair once however many
of their sets meet, and all sets of the two are compared, as are all within a group. So a
link is counted once, and n alike sets, which have n * n / 2 links, yield n rows of counts
and n edges for the classes.

Comparison is in two steps. Two filters drop pairs in the buckets: bitmaps of ``BITS`` bits, which bound
the grams in common from above and lose nothing, and sketches, for pairs that are far below the threshold
(estimates more than ``SIGMAS`` standard deviations below it, which depend on how many
grams fill the bins; pairs of about 30 grams or fewer are never dropped by them). The exact
Jaccard of the sets decides about the others, of up to about ``UNIT`` sets of a group at once: grams
that many sets have are counted by a product of matrices, the others one by one. A round has as many runs as a pair at the
threshold needs for the target recall if all its buckets are split ``DEPTH`` times. Rounds
are repeated until the recall, estimated from how many runs found each linked pair of groups (Chao's
estimate of those never found; a set with a link in its own group counts as one more pair found, however many
links it has there), reaches the target.
Where ``2 ** RUN_BITS`` runs don't reach it, that is an error.

Documents with one and the same set are collapsed before the join, so a group of
thousands of copies costs what one document costs.

Defined results: a document of fewer than n words has one gram, all its words; one
without words (null, empty, punctuation only) has no set and no partners. Rows that
share a doc_id are one document, with the text that sorts last;
rows with a null doc_id are left out, as they can't be reported (``one_of_each``
keeps them). Texts of any length are taken whole. An empty table gives an empty result.
Other columns are ignored. Ties do not arise: every pair at or above the threshold
counts. The exact step compares grams by 32 bits of their hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import chunks, cut, documents, known, runs_of

N, THRESHOLD, RECALL = 3, 0.5, 0.98
BINS, LIMIT, DEPTH, SIGMAS = 64, 1000, 3, 5.0
#: Shared grams that a pair at the threshold has at a split; likeness from which a bucket is not split.
RATE, ALIKE = 2.0, 0.25
#: Large buckets of which the list may be broadcast; more are joined by shuffling.
BROADCAST_PATHS = 50_000
#: Bits of the bitmap of a set.
BITS = 512
#: Ranges of hashes that give a mark each; share of its marks that a set has in common with the leader of its group.
MARKS, AGREE = 8, 0.375
#: Sets of a group that are compared at once; sets in which a gram must be for the product of matrices.
UNIT, DENSE = 1000, 16
#: Runs are told apart by the lowest bits of a path.
RUN_BITS = 6


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, row) of a batch: the distinct grams of each row, in order."""
    w = textkit.words(column)
    g, ok = textkit.grams(w, n)
    counts = np.diff(w.first)
    row = np.repeat(np.arange(len(counts)), counts)
    short = np.flatnonzero((counts > 0) & (counts < n))
    for i in short.tolist():
        lo, hi = w.first[i], w.first[i + 1]
        g[lo] = textkit.mix(np.array([np.bitwise_xor.reduce(w.hash[lo:hi] * np.arange(1, 2 * (hi - lo), 2, dtype=np.uint64))]))[0]
        ok[lo] = True
    g, row = g[ok], row[ok]
    edge = np.searchsorted(row, np.arange(len(counts) + 1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        g[a:b].sort()
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[new], row[new]


def _seed(run: int) -> np.uint64:
    return textkit.mix(np.array([run + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]


def _limits(share: np.ndarray) -> np.ndarray:
    """Hashes below the limit are a ``share`` of all."""
    return (np.minimum(share, 1.0) * (2**64 - 2048)).astype(np.uint64)


def _sketch(g: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """One byte for each of BINS ranges of the grams' hashes: of its least; empty ones borrow from the next."""
    bins = (g >> np.uint64(64 - int(math.log2(BINS)))).astype(np.int64)
    slot = row * BINS + bins
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    value = np.full(rows * BINS, -1, np.int64)
    value[slot[first]] = (textkit.mix(g[first] ^ np.uint64(0x51ED270B)) & np.uint64(255)).astype(np.int64)
    value = value.reshape(rows, BINS)
    wide = np.concatenate([value, value], axis=1)
    ahead = np.where(wide >= 0, np.arange(2 * BINS), 2 * BINS)
    ahead = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    far = ahead - np.arange(BINS)
    got = np.take_along_axis(np.concatenate([wide, np.zeros((rows, 1), np.int64)], axis=1), ahead, axis=1)
    return ((got + far * 37) & 255).astype(np.uint8)


def _bitmap(g: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """BITS bits for each row, of which every gram sets one."""
    out = np.zeros(rows * BITS, bool)
    out[row * BITS + (textkit.mix(g + np.uint64(0x2545F491)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(out).reshape(rows, BITS // 8)


def _marks(g: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """The least gram of each of MARKS ranges of the grams' hashes; nothing for empty ranges."""
    slot = row * MARKS + (g >> np.uint64(64 - int(math.log2(MARKS)))).astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    ends = np.searchsorted(row[first], np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(g[first].view(np.int64)))


def _fixed(values: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary array."""
    rows, width = values.shape
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.arange(rows + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _signed(batches: Iterator[pa.RecordBatch], n: int, threshold: float, runs: range) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        g, row = gram_sets(batch.column("text"), n)
        size = np.bincount(row, minlength=batch.num_rows)
        have = np.flatnonzero(size)
        if not len(have):
            continue
        size, row = size[have], (np.cumsum(size > 0) - 1)[row]
        limit = _limits(1 / (threshold * size))[row]
        paths, owners = [], []
        for run in runs:
            mixed = textkit.mix(g ^ _seed(run))
            chosen = np.flatnonzero(mixed < limit)
            paths.append(textkit.mix(g[chosen] + _seed(run)) >> np.uint64(RUN_BITS) << np.uint64(RUN_BITS) | np.uint64(run % (1 << RUN_BITS)))
            owners.append(row[chosen])
        path, owner = np.concatenate(paths), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(len(have) + 1))
        sign = np.add.reduceat(textkit.mix(g * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)), np.searchsorted(row, np.arange(len(have))))
        sketch = _sketch(g, row, len(have))
        yield pa.record_batch(
            [
                batch.column("doc_id").take(pa.array(have)),
                pa.array((sign ^ size.astype(np.uint64)).view(np.int64)),
                pa.array(size.astype(np.int32)),
                _fixed(sketch),
                _fixed(_bitmap(g, row, len(have))),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(path[order].view(np.int64))),
                _marks(g, row, len(have)),
            ],
            ["doc_id", "sign", "size", "sketch", "bits", "paths", "marks"],
        )


def _sketches(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)


def _split(batches: Iterator[pa.RecordBatch], threshold: float, level: int) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets to the buckets of the sketch elements that they choose."""
    salt = _seed(1000 + level)
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        path = table.column("path").to_numpy().view(np.uint64)
        place = textkit.mix((path ^ salt)[:, None] + np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        # a bucket whose every position is left out takes its least
        chosen = (place < _limits(np.array([RATE / (threshold * BINS)]))[0]) | (place == place.min(axis=1, keepdims=True))
        r, i = np.nonzero(chosen)
        value = _sketches(table)[r, i].astype(np.uint64)
        low = np.uint64((1 << RUN_BITS) - 1)
        child = textkit.mix(place[r, i] ^ (value + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) & ~low | path[r] & low
        out = table.take(pa.array(r)).set_column(0, "path", pa.array(child.view(np.int64)))
        yield from out.to_batches()


def _near(a: np.ndarray, b: np.ndarray, sketch: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (a, b) may reach the threshold."""
    small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    keep = np.flatnonzero(small >= threshold * large)
    a, b = a[keep], b[keep]
    out = np.zeros(len(keep), bool)
    # few grams leave bins empty, which borrow: then the grams count, not the bins
    least = threshold - SIGMAS * np.sqrt(threshold * (1 - threshold) * (1 / (large[keep] + 1) + 1 / BINS))
    least = np.where(least > 0, BINS * (least + (1 - least) / 256), 0)
    for i in range(0, len(keep), 1 << 15):
        j = slice(i, i + (1 << 15))
        out[j] = np.count_nonzero(sketch[a[j]] == sketch[b[j]], axis=1) >= least[j]
    return keep[out]


def _may(a: np.ndarray, b: np.ndarray, bits: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (a, b) may reach the threshold: grams in common are at most the bits in common and the grams that share their bit."""
    out = np.zeros(len(a), bool)
    double = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    for i in range(0, len(a), 1 << 15):
        x, y = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
        both = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64) + np.minimum(double[x], double[y])
        out[i : i + (1 << 15)] = both >= threshold * (size[x].astype(np.int64) + size[y] - both)
    return np.flatnonzero(out)


def _candidates(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, runs): pairs of groups, of which some sets meet in a bucket and pass the filters; buckets are whole and together.

    Rows of side 1 are compared with those of side 2 only, rows of side 0 with one another.
    """
    for table in runs_of(batches, "path"):
        path, group, members, size, side = (table.column(c).to_numpy() for c in ("path", "group", "members", "size", "side"))
        new = np.ones(len(path), bool)
        new[1:] = path[1:] != path[:-1]
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(path)))
        if many.max() < 2:
            continue
        sketch = _sketches(table)
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def compare(a: np.ndarray, b: np.ndarray) -> None:
            other = np.flatnonzero((group[a] != group[b]) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])))
            a, b = a[other], b[other]
            keep = _may(a, b, bits, size, threshold)
            a, b = a[keep], b[keep]
            keep = _near(a, b, sketch, size, threshold)
            if len(keep):
                out.append((a[keep], b[keep]))

        sided = side[first] > 0
        for m in np.unique(many[(many > 1) & ~sided]).tolist():
            starts = first[(many == m) & ~sided]
            if m <= 128:
                i, j = np.triu_indices(m, 1)
                for k in range(0, len(starts), max(1, (1 << 20) // len(i))):
                    s = starts[k : k + max(1, (1 << 20) // len(i)), None]
                    compare((s + i).ravel(), (s + j).ravel())
            else:  # one block of rows against all later ones
                for s in starts.tolist():
                    for k in range(0, m, 256):
                        i = np.arange(k, min(k + 256, m))
                        a, b = np.repeat(i, m - k), np.tile(np.arange(k, m), len(i))
                        later = a < b
                        compare(s + a[later], s + b[later])
        for s, m in zip(first[sided].tolist(), many[sided].tolist(), strict=True):
            one, two = s + np.flatnonzero(side[s : s + m] == 1), s + np.flatnonzero(side[s : s + m] == 2)
            for k in range(0, len(one) if len(two) else 0, 256):
                compare(np.repeat(one[k : k + 256], len(two)), np.tile(two, len(one[k : k + 256])))
        if out:
            a, b = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
            a, b = np.where(group[a] < group[b], a, b), np.where(group[a] < group[b], b, a)
            run = path[a] & ((1 << RUN_BITS) - 1)
            order = np.lexsort((run, group[b], group[a]))
            a, b, run = a[order], b[order], run[order]
            own = np.ones(len(a), bool)
            own[1:] = (group[a[1:]] != group[a[:-1]]) | (group[b[1:]] != group[b[:-1]]) | (run[1:] != run[:-1])
            a, b, run = a[own], b[own], run[own]
            bit = (np.uint64(1) << run.astype(np.uint64)).view(np.int64)
            yield pa.record_batch([pa.array(group[a]), pa.array(group[b]), pa.array(members[a]), pa.array(members[b]), pa.array(bit)], ["a", "b", "na", "nb", "runs"])


def _common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many grams each set of ``two`` (rows) has in common with each of ``one`` (columns)."""
    value, x = np.concatenate(one), np.repeat(np.arange(len(one)), [len(g) for g in one])
    word, y = np.concatenate(two), np.repeat(np.arange(len(two)), [len(g) for g in two])
    order = np.argsort(value, kind="stable")
    value, x = value[order], x[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(value)))
    at = np.minimum(np.searchsorted(value[first], word), len(first) - 1)
    hit = value[first][at] == word
    at, y = at[hit], y[hit]
    out = np.zeros(len(one) * len(two), np.int64)
    dense = many >= DENSE
    rare = ~dense[at]
    for i in range(0, int(rare.sum()), 1 << 17):
        g, r = at[rare][i : i + (1 << 17)], y[rare][i : i + (1 << 17)]
        each = many[g]
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        out += np.bincount(np.repeat(r, each) * len(one) + x[np.repeat(first[g], each) + k], minlength=len(out))
    out = out.reshape(len(two), len(one))
    column = np.cumsum(dense) - 1
    held, of = dense[np.cumsum(new) - 1], column[np.cumsum(new) - 1]
    for i in range(0, int(dense.sum()), 2048):
        left, right = np.zeros((len(one), 2048), np.float32), np.zeros((len(two), 2048), np.float32)
        k = np.flatnonzero(held & (of >= i) & (of < i + 2048))
        left[x[k], of[k] - i] = 1
        k = np.flatnonzero(dense[at] & (column[at] >= i) & (column[at] < i + 2048))
        right[y[k], column[at[k]] - i] = 1
        out += (right @ left.T).astype(np.int64)
    return out


def _joined_up(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least label of each row's and each column's component; columns are labelled first, then rows."""
    two, one = linked.shape
    rows, columns, none = np.arange(one, one + two), np.arange(one), one + two
    while True:
        rows = np.minimum(rows, np.where(linked, columns, none).min(axis=1))
        lower = np.minimum(columns, np.where(linked, rows[:, None], none).min(axis=0))
        if (lower == columns).all():
            return rows, columns
        columns = lower


PAIR, LINKS, EDGE, MET, SURE = range(5)
COMPARED = "kind int, a long, b long, jaccard double, n long, runs long"


def _exact(batches: Iterator[pa.RecordBatch], threshold: float, listed: bool) -> Iterator[pa.RecordBatch]:
    """Compares the sets of each key's unit of a group (rows without ``other``) with one another and with the other rows.

    Rows of kind MET: the groups a and b have n links. Of kind SURE: n sets of the group a are linked there. Of kind PAIR, if ``listed``: the sets a and b are linked. If not,
    of kind LINKS: a has n links (documents) here, and EDGE: enough pairs for the classes.
    """
    for table in runs_of(batches, "key", 5000):
        key, doc, group, other, weight, mask = (table.column(c).to_numpy() for c in ("key", "doc_id", "group", "other", "weight", "runs"))
        own = table.column("own").to_numpy()
        grams = [np.frombuffer(raw, np.uint32) for raw in table.column("grams").to_pylist()]
        size = np.array([len(g) for g in grams])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        kinds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def tell(kind: int, a: np.ndarray, b: np.ndarray | None = None, jaccard: np.ndarray | None = None, n: np.ndarray | None = None, runs: np.ndarray | None = None) -> None:
            zero = np.zeros(len(a), np.int64)
            kinds.append((kind, a, zero if b is None else b, zero.astype(float) if jaccard is None else jaccard, zero if n is None else n, zero if runs is None else runs))

        def compare(one: np.ndarray, two: np.ndarray, inner: bool) -> None:
            both = _common([grams[i] for i in one], [grams[i] for i in two])
            value = both / (size[two][:, None] + size[one] - both)
            linked = value >= threshold
            if inner:
                linked = np.tril(linked, -1)
            if not linked.any():
                return
            if inner:
                tell(SURE, group[one[:1]], n=linked.any(axis=1).sum(keepdims=True))
            if listed:
                y, x = np.nonzero(linked)
                p, q = doc[one[x]], doc[two[y]]
                tell(PAIR, np.minimum(p, q), np.maximum(p, q), value[y, x])
            else:
                for ids, links in ((two, linked @ weight[one]), (one, weight[two] @ linked)):
                    tell(LINKS, doc[ids[links > 0]], n=links[links > 0])
                if inner:
                    linked = linked | linked.T
                rows, columns = _joined_up(linked)
                every = np.concatenate([one, two])
                root = every[np.concatenate([columns, rows])]
                apart = doc[every] != doc[root]
                tell(EDGE, doc[root[apart]], doc[every[apart]])
            links = linked.sum(axis=1)
            cross = (links > 0) & (other[two] != group[two]) if not inner else np.zeros(len(two), bool)
            if cross.any():
                of = two[cross]
                tell(MET, np.minimum(group[of], other[of]), np.maximum(group[of], other[of]), n=links[cross], runs=mask[of])

        for s, e in zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
            one, two = s + np.flatnonzero(own[s:e]), s + np.flatnonzero(~own[s:e])
            for i in range(0, len(one), 2 * UNIT):
                left = one[i : i + 2 * UNIT]
                if len(left) > 1:
                    compare(left, left, True)
                for j in range(i + 2 * UNIT, len(one), UNIT):
                    compare(left, one[j : j + UNIT], False)
                for j in range(0, len(two), UNIT):
                    compare(left, two[j : j + UNIT], False)
        if kinds:
            kind = np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in kinds])
            yield pa.record_batch([pa.array(kind), *(pa.array(np.concatenate([x[i] for x in kinds])) for i in range(1, 6))], ["kind", "a", "b", "jaccard", "n", "runs"])


def _with_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row for each place of a document, with its grams."""
    for batch in chunks(batches):
        g, row = gram_sets(batch.column("text"), n)
        edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
        folded = (g >> np.uint64(32)).astype(np.uint32)
        places = batch.column("places")
        each = np.diff(places.offsets.to_numpy())
        flat, end = places.flatten(), np.cumsum(each)
        raw = [np.unique(folded[edge[i] : edge[i + 1]]).tobytes() for i in range(batch.num_rows)]
        i = 0
        while i < batch.num_rows:  # about 16 MB at a time
            j, held = i, 0
            while j < batch.num_rows and (j == i or held < 1 << 24):
                held += int(each[j]) * len(raw[j])
                j += 1
            of = np.repeat(np.arange(i, j), each[i:j])
            part = flat.slice(int(end[i] - each[i]), len(of))
            yield pa.record_batch(
                [part.field("key"), part.field("own"), batch.column("doc_id").take(pa.array(of)), part.field("group"), part.field("other"), batch.column("weight").take(pa.array(of)), part.field("runs"), pa.array([raw[k] for k in of.tolist()], pa.binary())],
                ["key", "own", "doc_id", "group", "other", "weight", "runs", "grams"],
            )
            i = j


#: What the rows of buckets have besides their path.
ROW = ("doc_id", "group", "members", "size", "sketch", "bits")


def _large(rows: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(rows of small buckets, those of large ones with n, the sets there, and ``alike``); None if all are small."""
    counts = cut(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIMIT))
    many = counts.count()
    if not many:
        return None
    join = F.broadcast if many <= BROADCAST_PATHS else lambda x: x
    small = rows.join(join(counts.select("path")), "path", "left_anti")
    # how often two sets of a bucket share the gram at one place of the sketch, another place for each bucket
    place = F.substring("sketch", F.pmod(F.shiftright("path", RUN_BITS), F.lit(BINS)).cast("int") + 1, F.lit(1))
    large = rows.join(join(counts), "path")
    shared = large.groupBy("path", place.alias("v")).agg(F.count(F.lit(1)).alias("c")).groupBy("path").agg((F.sum(F.col("c") * F.col("c")) / F.pow(F.sum("c"), F.lit(2))).alias("share"))
    alike = cut(shared.where(F.col("share") >= ALIKE).select("path", F.lit(True).alias("alike")))
    return small, large.join(join(alike), "path", "left").withColumn("alike", F.coalesce("alike", F.lit(False)))


def _blocks(large: DataFrame) -> DataFrame:
    """Rows of large buckets to one bucket for every two blocks of ``LIMIT / 2`` sets: sides 1 and 2; within a block: side 0."""
    keep = F.lit((1 << RUN_BITS) - 1)
    size = F.ceil(F.col("n") / F.lit(max(LIMIT // 2, 1)))
    dealt = large.withColumn("own", F.pmod(F.xxhash64("doc_id", "path"), size)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)))
    path = F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return dealt.select(path.bitwiseAND(F.bitwise_not(keep.cast("long"))).bitwiseOR(F.col("path").bitwiseAND(keep.cast("long"))).alias("path"), *ROW, side.alias("side"))


def _buckets(sets: DataFrame, threshold: float) -> DataFrame:
    """(path, *ROW, side): the rows of all final buckets, none of which has more than about ``LIMIT`` sets."""
    rows = sets.select(F.explode("paths").alias("path"), *ROW)
    done = []
    for level in range(DEPTH + 1):
        found = _large(rows)
        if found is None:
            done.append(rows.withColumn("side", F.lit(0)))
            break
        small, large = found
        done.append(small.withColumn("side", F.lit(0)))
        if level == DEPTH:
            done.append(_blocks(large))
            break
        done.append(_blocks(large.where("alike")))
        split = large.where("NOT alike").select("path", *ROW)
        rows = cut(split.mapInArrow(lambda it, level=level: _split(it, threshold, level), "path long, doc_id long, group long, members long, size int, sketch binary, bits binary"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _members(sets: DataFrame) -> DataFrame:
    """(doc_id, group, members, weight) of every set; weight: of how many documents it is, members: how many sets the group has."""
    marks = sets.select("doc_id", F.explode("marks").alias("mark"), F.size("marks").alias("k"))
    leads = marks.groupBy("mark").agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("c")).where("c > 1").select("mark", "leader")
    votes = marks.join(leads, "mark").groupBy("doc_id", "leader").agg(F.count(F.lit(1)).alias("c"), F.first("k").alias("k")).where((F.col("c") > 1) & (F.col("c") >= AGREE * F.col("k")))
    chosen = votes.groupBy("doc_id").agg((-F.max(F.struct("c", (-F.col("leader")).alias("m"))).getField("m")).alias("leader"))
    grouped = cut(sets.select("doc_id", "weight").join(chosen, "doc_id", "left").select("doc_id", F.coalesce("leader", "doc_id").alias("group"), "weight"))
    many = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return cut(grouped.join(many, "group", "left").select("doc_id", "group", F.coalesce("members", F.lit(1).cast("long")).alias("members"), "weight"))


def _places(members: DataFrame, met: DataFrame, within: bool) -> DataFrame:
    """(doc_id, weight, places): where each set is compared: with its unit, if its group is the larger of a pair, and with the others' units.

    A group of more than ``UNIT`` sets is dealt to units; ``within``: the sets of one group are compared, too.
    """
    units = lambda n: F.ceil(n / F.lit(UNIT))
    key = lambda group, unit: F.xxhash64(group, unit.cast("long"))
    none = F.lit(0).cast("long")
    row = ["doc_id", "weight"]
    of = members.withColumn("unit", F.pmod(F.xxhash64("doc_id"), units(F.col("members"))))
    first = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = met.select(*(F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a", "b", "owner"), ("b", "a", "group"), ("na", "nb", "n"))), "runs")
    owners = pairs.select(F.col("owner").alias("group")).distinct()
    hosts = of.join(owners, "group", "left_semi")
    if within:
        hosts = of.where("members > 1").unionByName(hosts.where("members = 1"))
    place = lambda key, own, group, other, runs: F.struct(key.alias("key"), F.lit(own).alias("own"), group.alias("group"), other.alias("other"), runs.alias("runs")).alias("place")
    out = hosts.select(*row, place(key(F.col("group"), F.col("unit")), True, F.col("group"), F.col("group"), none))
    guests = members.select(*row, "group").join(pairs, "group").withColumn("at", F.explode(F.sequence(none, units(F.col("n")) - 1)))
    out = out.unionByName(guests.select(*row, place(key(F.col("owner"), F.col("at")), False, F.col("group"), F.col("owner"), F.col("runs"))))
    if within:  # of two units, the one goes to the other that is lower if their sum is even
        apart = of.where(units(F.col("members")) > 1).withColumn("at", F.explode(F.sequence(none, units(F.col("members")) - 1))).where("at <> unit AND (at < unit) = ((at + unit) % 2 = 0)")
        out = out.unionByName(apart.select(*row, place(key(F.col("group"), F.col("at")), False, F.col("group"), F.col("group"), none)))
    return out.groupBy("doc_id").agg(F.first("weight").alias("weight"), F.collect_list("place").alias("places"))


def _run(docs: DataFrame, n: int, threshold: float, runs: range, before: tuple[DataFrame, DataFrame] | None, listed: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(what is found by these runs, pairs of groups that have links with the runs that found them, members, (doc_id, rep) of the first pass).

    before: members and such pairs of earlier runs, which aren't compared again.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = cut(docs.mapInArrow(lambda it: _signed(it, n, threshold, runs), "doc_id long, sign long, size int, sketch binary, bits binary, paths array<long>, marks array<long>"))
    sets = signed.groupBy("sign", "size").agg(F.min(F.struct("doc_id", "sketch", "bits", "paths", "marks")).alias("x"), F.count(F.lit(1)).alias("weight")).select("sign", "size", "weight", "x.*")
    sets = cut(sets)
    copies = signed.select("sign", "size", "doc_id").join(sets.where("weight > 1").select("sign", "size", F.col("doc_id").alias("rep")), ["sign", "size"]).select("rep", "doc_id").where("rep <> doc_id") if before is None else None
    members = _members(sets) if before is None else before[0]
    rows = sets.select("doc_id", "size", "sketch", "bits", "paths").join(members.select("doc_id", "group", "members"), "doc_id")
    found = _buckets(cut(rows), threshold).repartition(parts, "path").sortWithinPartitions("path").mapInArrow(lambda it: _candidates(it, threshold), "a long, b long, na long, nb long, runs long")
    met = cut(found.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.bit_or("runs").alias("runs")))
    fresh = met if before is None else met.join(before[1], ["a", "b"], "left_anti")
    placed = docs.join(_places(members, fresh, before is None), "doc_id").select("doc_id", "text", "weight", "places").mapInArrow(lambda it: _with_sets(it, n), "key long, own boolean, doc_id long, group long, other long, weight long, runs long, grams binary")
    exact = cut(placed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda it: _exact(it, threshold, listed), COMPARED))
    hits = exact.where(F.col("kind") == MET).groupBy("a", "b").agg(F.bit_or("runs").alias("runs"))
    if before is not None:
        hits = hits.unionByName(before[1].unionByName(met.join(before[1], ["a", "b"], "left_semi").select("a", "b", "runs")).groupBy("a", "b").agg(F.bit_or("runs").alias("runs")))
    return exact, cut(hits), members, copies


def _estimate(pairs: DataFrame, sure: int = 0) -> float:
    """Share of the pairs (of groups) that is found, by how often the runs found each; ``sure`` more are found without runs."""
    counts = {r["k"]: r["n"] for r in pairs.groupBy(F.bit_count("runs").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    seen, once, twice = sum(counts.values()) + sure, counts.get(1, 0), counts.get(2, 0)
    return seen / (seen + once * (once - 1) / (2 * (twice + 1))) if seen else 1.0


def _each(recall: float) -> int:
    """Runs that find a pair at the threshold with the recall, if every bucket on its way is split ``DEPTH`` times."""
    meet = 1.0
    for rate in [RATE] * DEPTH + [1.0]:
        meet = 1 - math.exp(-rate * meet)
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _repeated(docs: DataFrame) -> bool:
    return not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def _one_text(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_id").agg(F.max("text").alias("text")) if _repeated(docs) else docs


def _all(docs: DataFrame, listed: bool, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(rows as of ``_exact``, each link counted once, (rep, doc_id) of the other documents with the same set)."""
    docs = _one_text(known(docs))
    each = _each(recall)
    found, hits, members, copies = _run(docs, n, threshold, range(each), None, listed)
    sure = found.where(F.col("kind") == SURE).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = 1 << RUN_BITS
    upto = each
    while (share := _estimate(hits, sure)) < recall:
        if upto >= most:
            raise RuntimeError(f"the recall is {share:.3f} by estimate after {most} runs, not {recall}")
        more, hits, _, _ = _run(docs, n, threshold, range(upto, min(upto + each, most)), (members, hits), listed)
        found = found.unionByName(more)
        upto += each
    return found, copies


def pairs(docs: DataFrame, **options: float) -> tuple[DataFrame, DataFrame]:
    """((a, b, jaccard) of the sets' representatives, (rep, doc_id) of the other documents with the same set)."""
    found, copies = _all(docs, True, **options)
    return found.where(F.col("kind") == PAIR).select("a", "b", "jaccard"), copies


def joined(docs: DataFrame, **options: float) -> DataFrame:
    """(doc_id, class_id, n_links) of every document with a link, to another one with jaccard >= threshold.

    class_id is the lowest doc_id of all that links lead to, n_links counts the other
    documents, copies each by itself. A document without links is alone in its class and has no row.
    ``pairs`` has the links between different sets themselves.
    """
    found, copies = _all(docs, False, **options)
    copies = cut(copies)
    more = copies.groupBy("rep").agg(F.count(F.lit(1)).alias("more"))
    links = found.where(F.col("kind") == LINKS).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    roots = components(found.where(F.col("kind") == EDGE)).withColumnRenamed("v", "rep")
    classes = links.join(more, "rep", "full").join(roots, "rep", "left")
    classes = cut(classes.select("rep", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_links")))
    members = copies.unionByName(classes.select("rep", F.col("rep").alias("doc_id")))
    return members.join(classes, "rep").select("doc_id", "class_id", "n_links")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the least vertex of each connected component of edges(a, b), by least labels and pointer jumping."""
    links = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(links.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = links.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "v").select("v", F.least("root", "near").alias("up"), F.col("root").alias("old"))
        jumped = lower.join(labels.select(F.col("v").alias("up"), F.col("root").alias("top")), "up", "left").select("v", F.coalesce("top", "up").alias("root"), "old")
        jumped = cut(jumped)
        labels = jumped.select("v", "root")
        if jumped.where("root <> old").isEmpty():
            return labels


def one_of_each(docs: DataFrame, **options: float) -> DataFrame:
    """docs without near duplicates: of each group the row with the lowest doc_id stays, all columns as they were.

    Of rows that share a doc_id one stays; rows with a null doc_id all do.
    """
    found, copies = _all(docs, False, **options)
    roots = components(found.where(F.col("kind") == EDGE).select("a", "b").union(copies.select(F.col("rep"), F.col("doc_id"))))
    gone = cut(roots.where("v <> root").select(F.col("v").alias("doc_id")))
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not _repeated(docs):
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    single = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max_by(row, F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return kept.where("doc_id IS NULL").unionByName(single)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(documents(spark, sf_dir))


#: Exact, for small tables: all pairs of documents that share a gram.
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(max(text)), '{textkit.WORD}') AS w FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {N}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - {N - 1}, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {THRESHOLD} * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a)
SELECT a AS doc_id, (SELECT min(b) FROM reach r WHERE r.a = m.a) AS class_id, n_links FROM (SELECT a, count(*) AS n_links FROM ends GROUP BY a) m"""
