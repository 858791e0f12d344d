"""Benchmark decontamination: rare n-gram seeds, counted without loss, Smith-Waterman alignment.

1. Every alignment of a document with an item (match 2, mismatch and gap -1) is a chain of
   matched words. A step to the next matched word that takes p words in the item and q in
   the text costs max(p, q) - 1, so a chain of score S has steps that cost 0 or 1 (p and q
   at most 2) of which, counted 2 and 1, there are S - 2 or more, within 3 m - S words of the
   text (m: words of the item). The n-grams here are these pairs of words, one and two apart.
2. One scan counts how often each pair of the items stands in the corpus. Every item gives
   up its most frequent pairs, as long as what the rest has to count stays above ``KEEP`` of
   the S - 2; each pair given up lowers that by what it could have counted. What is left are
   the item's rare seeds: a second scan looks them up in every document. Seeds chosen by rarity
   alone, with one hit enough, lose edited copies; so many frequent pairs, for hits
   that are counted exactly, lose none, however often an item or a pair stands in the corpus.
3. A passage is what lies around places from which on the count is enough for a score of
   ``LEAK``. Nothing that aligns well enough can be without.
4. All passages are aligned to their item, word by word, vectorised over passages. The
   score is divided by that of the item with itself; from ``LEAK`` on it is a leak. Edited,
   shortened and interleaved copies keep most of their score.

The benchmark is taken to the tasks as a table of hashes, of ``SHARD_WORDS`` words at
most: a larger one is handled in shards, one scan each.

Defined results: items with a null id or text or fewer than n words are ignored; items
that share an id count as one, with the best of their scores. Rows with a null doc_id
can't be reported and are left out (``clean`` keeps them); null and empty texts match
nothing. Rows that share a doc_id are reported once with the best score; on ties the
earliest start. Texts of any length are scanned whole; a leak counts wherever it stands.
One matched word alone is never a leak. An empty corpus or benchmark gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import chunks, documents, known

N, LEAK = 3, 0.5
#: Share of the count that stays with an item's rare seeds; pairs of which the frequency is told apart (others count as rare).
KEEP, FREQUENT = 1 / 3, 1 << 17
MATCH, MISS, GAP = 2, -1, 1
SHARD_WORDS = 2_000_000
_WIDE = np.int64(1 << 32)


def _pairs(w: textkit.Words, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with the one so many words on, and whether that lies in its row."""
    size = len(w.hash)
    out = np.zeros(size, np.uint64)
    out[: max(size - apart, 0)] = textkit.mix(w.hash[: max(size - apart, 0)] * np.uint64(0xD6E8FEB86659FD93) + w.hash[apart:])
    return out, np.repeat(w.first[1:], np.diff(w.first)) - np.arange(size) > apart


@dataclass
class Items:
    """A shard of the benchmark: words of its items, and which items have each pair of words."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    grams: np.ndarray  # hashes of the pairs
    post: np.ndarray  # of pair g: item[post[g]:post[g + 1]]
    item: np.ndarray
    near: np.ndarray  # of the postings: do the words stand next to each other?
    many: np.ndarray  # of the postings: how often the item has the pair
    need: np.ndarray  # of the items: what its pairs have to count
    seen: np.ndarray  # 2 ** 20 flags by the pairs' low bits

    @classmethod
    def of(cls, ids: list[int], texts: list[str], n: int, least: float) -> Items:
        w = textkit.words(pa.array(texts, pa.string()))
        lengths = np.diff(w.first)
        long = np.repeat(lengths >= n, lengths)
        (one, ok1), (two, ok2) = _pairs(w, 1), _pairs(w, 2)
        ok1, ok2 = ok1 & long, ok2 & long
        grams, which = np.unique(np.concatenate([one[ok1], two[ok2]]), return_inverse=True)
        item = np.concatenate([w.doc()[ok1], w.doc()[ok2]])
        pairs, at, many = np.unique(which.astype(np.int64) * max(len(ids), 1) + item, return_index=True, return_counts=True)  # the first of each, so adjacent ones if any
        gram, item = pairs // max(len(ids), 1), pairs % max(len(ids), 1)
        need = np.maximum(_score(lengths, least) - 2, 1)
        return cls(np.array(ids, np.int64), _fold(w.hash), w.first, grams, np.searchsorted(gram, np.arange(len(grams) + 1)), item, at < ok1.sum(), many, need, _flags(grams))

    def rare(self, frequency: np.ndarray, keep: float) -> Items:
        """The items without their most frequent pairs (by ``frequency`` of each pair), which need less count for that."""
        gram = np.repeat(np.arange(len(self.grams)), np.diff(self.post))
        order = np.lexsort((-frequency[gram], self.item))
        cost = 2 * self.many[order]  # no step counts more than 2
        item = self.item[order]
        spent = np.cumsum(cost)
        start = np.searchsorted(item, np.arange(len(self.ids)))
        before = np.append(0, spent)[start]
        gone = (spent - before[item] <= np.floor(self.need * (1 - keep))[item]) & (frequency[gram[order]] > 0)
        need = self.need - np.bincount(item[gone], cost[gone], len(self.ids)).astype(np.int64)
        left = np.sort(order[~gone])
        some, which = np.unique(gram[left], return_inverse=True)
        grams = self.grams[some]
        return Items(self.ids, self.words, self.first, grams, np.searchsorted(which, np.arange(len(grams) + 1)), self.item[left], self.near[left], self.many[left], np.maximum(need, 1), _flags(grams))

    def known(self, g: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, pairs) where a pair of the items stands."""
        at = np.flatnonzero(ok & self.seen[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        same = self.grams[k] == g[at]
        return at[same], k[same]

    def find(self, g: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, postings) of the pairs that the items have, one for each item."""
        at, k = self.known(g, ok)
        many = self.post[k + 1] - self.post[k]
        return np.repeat(at, many), np.arange(many.sum()) + np.repeat(self.post[k] - (np.cumsum(many) - many), many)


def _fold(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _flags(grams: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << 20, bool)
    seen[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return seen


def _score(lengths: np.ndarray, least: float) -> np.ndarray:
    return np.ceil(MATCH * least * lengths - 1e-9).astype(np.int64)


def passages(w: textkit.Words, items: Items, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, begin, end) in words of the batch: no alignment with a share of ``least`` or more lies elsewhere."""
    (p1, o1), (p2, o2) = items.find(*_pairs(w, 1)), items.find(*_pairs(w, 2))
    place, item = np.concatenate([p1, p2]).astype(np.int64), items.item[np.concatenate([o1, o2])]
    single = np.concatenate([~items.near[o1], np.ones(len(o2), bool)])
    size = np.int64(len(w.hash) + 1)
    key = np.sort((item * size + place) * 2 + single)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] >> 1 != key[:-1] >> 1
    key = key[new]
    weight, key = 2 - (key & 1), key >> 1
    item, place = key // size, key % size
    lengths = np.diff(items.first)[item]
    span = 3 * lengths - _score(lengths, least)
    row = np.searchsorted(w.first, place, "right") - 1
    total = np.append(0, np.cumsum(weight))
    upto = np.searchsorted(key, item * size + np.minimum(place + span, w.first[row + 1]))
    enough = np.flatnonzero(total[upto] - total[:-1] >= items.need[item])
    item, place, row, span = item[enough], place[enough], row[enough], span[enough]
    lo, hi = np.maximum(place - span, w.first[row]), np.minimum(place + span, w.first[row + 1])
    new = np.ones(len(place), bool)
    new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])
    begin = np.flatnonzero(new)
    return item[begin], lo[begin], hi[np.append(begin[1:], len(place)) - 1] if len(place) else hi


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of each item with its text: (score, start, end) in words of the text, the best alignment that ends first."""
    size = len(items)
    m, length = max(map(len, items)), max(map(len, texts))
    a, b = np.full((size, m), -1, np.int64), np.full((size, length), -2, np.int64)
    for i, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    # a cell holds score * 2**32 + start of its alignment; a fresh cell starts at the next word
    fresh = np.arange(1, length + 1, dtype=np.int64)
    slope = np.arange(length, dtype=np.int64) * (GAP * _WIDE)
    before = np.broadcast_to(fresh, (size, length))
    best, end = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for i in range(m):
        diagonal = np.concatenate([np.zeros((size, 1), np.int64), before[:, :-1]], axis=1)
        gain = np.where(b == a[:, i : i + 1], MATCH * _WIDE, MISS * _WIDE)
        cell = np.maximum(np.maximum(diagonal + gain, before - GAP * _WIDE), fresh)
        cell = np.maximum(np.maximum.accumulate(cell + slope, axis=1) - slope, fresh)
        top = (cell >> 32).argmax(axis=1)
        value = cell[np.arange(size), top]
        better = value >> 32 > best >> 32
        best[better], end[better] = value[better], top[better] + 1
        before = cell
    return best >> 32, best & (_WIDE - 1), end


def _leaks(batches: Iterator[pa.RecordBatch], items: Items, least: float) -> Iterator[pa.RecordBatch]:
    lengths = np.diff(items.first)
    for batch in chunks(batches):
        w = textkit.words(batch.column("text"))
        item, lo, hi = passages(w, items, least)
        folded, ids = _fold(w.hash), batch.column("doc_id").to_numpy()
        row = np.searchsorted(w.first, lo, "right") - 1
        size = hi - lo
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):  # passages of about one length together; cells in memory are bounded
            take, wide = 1, size[order[at]]
            while at + take < len(order) and take < 512 and (take + 1) * size[order[at + take]] <= 400_000 and size[order[at + take]] <= 1.3 * wide + 16:
                take += 1
            part = order[at : at + take]
            at += take
            score, begin, end = align([items.words[items.first[i] : items.first[i + 1]] for i in item[part]], [folded[a:b] for a, b in zip(lo[part], hi[part], strict=True)])
            share = score / (MATCH * lengths[item[part]])
            keep = np.flatnonzero(share >= least)
            if len(keep):
                chosen = part[keep]
                start = lo[chosen] - w.first[row[chosen]]
                yield pa.record_batch([pa.array(ids[row[chosen]]), pa.array(items.ids[item[chosen]]), pa.array(share[keep]), pa.array(start + begin[keep]), pa.array(start + end[keep])], ["doc_id", "item_id", "score", "start_word", "end_word"])


def _counts(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """(pair, n): how often each pair of the items stands in a task's documents."""
    total = np.zeros(len(items.grams), np.int64)
    for batch in chunks(batches):
        w = textkit.words(batch.column("text"))
        for apart in (1, 2):
            total += np.bincount(items.known(*_pairs(w, apart))[1], minlength=len(total))
    some = np.flatnonzero(total)
    if len(some):
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["pair", "n"])


def _shards(benchmark: DataFrame, words: int) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] / 5
    shards = max(1, int(-(-total // words)))
    return [items] if shards == 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == i) for i in range(shards)]


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, least: float = LEAK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): documents that hold benchmark items, with the best alignment."""
    spark = docs.sparkSession
    docs = known(docs)
    out = None
    for shard in _shards(benchmark, shard_words):
        rows = sorted((r["item_id"], r["text"]) for r in shard.collect())
        items = Items.of([r[0] for r in rows], [r[1] for r in rows], n, least)
        if not len(items.grams):
            continue
        sent = spark.sparkContext.broadcast(items)
        counted = docs.mapInArrow(lambda it, sent=sent: _counts(it, sent.value), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        frequency = np.zeros(len(items.grams), np.int64)
        top = counted.orderBy(F.desc("n"), "pair").limit(FREQUENT).toArrow()
        frequency[top.column("pair").to_numpy()] = top.column("n").to_numpy()
        sent = spark.sparkContext.broadcast(items.rare(frequency, KEEP))
        found = docs.mapInArrow(lambda it, sent=sent: _leaks(it, sent.value, least), "doc_id long, item_id long, score double, start_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, start_word long, end_word long")
    best = F.max(F.struct("score", (-F.col("start_word")).alias("s"), (-F.col("end_word")).alias("e")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.s")).alias("start_word"), (-F.col("b.e")).alias("end_word"))


def clean(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """The rows of docs without a leak, all columns as they were."""
    gone = leaks(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
