"""Repeated passages by suffix sorting, deep-shallow.

A passage is repeated if its ``LEAST`` words in a row also stand in another document.
The suffixes of the corpus that can matter are found first: every window of LEAST words
is named by the smallest hash of the k-grams in it, so equal windows have equal names,
and neighbouring windows mostly share theirs. Names that occur in one document only are
dropped with one light shuffle (hash and doc_id); for the others the words behind the
windows are shuffled by name, and each task sorts the suffixes of its names:

* multikey quicksort (three-way by the word at the current depth), vectorised over all
  open segments at once, to a shallow depth; suffixes alone in their segment are done;
* the segments left, whose suffixes share a long prefix, go through blind tries: a
  descent that looks at branching bytes only, one comparison with the leaf it ends at,
  and an insertion where the two part. Equal suffixes meet in one leaf.

A leaf with two documents marks its windows; marked windows are merged to spans. A name
that more than ``HOT`` documents share is not sorted in one task: its windows meet one by
one, by hash, with aggregation before the shuffle.

Defined results: positions count words (``textkit.WORD``) from 0, ``end_word`` is
exclusive. Repeats inside one document alone do not count, and rows that share a doc_id
are one document. Rows with a null doc_id are left out, as they can't be reported. Null,
empty and short texts have no windows. Texts of any length are taken whole. Other
columns are ignored. Words are compared by 64-bit hashes folded to 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit
from .common import chunks, cut, documents, known, runs_of

LEAST, GRAM, SHALLOW = 50, 10, 12
#: Documents with a name from which on its windows are compared one by one.
HOT = 20_000
#: Windows of one row: bounds the context that is shuffled with a name.
ROW = 64
_TOP = np.uint64(2**64 - 1)


def _named(w: textkit.Words, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, windows, row) of every run of windows of a batch with one name."""
    none = np.zeros(0, np.int64)
    g, ok = textkit.grams(w, gram)
    size, span = len(g), least - gram + 1
    if size < least:
        return none.astype(np.uint64), none, none, none
    low = np.where(ok, g, _TOP)
    reach = 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    counts = np.diff(w.first)
    doc = np.repeat(np.arange(len(counts)), counts)[: len(low)]
    valid = (np.repeat(w.first[1:], counts)[: len(low)] - np.arange(len(low))) >= least
    at = np.flatnonzero(valid)
    if not len(at):
        return none.astype(np.uint64), none, none, none
    name, doc = low[at], doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(at)))
    if (length > ROW).any():  # text with a short period: cut its long runs
        pieces = -(-length // ROW)
        base = np.repeat(start, pieces)
        k = np.arange(len(base)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(np.repeat(length, pieces) - k * ROW, ROW)
        start = base + k * ROW
    return name[start], at[start], length, doc[start]


def _names(batches: Iterator[pa.RecordBatch], least: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        name, _, _, row = _named(textkit.words(batch.column("text")), least, gram)
        if not len(name):
            continue
        order = np.lexsort((name, row))
        name, row = name[order], row[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
        ids = batch.column("doc_id").to_numpy()[row[new]]
        yield pa.record_batch([pa.array(name[new].view(np.int64)), pa.array(ids)], ["name", "doc_id"])


def _wanted(batch: pa.RecordBatch, name: np.ndarray, start: np.ndarray, count: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows whose name is among those listed with their row."""
    lists = batch.column("names")
    wanted, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    keep = np.zeros(len(name), bool)
    edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
    for i in range(batch.num_rows):
        keep[edge[i] : edge[i + 1]] = np.isin(name[edge[i] : edge[i + 1]], wanted[ends[i] : ends[i + 1]])
    return name[keep], start[keep], count[keep], row[keep]


def _contexts(batches: Iterator[pa.RecordBatch], least: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        w = textkit.words(batch.column("text"))
        name, start, count, row = _wanted(batch, *_named(w, least, gram))
        if not len(name):
            continue
        sizes = count + least - 1
        total = np.cumsum(sizes)
        where = np.arange(total[-1]) + np.repeat(start - (total - sizes), sizes)
        words = (w.hash >> np.uint64(32)).astype(np.uint32)[where]
        offsets = np.zeros(len(name) + 1, np.int32)
        offsets[1:] = total * 4
        context = pa.Array.from_buffers(pa.binary(), len(name), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words.tobytes())])
        ids = batch.column("doc_id").to_numpy()[row]
        first = start - w.first[row]
        yield pa.record_batch([pa.array(name.view(np.int64)), pa.array(ids), pa.array(first.astype(np.int64)), context], ["name", "doc_id", "first", "context"])


def quicksort(words: np.ndarray, at: np.ndarray, segment: np.ndarray, shallow: int) -> Iterator[np.ndarray]:
    """Multikey quicksort of the suffixes words[at:], all segments in step; yields those that reach the depth together.

    ``segment`` numbers the segments from 0 and is sorted. Every yielded array holds the
    places (in ``at``) of suffixes, two at least, that share ``shallow`` words.
    """
    ids = np.arange(len(at))
    depth = np.zeros(int(segment[-1]) + 1 if len(segment) else 0, np.int64)
    while True:
        # suffixes alone in their segment are sorted
        size = np.bincount(segment, minlength=len(depth))
        done = (size >= 2) & (depth >= shallow)
        if done.any():
            out = ids[done[segment]]
            edges = np.cumsum(size[done])[:-1]
            yield from np.split(out, edges)
        live = (size >= 2) & (depth < shallow)
        if not live.any():
            return
        pick = live[segment]
        number = np.cumsum(live) - 1
        ids, segment, depth = ids[pick], number[segment[pick]], depth[live]
        size = size[live]
        word = words[at[ids] + depth[segment]]
        first = np.cumsum(size) - size
        pivot = word[first + size // 2]
        side = 1 + (word > pivot[segment]).astype(np.int64) - (word < pivot[segment])
        key = segment * 3 + side
        order = np.argsort(key, kind="stable")
        ids, key = ids[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        segment = np.cumsum(new) - 1
        depth = depth[key[new] // 3] + (key[new] % 3 == 1)


class BlindTrie:
    """Strings of one length, in order; equal ones share a leaf."""

    def __init__(self) -> None:
        self.root: list | None = None  # [branching byte, {byte: child}] or (string, number, members)

    def add(self, s: bytes, member: int) -> None:
        if self.root is None:
            self.root = (s, int.from_bytes(s), [member])
            return
        node = self.root
        while type(node) is list:  # blind descent
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        number = int.from_bytes(s)
        x = number ^ node[1]
        if not x:
            node[2].append(member)
            return
        part = len(s) - (x.bit_length() + 7) // 8
        leaf, other = (s, number, [member]), node[0][part]
        parent, node = None, self.root
        while type(node) is list and node[0] < part:
            parent, node = node, node[1][s[node[0]]]
        if type(node) is list and node[0] == part:
            node[1][s[part]] = leaf
            return
        joint = [part, {s[part]: leaf, other: node}]
        if parent is None:
            self.root = joint
        else:
            parent[1][s[parent[0]]] = joint

    def leaves(self) -> Iterator[tuple[bytes, list[int]]]:
        """(string, members) in order."""
        todo = [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if type(node) is list:
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node[0], node[2]


def _sorted_spans(batches: Iterator[pa.RecordBatch], least: int, shallow: int, later: bool) -> Iterator[pa.RecordBatch]:
    for table in runs_of(batches, "name"):
        names, ids, firsts = (table.column(c).to_numpy() for c in ("name", "doc_id", "first"))
        raw = table.column("context").to_pylist()
        # rows with the same words are one context
        at: dict[tuple[int, bytes], int] = {}
        of = np.fromiter((at.setdefault(x, len(at)) for x in zip(names.tolist(), raw, strict=True)), np.int64, len(raw))
        low, high = np.full(len(at), np.iinfo(np.int64).max), np.full(len(at), np.iinfo(np.int64).min)
        np.minimum.at(low, of, ids)
        np.maximum.at(high, of, ids)
        context = [k[1] for k in at]
        sizes = np.fromiter((len(c) // 4 for c in context), np.int64, len(context))
        name = np.fromiter((k[0] for k in at), np.int64, len(at))
        order = np.argsort(name, kind="stable")
        counts = sizes - least + 1  # windows of each context
        words = np.frombuffer(b"".join(context), np.uint32)
        base = np.cumsum(sizes) - sizes
        edge = np.cumsum(counts) - counts  # windows are numbered through
        lowest, highest = np.repeat(low, counts), np.repeat(high, counts)  # of the documents that hold each window
        # names with several contexts: sort their suffixes
        new = np.ones(len(order), bool)
        new[1:] = name[order][1:] != name[order][:-1]
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        chosen, group = order[several], group[several]
        if len(chosen):
            many = counts[chosen]
            window = np.arange(many.sum()) + np.repeat(edge[chosen] - (np.cumsum(many) - many), many)
            start = np.repeat(base[chosen] - edge[chosen], many) + window
            segment = np.repeat(np.unique(group, return_inverse=True)[1], many)
            text = words.astype(">u4").tobytes()
            for places in quicksort(words, start, segment, shallow):
                trie = BlindTrie()
                for p in places.tolist():
                    s = int(start[p])
                    trie.add(text[4 * (s + shallow) : 4 * (s + least)], int(window[p]))
                for _, members in trie.leaves():
                    if len(members) > 1:
                        lowest[members] = lowest[members].min()
                        highest[members] = highest[members].max()
        # windows of each row that another (with later: an earlier) document has too
        many = counts[of]
        window = np.arange(many.sum()) + np.repeat(edge[of] - (np.cumsum(many) - many), many)
        owner = np.repeat(np.arange(len(of)), many)
        hit = lowest[window] < ids[owner] if later else lowest[window] != highest[window]
        place = (np.repeat(firsts, many) + window - np.repeat(edge[of], many))[hit]
        owner = owner[hit]
        if not len(place):
            continue
        cut = np.ones(len(place), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
        begin = np.flatnonzero(cut)
        last = np.append(begin[1:], len(place)) - 1
        yield pa.record_batch([pa.array(ids[owner[begin]]), pa.array(place[begin]), pa.array(place[last] + least)], ["doc_id", "start_word", "end_word"])


def _windows(batches: Iterator[pa.RecordBatch], least: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(w, doc_id, place): hash and place of every window of the wanted names."""
    for batch in chunks(batches):
        w = textkit.words(batch.column("text"))
        name, start, count, row = _wanted(batch, *_named(w, least, gram))
        if not len(name):
            continue
        at = np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)
        row = np.repeat(row, count)
        yield pa.record_batch([pa.array(textkit.grams(w, least)[0][at].view(np.int64)), pa.array(batch.column("doc_id").to_numpy()[row]), pa.array((at - w.first[row]).astype(np.int64))], ["w", "doc_id", "place"])


def _hot_spans(docs: DataFrame, wanted: DataFrame, least: int, gram: int, later: bool) -> DataFrame:
    """Spans from the windows of hot names: sorting has nothing to add there, so equal windows meet by their hash, aggregated before and after the shuffle."""
    windows = docs.join(wanted, "doc_id").select("doc_id", "text", "names").mapInArrow(lambda it: _windows(it, least, gram), "w long, doc_id long, place long")
    windows = cut(windows)
    both = windows.groupBy("w").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high")
    hit = windows.join(both, "w")
    return (hit.where("low < doc_id") if later else hit).select("doc_id", F.col("place").alias("start_word"), (F.col("place") + least).alias("end_word"))


def repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, shallow: int = SHALLOW, later: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word): the spans of docs whose words repeat, ``least`` in a row, in other documents.

    With ``later`` only spans that a document of lower doc_id has: what a dedup takes out.
    """
    docs = known(docs)
    names = cut(docs.mapInArrow(lambda it: _names(it, least, gram), "name long, doc_id long"))
    shared = names.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    shared = cut(shared.select("name", (F.col("n") > hot).alias("hot")))
    wanted = lambda which: names.join(shared.where(which), "name").groupBy("doc_id").agg(F.collect_list("name").alias("names"))
    contexts = docs.join(wanted("NOT hot"), "doc_id").select("doc_id", "text", "names").mapInArrow(lambda it: _contexts(it, least, gram), "name long, doc_id long, first long, context binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = contexts.repartition(parts, "name").sortWithinPartitions("name").mapInArrow(lambda it: _sorted_spans(it, least, shallow, later), "doc_id long, start_word long, end_word long")
    if not shared.where("hot").isEmpty():
        found = found.unionByName(_hot_spans(docs, wanted("hot"), least, gram, later))
    order = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("reach").isNull() | (F.col("start_word") > F.col("reach")), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = found.withColumn("reach", reach).withColumn("island", island)
    return spans.groupBy("doc_id", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("island")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))


SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{textkit.WORD}') AS w FROM documents WHERE doc_id IS NOT NULL),
windows AS (SELECT doc_id, i, hash(w[i + 1 : i + {LEAST}]) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - {LEAST} + 1)) AS i FROM w WHERE len(w) >= {LEAST})),
shared AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT DISTINCT doc_id, i FROM windows SEMI JOIN shared USING (h)),
marked AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LEAST} THEN 0 ELSE 1 END AS new FROM hits),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked)
SELECT doc_id, CAST(min(i) AS BIGINT) AS start_word, CAST(max(i) + {LEAST} AS BIGINT) AS end_word FROM islands GROUP BY doc_id, island"""
