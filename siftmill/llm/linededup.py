"""Line dedup against levelled sorted runs of line hashes.

The state is a log-structured store in the shared folder: each run is a table of
128-bit line hashes with the place where each line first stood, bucketed and sorted by
hash. A new batch is reduced to one row for each hash, the first place, before and after
its one shuffle, so a line that every document has costs no task more than others. It is
then merge-anti-joined with each run (whose side needs no exchange); what no run holds is
new and becomes a run of level 0. When a level has ``fanout`` runs, they are merged, bucket
by bucket, into one run of the next level, so a batch meets at most ``fanout`` runs a
level. Runs never share a hash. A manifest in the store's folder names the runs of each
level after every step, so a store can be opened again (``Runs.open``).

The first occurrence of a line, by doc_id and then by place, stays; later ones go.
Lines are compared without spaces, tabs and carriage returns at their ends.

Defined results: lines of fewer than ``min_chars`` characters (blank ones in any case)
always stay. A null or empty text has no lines and comes back as it was. A null doc_id counts
as the lowest. Rows that repeat a doc_id with its text are one document and keep the
same lines; rows that share a doc_id but differ in text are told apart by a hash of the
text. A document may end up empty; ``deduplicated`` leaves such out if they had lines
to lose. An empty table gives an empty result. Other columns are kept as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import chunks, cut, documents, fresh, remove

MIN_CHARS = 1
STRIP = " \t\r"
LOWEST = -(1 << 63)
_LINE = "h binary, k long, t long, n int"


def _hashes(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(h, k, t, n) of the lines of each chunk, of equal ones the first only."""
    for batch in chunks(batches):
        first: dict[bytes, tuple[int, int, int]] = {}
        for key, sign, text in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for i, line in enumerate((text or "").split("\n")):
                line = line.strip(STRIP)
                if line and len(line) >= least:
                    h, at = xxhash.xxh3_128_digest(line.encode()), (key, sign, i)
                    old = first.setdefault(h, at)
                    if at < old:
                        first[h] = at
        if first:
            k, t, n = zip(*first.values(), strict=True)
            yield pa.record_batch([pa.array(list(first), pa.binary()), pa.array(k, pa.int64()), pa.array(t, pa.int64()), pa.array(n, pa.int32())], ["h", "k", "t", "n"])


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k"), F.xxhash64("text").alias("t"), "text")


def _first(lines: DataFrame) -> DataFrame:
    return lines.groupBy("h").agg(F.min(F.struct("k", "t", "n")).alias("at")).select("h", "at.k", "at.t", "at.n")


class Runs:
    """The store. ``add`` takes the lines (h, k, t, n) of a batch and keeps what is new in a run."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None, home: str | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.home = home or fresh(spark, "runs")
        self.levels: list[list[str]] = [[]]

    @classmethod
    def open(cls, spark: SparkSession, home: str) -> Runs:
        """The store that the manifest in a folder describes."""
        m = json.loads(bytes(files.view(f"{home}/manifest.json")))
        out = cls(spark, m["fanout"], m["buckets"], home)
        out.levels = m["levels"]
        for name in [r for level in out.levels for r in level]:
            if not spark.catalog.tableExists(name):
                spark.sql(f"CREATE TABLE {name} (h BINARY, k BIGINT, t BIGINT, n INT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {out.buckets} BUCKETS LOCATION '{home}/{name}'")
        return out

    def _note(self) -> None:
        files.replace(f"{self.home}/manifest.json", json.dumps({"fanout": self.fanout, "buckets": self.buckets, "levels": self.levels}).encode())

    def _save(self, df: DataFrame) -> str:
        name = f"siftmill_run_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.home}/{name}").saveAsTable(name)
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def places(self) -> DataFrame:
        """(k, t, n): where every line of the store first stood."""
        out = self.spark.createDataFrame([], "k long, t long, n int")
        for name in [r for level in self.levels for r in level]:
            out = out.unionByName(self.table(name).select("k", "t", "n"))
        return out

    def add(self, lines: DataFrame) -> None:
        """Keep the new lines of a batch that lies after all earlier ones."""
        new = _first(lines)
        for run in [r for level in self.levels for r in level]:
            new = new.join(self.table(run).select("h").hint("merge"), "h", "left_anti")
        self.levels[0].append(self._save(new))
        self._note()
        self._compact()

    def _compact(self) -> None:
        for i in range(len(self.levels)):
            level = self.levels[i]
            if len(level) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._save(self.merged(level)))
                self.levels[i] = []
                self._note()  # from here on the old runs are not read
                for name in level:
                    self._forget(name)
                    remove(self.spark, f"{self.home}/{name}")

    def merged(self, runs: list[str]) -> DataFrame:
        """The lines of some runs, bucket by bucket: buckets meet without an exchange, as runs are bucketed alike."""
        out = self.table(runs[0])
        for name in runs[1:]:
            out = out.unionByName(self.table(name))
        return _first(out)

    def close(self) -> None:
        """Drop the store."""
        for level in self.levels:
            for name in level:
                self._forget(name)
        remove(self.spark, self.home)


def kept_lines(docs: DataFrame, batches: int = 6, fanout: int = 3, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k, t, kept: array of the numbers of lines that stay) of the documents that keep lines.

    ``docs`` is taken in ``batches`` ranges of doc_id, as a store that grows day by day would see it.
    """
    spark = docs.sparkSession
    bounds = docs.select(F.percentile_approx(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    bounds = sorted(set(bounds))
    lines = fresh(spark, "lines")
    runs = Runs(spark, fanout)
    try:
        hashed = _identified(docs).mapInArrow(lambda it: _hashes(it, min_chars), _LINE)
        number = sum((F.when(F.col("k") > b, 1).otherwise(0) for b in bounds), F.lit(0)) if bounds else F.lit(0)
        hashed.withColumn("batch", number).write.partitionBy("batch").parquet(lines)
        stored = spark.read.schema(f"{_LINE}, batch int").parquet(lines)
        for b in range(len(bounds) + 1):
            runs.add(stored.where(F.col("batch") == b).drop("batch"))
        return cut(runs.places().groupBy("k", "t").agg(F.collect_set("n").alias("kept")))
    finally:
        runs.close()
        remove(spark, lines)


# the numbers of a text's lines that go: neither kept nor too short to count
_DROPPED = r"""transform(array(split({text}, '\n', -1)), l -> array_except(filter(sequence(0, size(l) - 1), i -> length(trim(BOTH ' \t\r' FROM l[i])) >= {least}), coalesce(kept, array())))[0]"""
_REBUILD = r"""CASE WHEN size(dropped) > 0 THEN element_at(transform(array(split({text}, '\n', -1)),
    l -> array_join(transform(array_except(sequence(0, size(l) - 1), dropped), i -> l[i]), '\n')), 1) ELSE {text} END"""


def _with_dropped(rows: DataFrame, text: str, least: int) -> DataFrame:
    return rows.withColumn("dropped", F.coalesce(F.expr(_DROPPED.format(text=text, least=max(least, 1))), F.array().cast("array<int>"))).withColumn("new", F.expr(_REBUILD.format(text=text)))


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, **options: int) -> DataFrame:
    """docs with later occurrences of lines taken out (``text``, and ``n_chars`` if there); emptied documents go."""
    kept = kept_lines(docs, min_chars=min_chars, **options)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k"), F.xxhash64("text").alias("t"))
    both = _with_dropped(row.join(kept, ["k", "t"], "left"), "row.text", min_chars)
    lost = F.size("dropped") > 0
    both = both.where(~lost | F.col("new").rlike(r"[^ \t\r\n]"))
    changed = {"text": F.col("new")} | ({"n_chars": F.when(lost, F.length("new").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return both.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_dropped, text) of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    row = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("k"), F.xxhash64("text").alias("t"))
    both = _with_dropped(row.join(kept_lines(docs), ["k", "t"], "left"), "text", MIN_CHARS)
    return both.select("doc_id", F.size("dropped").cast("long").alias("n_dropped"), F.col("new").alias("text"))


SQL = f"""
WITH lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL),
trimmed AS (SELECT doc_id, text, line, n, trim(line, ' ' || chr(9) || chr(13)) AS x FROM lines),
ranked AS (SELECT *, length(x) >= {MIN_CHARS} AND rank() OVER (PARTITION BY x ORDER BY doc_id, n) > 1 AS dup FROM trimmed),
kept AS (SELECT doc_id, CAST(count(*) FILTER (WHERE dup) AS BIGINT) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dup), '') AS text FROM ranked GROUP BY doc_id, text)
SELECT * FROM kept UNION ALL SELECT doc_id, 0, text FROM documents WHERE text IS NULL"""
