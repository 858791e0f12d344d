"""URL filter on a sorted digest array.

A blocklist of keys (hosts, parent domains, path prefixes, whole addresses) becomes
shards of sorted 64-bit xxhash values with the keys themselves beside them. Shards are
memory-mapped; a batch of addresses is probed with one vectorised binary search for each
shard, and a hit counts only if the stored string is equal, so colliding hashes do no harm.

An address blocks if any of its keys is listed: ``host/path``, each shorter path, the
host, each parent domain of two labels or more; the most specific one is reported.
Hosts lose user, port and ``www.``, and paths their doubled and final slashes; queries
and fragments do not count.

Defined results: null, empty, relative or malformed addresses have no keys and never
match; null and empty list entries are ignored, repeated ones count once. Rows that
repeat are each reported. An empty list blocks nothing. The length of an address does
not matter. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import fresh

ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"
SHARD_KEYS = 4_000_000

_HOST = rf"regexp_replace(regexp_replace(lower(regexp_extract({{u}}, r'{ADDRESS}', 1)), r'^.*@|:[0-9]*$', ''), r'^www\.', '')"
_KEYS = r"""filter(concat(
  transform(reverse(sequence(1, greatest(size(p), 1))), i -> CASE WHEN size(p) > 0 THEN concat(h, '/', array_join(slice(p, 1, i), '/')) END),
  array(h),
  CASE WHEN size(d) > 2 THEN transform(sequence(2, size(d) - 1), i -> array_join(slice(d, i, size(d)), '.')) ELSE array() END), k -> k <> '')"""


def with_keys(df: DataFrame, url: str = "url") -> DataFrame:
    """df with ``keys``: the array of list keys of the address, the most specific first."""
    parts = df.withColumn("h", F.expr(_HOST.format(u=url))).withColumn("p", F.expr(rf"filter(split(regexp_extract({url}, r'{ADDRESS}', 2), '/'), x -> x <> '')")).withColumn("d", F.split("h", r"\."))
    return parts.withColumn("keys", F.expr(f"CASE WHEN h <> '' THEN {_KEYS} ELSE array() END")).drop("h", "p", "d")


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.record_batch([pa.array([], pa.int64()), pa.array([], pa.string())], ["hash", "key"])])
    if not table.num_rows:
        return
    hashes = table.column("hash").to_numpy()
    order = np.argsort(hashes, kind="stable")
    texts = [table.column("key")[int(i)].as_py().encode() for i in order]
    ends = np.cumsum([0, *map(len, texts)], dtype=np.int64)
    path = files.write(folder, "digests", [np.int64(len(order)).tobytes(), hashes[order].tobytes(), ends.tobytes(), *texts])
    yield pa.record_batch([pa.array([int(hashes[order[0]])]), pa.array([int(hashes[order[-1]])]), pa.array([len(order)]), pa.array([path])], ["first", "last", "n", "path"])


def build(keys: DataFrame) -> list[tuple[int, int, int, str]]:
    """Write keys(key) as digest shards to the shared folder; returns their manifest (first, last, n, path).

    Keys are partitioned by ranges of the hash, so each shard is written by one task and
    only the manifest, one row for each 4 million keys, reaches the driver.
    """
    folder = fresh(keys.sparkSession, "digests")
    entries = keys.select(F.col("key")).where("key <> ''").distinct().withColumn("hash", F.xxhash64("key"))
    shards = max(1, -(-entries.count() // SHARD_KEYS))
    ranged = entries.select("hash", "key").repartitionByRange(shards, "hash")
    out = ranged.mapInArrow(lambda it: _write_shard(it, folder), "first long, last long, n long, path string").collect()
    return sorted((r["first"], r["last"], r["n"], r["path"]) for r in out)


class Digests:
    """Probes a manifest; one instance for each task."""

    def __init__(self, manifest: list[tuple[int, int, int, str]]) -> None:
        self.manifest = manifest
        self.lasts = np.array([m[1] for m in manifest], np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if i not in self.open:
            raw = files.view(self.manifest[i][3])
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            self.open[i] = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n + 1, 8 + 8 * n), np.frombuffer(raw, np.uint8, offset=16 + 16 * n)
        return self.open[i]

    def contains(self, hashes: np.ndarray, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        if not len(self.manifest) or not len(hashes):
            return found
        place = np.searchsorted(self.lasts, hashes, "left")
        for i in np.unique(place[place < len(self.manifest)]):
            keys, ends, heap = self.shard(int(i))
            rows = np.flatnonzero(place == i)
            at = np.searchsorted(keys, hashes[rows], "left")
            hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == hashes[rows])
            for row, k in zip(rows[hit].tolist(), at[hit].tolist(), strict=True):
                text, j = texts[row].as_py().encode(), k
                while j < len(keys) and keys[j] == hashes[row]:  # all keys of one hash
                    if heap[ends[j] : ends[j + 1]].tobytes() == text:
                        found[row] = True
                        break
                    j += 1
        return found


def _probe(batches: Iterator[pa.RecordBatch], manifest: list[tuple[int, int, int, str]]) -> Iterator[pa.RecordBatch]:
    digests = Digests(manifest)
    for batch in batches:
        keys, hashes = batch.column("keys"), batch.column("hashes")
        ends = keys.offsets.to_numpy()
        found = np.flatnonzero(digests.contains(hashes.values.to_numpy()[ends[0] : ends[-1]], keys.values.slice(ends[0], ends[-1] - ends[0])))
        if not len(found):
            continue
        rows = np.searchsorted(ends - ends[0], found, "right") - 1
        rows, first = np.unique(rows, return_index=True)  # the most specific key of each row comes first
        picked = keys.values.slice(ends[0], ends[-1] - ends[0]).take(pa.array(found[first]))
        yield pa.record_batch([batch.column("id").take(pa.array(rows)), batch.column("url").take(pa.array(rows)), picked], ["id", "url", "key"])


def blocked(pages: DataFrame, manifest: list[tuple[int, int, int, str]], id: str = "page_id", url: str = "url") -> DataFrame:
    """(id, url, key) of the rows whose address is on the list."""
    keyed = with_keys(pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"))).withColumn("hashes", F.expr("transform(keys, k -> xxhash64(k))"))
    return keyed.mapInArrow(lambda it: _probe(it, manifest), "id long, url string, key string").withColumnRenamed("id", id)


#: A page is bad if its title has a run of this; a host is bad from this share of bad pages on.
BAD_TITLE = "[#$%&*]{3}"
BAD_HOST = 0.05


def bad_keys(pages: DataFrame) -> DataFrame:
    """The list that the query filters by: addresses of pages with junk titles, and hosts with many of them."""
    titled = with_keys(pages.select("url", F.coalesce(F.regexp_extract("html", "<title>([^<]*)</title>", 1).rlike(BAD_TITLE), F.lit(False)).alias("bad"))).where("size(keys) > 0")
    titled = titled.select("bad", F.col("keys")[0].alias("key"), F.expr(_HOST.format(u="url")).alias("host"))
    hosts = titled.groupBy("host").agg(F.avg(F.col("bad").cast("double")).alias("share")).where(F.col("share") >= BAD_HOST)
    return titled.where("bad").select("key").union(hosts.select("host")).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, key) of the pages whose address is on the list of bad pages and hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return blocked(pages, build(bad_keys(pages)))


SQL = rf"""
WITH parsed AS (SELECT page_id, url, html, regexp_replace(regexp_replace(lower(regexp_extract(url, '{ADDRESS}', 1)), '^.*@|:[0-9]*$', '', 'g'), '^www\.', '') AS h,
    list_filter(string_split(regexp_extract(url, '{ADDRESS}', 2), '/'), lambda x: x <> '') AS p FROM pages),
keyed AS (SELECT *, list_concat(list_concat(list_transform(list_reverse(range(1, len(p) + 1)), lambda i: h || '/' || array_to_string(p[1:i], '/')), [h]),
    list_transform(range(2, len(string_split(h, '.'))), lambda i: array_to_string(string_split(h, '.')[i:], '.'))) AS keys,
    coalesce(regexp_matches(regexp_extract(html, '<title>([^<]*)</title>', 1), '{BAD_TITLE}'), false) AS bad FROM parsed WHERE h <> ''),
listed AS (SELECT DISTINCT keys[1] AS key FROM keyed WHERE bad UNION SELECT h FROM keyed GROUP BY h HAVING avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END) >= {BAD_HOST}),
probed AS (SELECT page_id, url, row_number() OVER () AS r, unnest(keys) AS key, unnest(range(len(keys))) AS i FROM keyed)
SELECT page_id, url, arg_min(key, i) AS key FROM probed JOIN listed USING (key) GROUP BY page_id, url, r"""
SQL = SQL.replace("row_number() OVER () AS r, unnest(keys)", "r, unnest(keys)").replace("SELECT *, list_concat", "SELECT *, row_number() OVER () AS r, list_concat")
