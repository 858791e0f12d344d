import numpy as np
import pyarrow as pa

from siftmill.llm import files, urlfilter
from siftmill.llm.common import fresh
from tests.oracle import compare

from .data import save

PAGES = "page_id long, url string, html string"


def pages(spark):
    rows = [(i, f"https://www.site{i % 5}.example.com/a/{i}/?q=1#x", f"<title>{'bad ### title' if i % 11 == 0 else 'fine'}</title>") for i in range(60)]
    rows += [(100, None, None), (101, "", "x"), (102, "/relative", "<title>###</title>"), (103, "HTTP://User@SITE0.example.com:80//a//0", "<title>x</title>"), (103, "HTTP://User@SITE0.example.com:80//a//0", "<title>x</title>"), (None, "http://site1.example.com/a/11", "")]
    return spark.createDataFrame(rows, PAGES)


def test_sql(spark, tmp_path):
    d = save(spark, tmp_path, pages=pages(spark))
    compare(urlfilter.query(spark, d), urlfilter.SQL, d)


def test_keys_and_specificity(spark):
    listed = spark.createDataFrame([("example.com",), ("site1.example.com/a",), (None,), ("",), ("example.com",)], "key string")
    got = {r["page_id"]: r["key"] for r in urlfilter.blocked(pages(spark), urlfilter.build(listed)).collect()}
    assert got[6] == "site1.example.com/a" and got[5] == "example.com" and got[103] == "example.com"
    assert not {100, 101, 102} & set(got)
    assert urlfilter.blocked(pages(spark), urlfilter.build(listed.limit(0))).count() == 0
    assert urlfilter.blocked(pages(spark).limit(0), urlfilter.build(listed)).count() == 0


def test_collisions_are_confirmed(spark):
    """Two keys under one hash: only the stored string counts."""
    keys = [b"one.example.com", b"two.example.com"]
    hashes = np.array([7, 7], np.int64)
    path = files.write(fresh(spark, "t"), "shard", [np.int64(2).tobytes(), hashes.tobytes(), np.array([0, 15, 30], np.int64).tobytes(), *keys])
    d = urlfilter.Digests([(7, 7, 2, path)])
    assert d.contains(np.array([7, 7, 7, 8], np.int64), pa.array(["two.example.com", "one.example.com", "six.example.com", "one.example.com"])).tolist() == [True, True, False, False]
