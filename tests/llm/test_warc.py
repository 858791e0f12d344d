import zstandard

from siftmill.llm import files, warc
from tests.oracle import compare

from .data import save

PAGES = "page_id long, url string, html string, bundle string, frame string, record_id string"
ROWS = [(i * 37, f"http://e.org/{i}?é={i}", f"<p>{i} ü</p>" * (i % 9), "own", "own", "own") for i in range(300)] + [
    (5, None, "x", "", "", ""), (6, "http://a", None, "", "", ""), (7, "bad\r\nX: y", "\r\n\r\nWARC/1.1\r\n", "", "", ""), (None, "http://n", "n", "", "", ""), (None, None, None, "", "", ""),
    (8, "http://same", "same", "", "", ""), (8, "http://same", "same", "", "", ""), (9, "http://long", "long " * 400_000, "", "", ""), (10, " spaced ", "", "", "", ""),
]


def test_sql(spark, tmp_path):
    rows = [r for r in ROWS if None not in r and "\r" not in r[1] and r[1] == r[1].strip()]
    d = save(spark, tmp_path, pages=spark.createDataFrame(rows, PAGES).select("page_id", "url", "html"))
    compare(warc.query(spark, d), warc.SQL, d)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    index = warc.write(pages)
    back = warc.read(index)
    key = lambda r: (repr(r[0]), repr(r[1]), repr(r[2]))
    assert sorted(((r["page_id"], r["url"], r["html"]) for r in back.collect()), key=key) == sorted((r[:3] for r in ROWS), key=key)
    spots = [(r["path"], r["frame"], r["offset"]) for r in index.collect()]
    assert len(set(spots)) == len(ROWS)


def test_bundles_are_plain_zstandard_and_frames_stand_alone(spark):
    index = warc.write(spark.createDataFrame(ROWS, PAGES))
    for path, n in {(r["path"], r["bundle"]) for r in index.collect()}:
        raw = bytes(files.view(path))
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        table = warc.seek_table(files.opened(path))
        assert sum(t[2] for t in table) == len(whole)
        start, size, plain = table[-1]
        assert zstandard.ZstdDecompressor().decompress(raw[start : start + size]) == whole[len(whole) - plain :]
    nothing = warc.write(spark.createDataFrame([], PAGES))
    assert nothing.count() == 0 and warc.read(nothing).count() == 0


def pages_of(df):
    return sorted(((r["page_id"], r["url"], r["html"]) for r in df.collect()), key=repr)


def test_frames_end_before_their_bytes_are_too_many(spark):
    rows = [(i, f"http://e.org/{i}", "x" * (i * 100 % 9000)) for i in range(200)]
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), frame_bytes=5000)
    assert pages_of(warc.read(index)) == sorted(rows, key=repr)
    tables = [warc.seek_table(files.opened(path)) for path in {r["path"] for r in index.collect()}]
    assert sum(map(len, tables)) > 150 and all(t[2] < 5000 + 500 or t[2] < 9400 for table in tables for t in table)


def test_bundles_of_repeated_and_null_ids_are_several_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE", 16)
    rows = [(None, f"http://n/{i}", f"n{i}") for i in range(200)] + [(5, "http://same", "same")] * 200 + [(40, "http://x", "x")]
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert pages_of(warc.read(index)) == sorted(rows, key=repr)
    assert len({r["path"] for r in index.where("bundle = -1").collect()}) > 5
    assert len({r["path"] for r in index.where("bundle = 0").collect()}) > 1
    assert len({r["path"] for r in index.where("bundle = 2").collect()}) == 1
