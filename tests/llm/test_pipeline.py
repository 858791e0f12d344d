"""Every stage against brute force on its own input, and run() against the stages."""

import duckdb

import corpus_pipeline
from siftmill.llm import decontam, linededup, mixing, quality

from .data import frame, hard_rows, prose, save
from .test_decontam import smith_waterman, words
from .test_setjoin import brute


def lines_left(docs):
    """First occurrence of each long line in the order of doc_id (None first), text and place."""
    seen, out = {}, {}
    for d, t in sorted({(d, t) for d, t, *_ in docs if t}, key=lambda x: (x[0] is not None, x[0] or 0)):
        kept = []
        lost = False
        for i, line in enumerate(t.split("\n")):
            s = line.strip(linededup.STRIP)
            if len(s) >= linededup.MIN_CHARS and seen.setdefault(s, (d, i)) != (d, i):
                lost = True
            else:
                kept.append(line)
        out[d, t] = "\n".join(kept) if lost else t
    return out


def groups(docs):
    root = {d: d for d, *_ in docs if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(docs):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {d for d in root if find(d) == d}


def test_stages_and_run(spark, tmp_path):
    line = "a line that many of these documents share"
    rows = hard_rows() + [(500 + i, f"{line}\n{prose(600 + i, 50)}", "fr", "src2", 1) for i in range(12)]
    rows += [(600, "NOTHING BUT CAPITALS IN THIS ONE HERE", "en", "src1", 1), (601, f"{line}", "en", "src1", 1)]
    items = [(i, prose(4000 + i, 25, 50)) for i in range(4)]
    rows += [(700 + i, f"{prose(710 + i, 30)} {items[i][1]}", "en", "src1", 1) for i in range(3)]
    d = save(spark, tmp_path, documents=frame(spark, rows), benchmark=spark.createDataFrame(items, "item_id long, text string"))

    def taken(df):
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)

    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "mix_sources"]

    one = stages["quality_rules"](spark, docs, d)
    keep = {r["doc_id"] for r in quality.ledger(docs).where("keep_v2").collect()}
    assert taken(one) == sorted(((r[0], r[1]) for r in rows if r[0] in keep and (r[0] is not None or r[1])), key=repr) and 600 not in keep

    left = one.collect()
    two = stages["line_dedup"](spark, one, d)
    want = lines_left([tuple(r) for r in left])
    assert taken(two) == sorted(((r["doc_id"], want[r["doc_id"], r["text"]]) for r in left if want[r["doc_id"], r["text"]].strip()), key=repr)

    three = stages["near_duplicates"](spark, two, d)
    left = [tuple(r) for r in two.collect()]
    stay = groups(left)
    assert {r["doc_id"] for r in three.collect()} == stay | {x[0] for x in left if x[0] is None}

    four = stages["decontamination"](spark, three, d)
    leaked = {r["doc_id"] for r in three.collect() if r["doc_id"] is not None and len(words(r["text"])) < 5000 and any(smith_waterman(words(t), words(r["text"])) >= decontam.LEAK * decontam.MATCH * len(words(t)) for _, t in items)}
    assert {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in three.collect()} - leaked and {700, 701, 702} <= leaked

    assert all(x.columns == columns for x in (one, two, three, four))
    four.write.parquet(f"{tmp_path}/mixed_in.parquet")
    five = stages["mix_sources"](spark, spark.read.parquet(f"{tmp_path}/mixed_in.parquet"), d)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/mixed_in.parquet/*.parquet'")
    want = sorted((r[0], r[1], r[2]) for r in c.execute(f"SELECT doc_id, epoch, key FROM ({mixing.SQL}) WHERE doc_id IS NOT NULL").fetchall())
    assert sorted((r["doc_id"], r["mix_epoch"], r["mix_key"]) for r in five.where("doc_id IS NOT NULL").collect()) == want

    whole = corpus_pipeline.run(spark, d)
    assert sorted((r["doc_id"], r["mix_epoch"], r["mix_key"]) for r in whole.where("doc_id IS NOT NULL").collect()) == want
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_and_wide_tables(spark, tmp_path):
    d = save(spark, tmp_path, documents=frame(spark, hard_rows(), clash=True).limit(0), benchmark=spark.createDataFrame([(1, "x y z w")], "item_id long, text string"))
    assert corpus_pipeline.run(spark, d).count() == 0
