from siftmill.llm import linededup
from tests.oracle import compare

from .data import frame, hard_rows, prose, save

LINE = "this line stands in many documents"


def test_sql(spark, tmp_path):
    rows = [r for i, r in enumerate(hard_rows()) if r[0] is not None]
    rows += [(60 + i, f"{LINE}\n{prose(i, 20)}\n{LINE}\nshort", "en", "s", 1) for i in range(30)]
    d = save(spark, tmp_path, documents=frame(spark, rows).dropDuplicates(["doc_id", "text"]))
    compare(linededup.query(spark, d), linededup.SQL, d)


def kept(docs, **options):
    return sorted((r["k"], tuple(sorted(r["kept"]))) for r in linededup.kept_lines(docs, **options).collect())


def test_batches_and_compaction_change_nothing(spark):
    docs = frame(spark, [(i, f"{LINE}\n{prose(i % 7, 20)}\nown line of document number {i}\nend", "en", "s", 1) for i in range(40)])
    want = kept(docs, batches=1)
    assert want == kept(docs, batches=5, fanout=2)
    assert [k for k, n in want if 0 in n] == [0]


def test_one_line_in_all_documents(spark):
    """It reaches the shuffle once for each chunk and costs no window."""
    docs = frame(spark, [(i, f"{LINE}\nown {i}", "en", "s", 1) for i in range(3000)])
    lines = list(linededup._hashes(iter(linededup._identified(docs).toArrow().to_batches()), 1))
    assert sum(b.num_rows for b in lines) <= 3000 + len(lines)
    out = {r["doc_id"]: r["text"] for r in linededup.deduplicated(docs).collect()}
    assert out[0] == f"{LINE}\nown 0" and all(out[i] == f"own {i}" for i in range(1, 3000))


def test_store_opens_again(spark):
    lines = lambda ks: spark.createDataFrame([(bytes([k]) * 16, k, 0, 0) for k in ks], linededup._LINE)
    runs = linededup.Runs(spark, fanout=3)
    for batch in ([1, 2], [2, 3], [3, 4], [4, 5]):
        runs.add(lines(batch))
    assert [len(x) for x in runs.levels] == [1, 1]
    for name in [r for level in runs.levels for r in level]:
        spark.sql(f"DROP TABLE {name}")  # as in a new session
    again = linededup.Runs.open(spark, runs.home)
    assert again.levels == runs.levels
    again.add(lines([1, 5, 6]))
    assert sorted(r["k"] for r in again.places().collect()) == [1, 2, 3, 4, 5, 6]
    again.close()


def test_runs_merge_without_a_shuffle(spark):
    lines = lambda ks: spark.createDataFrame([(bytes([k]) * 16, k, 0, 0) for k in ks], linededup._LINE)
    runs = linededup.Runs(spark, fanout=4)
    for batch in ([1, 2], [2, 3], [3, 4]):
        runs.add(lines(batch))
    plan = runs.merged(runs.levels[0])._jdf.queryExecution().executedPlan().toString()
    runs.close()
    assert "Exchange" not in plan, plan


def test_defined_results(spark):
    docs = frame(spark, [*hard_rows(), (70, f"{LINE}\n{LINE}", "en", "s", 69), (71, LINE, "en", "s", 34), (72, f"{LINE}\nand a line of its own to keep", "en", "s", 1)], clash=True)
    out = linededup.deduplicated(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    assert rows[70]["text"] == LINE and rows[70]["n_chars"] == len(LINE)
    assert 71 not in rows  # nothing left
    assert rows[72]["text"] == "and a line of its own to keep"
    assert rows[40]["text"] is None and rows[41]["text"] == "" and rows[43]["text"] == "word"
    assert linededup.deduplicated(docs, min_chars=20).where("text = 'word'").count() == 1
    assert 21 not in rows and 20 in rows
    assert out.where("doc_id = 30").count() == 2  # repeated rows are one document
    assert out.where("doc_id IS NULL").count() == 2
    assert linededup.deduplicated(docs.limit(0)).count() == 0
