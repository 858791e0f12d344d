from dataclasses import replace

from siftmill.llm import mixing
from tests.oracle import compare

from .data import frame, hard_rows, prose, save


def test_sql(spark, tmp_path):
    d = save(spark, tmp_path, documents=frame(spark, hard_rows()))
    compare(mixing.query(spark, d), mixing.SQL, d)


def test_shortage_goes_to_siblings_first(spark):
    mix = mixing.Mix(domains=(("^a", "A"),), domain_weights={"A": 50, "other": 50}, lang_weights={"en": 50, "fr": 50}, source_weights={"a1": 50, "a2": 50}, other=50, percent=50, max_epochs=1)
    leaves = spark.createDataFrame([("A", "en", "a1", 10), ("A", "en", "a2", 200), ("A", "fr", "a1", 100), ("other", "en", "b1", 90)], "domain string, lang string, source string, tokens long")
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.budgets(leaves, mix).collect()}
    # 400 tokens, half wanted: 100 for each domain, the other one has 90; 110 for A, 55 for each language
    assert got[("other", "en", "b1")] == 90
    assert got[("A", "en", "a1")] == 10 and got[("A", "en", "a2")] == 45  # what a1 lacks stays in en
    assert got[("A", "fr", "a1")] == 55


def test_epochs_and_prefix(spark):
    docs = frame(spark, [(i, prose(i, 100), "en", "src1", 1) for i in range(20)])
    mix = replace(mixing.Mix(), percent=250, max_epochs=4)
    rows = mixing.select(docs, mix).collect()
    assert sum(r["n_tokens"] for r in rows) == 5000
    assert all(sum(r["epoch"] == e for r in rows) == n for e, n in ((0, 20), (1, 20), (2, 10)))
    first, last = [r for r in rows if r["epoch"] == 2], {r["doc_id"]: r["key"] for r in rows if r["epoch"] == 2}
    assert len(first) == len(last) == 10
    assert mixing.select(docs, mix).collect() and sorted(map(tuple, mixing.select(docs, mix).collect())) == sorted(map(tuple, rows))


def test_defined_results(spark):
    docs = frame(spark, hard_rows(), clash=True)
    got = mixing.select(docs).collect()
    assert not {40, 41, 42} & {r["doc_id"] for r in got}
    twice = [r for r in got if r["doc_id"] == 30]
    assert len(twice) % 2 == 0
    full = mixing.mixed(docs)
    assert full.columns == [*docs.columns, "mix_epoch", "mix_key"] and full.count() == len(got)
    again = mixing.mixed(docs.selectExpr("*", "'own' AS mix_key", "'own' AS Mix_Epoch"))
    assert again.columns == full.columns and sorted(map(repr, again.collect())) == sorted(map(repr, full.collect()))
    assert mixing.select(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_names_with_any_signs(spark, tmp_path):
    docs = frame(spark, [(i, prose(i, 30), "e'n", ("o'x", "b\\y", 'q"z')[i % 3], 1) for i in range(30)])
    mix = mixing.Mix(domains=(("^o'", "d'1"), ("^b", "d2")), domain_weights={"d'1": 3, "d2": 1}, lang_weights={"e'n": 5}, source_weights={"o'x": 7, 'q"z': 2}, percent=40)
    d = save(spark, tmp_path, documents=docs)
    compare(mixing.select(spark.read.parquet(f"{d}/documents.parquet"), mix), mixing.sql(mix), d)
    assert {r["domain"] for r in mixing.select(docs, mix).collect()} >= {"d'1", "other"}
