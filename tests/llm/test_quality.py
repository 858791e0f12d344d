from siftmill.llm import quality
from tests.oracle import compare

from .data import frame, hard_rows, save


def test_sql(spark, tmp_path):
    d = save(spark, tmp_path, documents=frame(spark, hard_rows()))
    compare(quality.query(spark, d), quality.SQL, d)
    compare(quality.ablation_query(spark, d), quality.ABLATION_SQL, d)


def test_counts_of_any_script_against_sql(spark, tmp_path):
    texts = ["ÄÖÜ ÉÈ Straße ÇA", "Привет МИР друзья", "日本語 の 文章 です 。", "emoji 😀 𝒜𝒷 𐐀𐐨 mixed", "\n \n\t\n   \nline\nline\n", "a a\na  a\u00a0a\u00a0a", "x\x0cx x\x0bx", "ǅ ǈ titlecase", "\u2028para\u2029", "é" * 5000, "ends with two \n\n"]
    d = save(spark, tmp_path, documents=frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]))
    compare(quality.query(spark, d), quality.SQL, d)


def test_defined_results(spark):
    rows = {r["doc_id"]: r for r in quality.ledger(frame(spark, hard_rows(), clash=True)).collect() if r["doc_id"] is not None}
    assert quality.ledger(frame(spark, hard_rows())).count() == len(hard_rows())
    for i in (40, 41, 42):
        assert rows[i]["n_words"] == 0 and rows[i]["fail_mask"] & quality.bits("no_words") and not rows[i]["keep_v2"]
    assert rows[43]["fail_mask"] == quality.bits("few_words") and rows[43]["keep_v2"]
    assert rows[50]["n_words"] == 30_000 and rows[50]["keep_v2"]
    assert all(rows[i]["keep_v2"] for i in range(10))


def test_rules_and_policies(spark):
    junk = {
        1: ("LOUD WORDS ALL AROUND THIS TEXT HERE", "upper_case"),
        2: ("a### b$$$ c%%% d&&& e*** f###", "symbols"),
        3: ("go! stop! run! wait! sit! stand!", "shouting"),
        4: ("the the the the is is is is of of", "stutter"),
        5: ("1234 5678 9012 3456 7890 a", "not_letters"),
        6: ("same line here\n" * 6, "repeated_lines"),
        7: ("{ a } [ b ] < c > ; d ; e", "braces"),
    }
    led = quality.ledger(spark.createDataFrame([(i, t, "en", "s", 1) for i, (t, _) in junk.items()], "doc_id long, text string, lang string, source string, n_chars long"))
    for r in led.collect():
        assert r["fail_mask"] & quality.bits(junk[r["doc_id"]][1]), r
        assert not r["keep_v2"]
        assert r["keep_v1"] == (r["fail_mask"] & quality.POLICIES["v1"] == 0)


def test_accept_and_ablation(spark):
    docs = frame(spark, hard_rows(), clash=True)
    led = quality.ledger(docs)
    kept = quality.accept(docs)
    assert kept.columns == docs.columns
    assert kept.count() == led.where("keep_v2").count()
    saved = quality.stored(docs)
    assert sorted(map(repr, quality.accept(docs, led=saved).collect())) == sorted(map(repr, kept.collect()))
    assert quality.ablation(saved.limit(0)).count() == 0 and quality.stored(docs.limit(0)).count() == 0
    assert quality.accept(docs.limit(0)).count() == 0 and quality.ledger(docs.limit(0)).count() == 0
    rows = led.collect()
    for r in quality.ablation(led).collect():
        mask, bit = quality.POLICIES[r["version"]], quality.bits(r["rule"])
        assert r["n_fail"] == sum(bool(x["fail_mask"] & bit) for x in rows)
        assert r["n_only"] == sum(x["fail_mask"] & mask == bit for x in rows)
        assert r["kept_without"] == sum(x["fail_mask"] & mask & ~bit == 0 for x in rows)
