import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftmill.functions import dims, ioc, lang, nlp

IOC_CASES = [
    ("mail bob@test.com now", {("bob@test.com", "Email"), ("test.com", "Domain")}),
    ("mail bob[@]test.com", {("bob[@]test.com", "Email"), ("test.com", "Domain")}),
    ("carol [at] site.org", {("carol [at] site.org", "Email"), ("site.org", "Domain")}),
    ("host 10[.]0(.)0.1 up", {("10[.]0(.)0.1", "IPv4")}),
    ("1.2([.])3.4", set()),
    ("v6 fe80::1:2 there", {("fe80::1:2", "IPv6")}),
    ("see hxxps://evil.example.com/a?b=1/ end", {("hxxps://evil.example.com/a?b=1", "URL"), ("evil.example.com", "Domain")}),
    ("d41d8cd98f00b204e9800998ecf8427e", {("d41d8cd98f00b204e9800998ecf8427e", "MD5")}),
    ("x" + "a" * 40, set()),
    ("sha " + "ab" * 20, {("ab" * 20, "SHA1")}),
    ("sha " + "cd" * 32, {("cd" * 32, "SHA256")}),
    ("sha " + "ef" * 64, {("ef" * 64, "SHA512")}),
    ("run setup.exe and a-b.tar", {("setup.exe", "File"), ("a-b.tar", "File")}),
    ("cve-2021-44228 CAPEC-63 cwe-79", {("cve-2021-44228", "CVE"), ("CAPEC-63", "CAPEC"), ("cwe-79", "CWE")}),
    ("cpe:/a:vendor:product:1.0", {("cpe:/a:vendor:product:1.0", "CPE")}),
    ("pay 1BoatSLRHtKNngkdXEeobR76b53LETtpyT", {(" 1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "Bitcoin")}),
    ("éabc d41d8cd98f00b204e9800998ecf8427eé", {("d41d8cd98f00b204e9800998ecf8427e", "MD5")}),
    ("nothing here", set()),
    ("", set()),
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(IOC_CASES)] + [(99, None)], "id int, text string")


def test_indicators(cases):
    got = {}
    for r in ioc.extract(cases, "text", ["id"]).collect():
        got.setdefault(r["id"], set()).add((r["ioc"], r["type"]))
    for i, (text, want) in enumerate(IOC_CASES):
        assert got.get(i, set()) == want, text


def test_indicator_patterns_in_both_dialects(cases):
    c = duckdb.connect()
    for i, (text, _) in enumerate(IOC_CASES):
        for kind, pattern in ioc.PATTERNS.items():
            theirs = c.execute("SELECT regexp_extract_all(?, ?)", [text, pattern]).fetchall()[0][0]
            mine = [r["ioc"] for r in ioc.extract(cases.where(F.col("id") == i), "text", ["id"], types=[kind]).collect()] if theirs else []
            assert mine == list(dict.fromkeys(theirs)), (text, kind)


def test_defang_and_refang(spark):
    rows = [("a@b.com", "Email", "a[AT]b[.]com"), ("::1", "IPv6", "[:][:]1"), ("http://URL.com/x", "URL", "hxxp[://]URL[.]com/x"), ("1.2.3.4", "IPv4", "1[.]2[.]3[.]4"), ("x.exe", "File", "x.exe")]
    df = spark.createDataFrame(rows, "ioc string, type string, want string")
    c, t = F.col("ioc"), F.col("type")
    for r in df.select("ioc", "type", "want", ioc.to_defanged(c, t).alias("d"), ioc.to_fanged(ioc.to_defanged(c, t), t).alias("b"), ioc.is_fanged(c, t).alias("f")).collect():
        assert r["d"] == r["want"] and r["b"] == r["ioc"] and r["f"] == (r["type"] != "File")
    loose = spark.createDataFrame([("Email at test.com", "Email"), ("test(dot)com", "Domain"), ("8[.]8(.)8.8", "IPv4")], "ioc string, type string")
    assert [r[0] for r in loose.select(ioc.to_fanged(c, t)).collect()] == ["Email@test.com", "test.com", "8.8.8.8"]
    assert [r["ioc"] for r in ioc.normalise(loose).collect()] == ["Email[AT]test[.]com", "test[.]com", "8[.]8[.]8[.]8"]


def test_priority_and_formats(spark):
    df = spark.createDataFrame([(1, "Domain", 6, "b.com"), (1, "Domain", 6, "a.com"), (1, "Email", 7, "x@a.com")], "id int, type string, type_ord int, ioc string")
    assert tuple(ioc.priority(df, ["id"]).first()) == (1, "Email", "x@a.com")
    assert ioc.formatted(df, ["id"], "csv").first()["out"] == "a.com|Domain\nb.com|Domain\nx@a.com|Email"
    assert ioc.formatted(df, ["id"], "stats").first()["out"] == "Domain: 2\nEmail: 1"
    assert ioc.formatted(df, ["id"], "table").first()["out"] == "# Domain\na.com\nb.com\n\n# Email\nx@a.com"


def test_languages(spark):
    rows = [("The cat and the dog of the house is in that place to rest.", "en"), ("Le chat et la souris que les enfants des voisins ont vus.", "fr"), ("Der Hund und die Katze ist ein Tier das bellt.", "de"), ("El perro y la gata que los vecinos en las casas.", "es"), ("", "und"), (None, "und")]
    df = spark.createDataFrame(rows, "text string, want string")
    for r in df.select("want", lang.detect(F.col("text")).alias("d")).collect():
        assert r["d"]["lang"] == r["want"] and 0 < r["d"]["probability"] <= 1
    russian = spark.createDataFrame([("Привет мир",)], "text string").select(lang.detect(F.col("text"), ["ru", "ar"])["lang"]).first()[0]
    assert russian == "ru"


def test_dimensions(spark):
    assert len(dims.stopwords()) == 79 and {"the", "and", "of", ","} <= dims.stopwords_for("en")
    assert dims.stopwords_for("xx") == dims.stopwords_for("en") and "und" in dims.stopwords_for("DE")
    assert dims.language_name("de") == "German" and dims.language_code("german") == "de" and not dims.is_language("zz")
    assert dims.language_class("en-US") == r"a-zA-Z0-9\s" and dims.language_class("ru") == "\\u0400-\\u04ff"
    assert len(dims.tlds()) == 734 and dims.languages_table(spark).count() == 180


def test_sentences_and_scores(spark):
    df = spark.createDataFrame([(1, "Solar panels", "Solar panels make power. Short. Panels need sun and space! Does wind help at night? It does help a lot.", "en")], "id int, title string, text string, lang string")
    assert df.select(F.size(nlp.sentences(F.col("text")))).first()[0] == 4
    scores = {r["idx"]: r for r in nlp.sentence_scores(df, "id", "title", "text", "lang").collect()}
    assert scores[0]["title_score"] == 1.0 and scores[1]["title_score"] == 0.5 and scores[3]["position_score"] == 0.15
    s = nlp.summary(df, "id", "title", "text", "lang", 2).first()["summary"]
    assert s.startswith("Solar panels make power")
    assert nlp.summary(df.withColumn("title", F.lit("")), "id", "title", "text", "lang").count() == 0


def test_keywords_with_title_and_fallbacks(spark):
    got = nlp.with_title_of({"solar": 1.2, "wind": 1.4}, "The Solar Farm", "en")
    assert [(k, round(s, 6)) for k, s in got] == [("solar", 1.8), ("wind", 1.4), ("farm", 0.1)]
    assert nlp.with_title_of({}, "The Solar Farm", "en") == []
    df = spark.createDataFrame([(1, "Wind farms, wind parks. A farm of the sea has wind and more wind than land.", "en")], "id int, text string, lang string")
    basic = nlp.basic_keywords(df, "id", "text", "lang", 2)
    assert [r["keyword"] for r in basic.orderBy("rank").collect()][0] == "wind"
    assert nlp.basic_summary(df, "id", "text", "lang", 2, 1).first()["summary"] == "A farm of the sea has wind and more wind than land."
    cjk = spark.createDataFrame([("ab1 中文c", "zh")], "t string, l string").select(nlp.tokens(F.col("t"), F.col("l"))).first()[0]
    assert cjk == ["ab1", "中", "文", "c"]
    assert nlp.tokens_of("ab1 中文c", "zh") == cjk


def test_digest_cuts_the_list_and_not_the_scores(spark):
    df = spark.createDataFrame([("Solar Farm", "Solar power grows. " * 3 + "Wind power falls everywhere tonight. Tidal power stays.", "en"), (None, None, None), ("Farm", "", "en")], "title string, text string, lang string")
    rows = [r[0] for r in df.select(nlp.digest(F.col("title"), F.col("text"), F.col("lang"), 2, 1)).collect()]
    assert rows[0]["keywords"] == ["solar", "power"] and set(rows[0]["scores"]) == {"solar", "power", "farm"} and rows[0]["summary"]
    assert all(r["keywords"] == [] and r["scores"] == {} and r["summary"] == "" for r in rows[1:])
    basic = df.select(nlp.digest(F.col("title"), F.col("text"), F.col("lang"), 2, 1, tokenizer=False)).first()[0]
    assert basic["keywords"] == ["power", "solar"] and basic["summary"].endswith(".")


def test_tokens_of_python_and_of_spark_agree(spark):
    texts = ["Straße 12,5 km_x!", "İstanbul ΣΑΣ", "a\u00a0b\u2003c", "日本語テキスト", "e\u0301 ½ Ⅷ ²", "tab\tnew\x0bline\x0c", "😀👍🏽 ok"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(nlp.tokens(F.col("t"))).collect()] == [nlp.tokens_of(t) for t in texts]
    assert [r[0] for r in df.select(nlp.sentences(F.col("t"))).collect()] == [nlp.sentences_of(t) for t in texts]


def test_nothing_of_the_text_is_shuffled(spark):
    df = spark.createDataFrame([(1, "t", "x", "en")], "id int, title string, text string, lang string")
    for out in (nlp.keywords(df, "id", "text", "lang"), nlp.summary(df, "id", "title", "text", "lang"), nlp.sentence_scores(df, "id", "title", "text", "lang"), nlp.stopword_stats(df, "id", "text", "lang")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_few_rows_are_python_objects_at_a_time(spark):
    """Slices hold up to _BYTES of strings, or one row, and _ROWS rows; every row of a batch has its results."""
    cut = list(nlp.slices([pa.array(["x" * (nlp._BYTES // 2), None, "y" * (nlp._BYTES // 2), "z" * (3 * nlp._BYTES), "a"] + ["é"] * 1000), pa.array([1] * 1005)]))
    assert cut == [(0, 3), (3, 1), (4, 256), (260, 256), (516, 256), (772, 233)] and list(nlp.slices([pa.array([], pa.string())])) == []
    text = "The river was calm. " + "It ran past the old mill and on to the sea" * 1000
    docs = spark.range(0, 400, 1, 1).select("id", F.lit("A river").alias("title"), F.lit(text).alias("text"), F.lit("en").alias("lang"))
    scores = nlp.sentence_scores(docs, "id", "title", "text", "lang")
    assert [tuple(r) for r in scores.groupBy("id").count().groupBy("count").count().collect()] == [(2, 400)]
