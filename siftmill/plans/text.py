"""Queries of indicators, languages, tokens, keywords and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.functions import dims, ioc, lang, nlp
from siftmill.sources.shared import spread


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# indicators


def ioc_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ioc.extract(_docs(spark, sf_dir), "text", ["doc_id"])


def _ioc_sql(table: str = "documents", key: str = "doc_id", text: str = "text", types: list[str] | None = None) -> str:
    return " UNION ALL ".join(
        f"SELECT DISTINCT {key}, '{t}' AS type, {ioc.TYPES.index(t) + 1} AS type_ord, unnest(regexp_extract_all({text}, {_quoted(ioc.PATTERNS[t])}, 0)) AS ioc FROM {table}" for t in types or ioc.TYPES
    )


def ioc_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ioc.counts(ioc_all(spark, sf_dir))


def ioc_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ioc.priority(ioc_all(spark, sf_dir), ["doc_id"])


def ioc_defang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ioc_all(spark, sf_dir)
    c, t = F.col("ioc"), F.col("type")
    return found.select("doc_id", "type", "ioc", ioc.is_fanged(c, t).alias("fanged"), ioc.to_defanged(c, t).alias("defanged"), ioc.to_fanged(ioc.to_defanged(c, t), t).alias("back"))


_DOTS = r" *[(\[]? *(?:dot|\.) *[\])]? *"


def _fang_sql(c: str) -> str:
    dots = f"regexp_replace({{0}}, {_quoted(_DOTS)}, '.', 'g')"
    mail = rf"regexp_replace(replace(replace({c}, '[AT]', '@'), '[.]', '.'), ' ?[(\[]? ?(?:[aA][tT]|@) ?[\])]? ?', '@', 'g')"
    url = rf"regexp_replace(replace(replace(replace({c}, 'hxxp', 'http'), '[://]', '://'), '[.]', '.'), '[\[(]://[\])]', '://', 'g')"
    return (
        f"CASE type WHEN 'Email' THEN {dots.format(mail)} WHEN 'Domain' THEN {dots.format(f'replace({c}, {_quoted("[.]")}, {_quoted(".")})')} WHEN 'IPv4' THEN {dots.format(f'replace({c}, {_quoted("[.]")}, {_quoted(".")})')} "
        rf"WHEN 'IPv6' THEN regexp_replace(replace({c}, '[:]', ':'), '[(\[]:[\])]', '.', 'g') WHEN 'URL' THEN {dots.format(url)} ELSE {c} END"
    )


_DEFANG_SQL = (
    "CASE type WHEN 'Email' THEN replace(replace(ioc, '@', '[AT]'), '.', '[.]') WHEN 'Domain' THEN replace(ioc, '.', '[.]') WHEN 'IPv4' THEN replace(ioc, '.', '[.]') "
    "WHEN 'IPv6' THEN replace(ioc, ':', '[:]') WHEN 'URL' THEN replace(replace(replace(ioc, 'http', 'hxxp'), '://', '[://]'), '.', '[.]') ELSE ioc END"
)


def ioc_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ioc.formatted(ioc_all(spark, sf_dir), ["doc_id"], "csv")


def ioc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ioc.formatted(ioc_all(spark, sf_dir), ["doc_id"], "stats")


def ioc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ioc.formatted(ioc_all(spark, sf_dir), ["doc_id"], "table")


def ioc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ioc.extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")), "html", ["page_id"])


# languages


def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", lang.detect(F.col("text")).alias("d")).select("doc_id", F.col("d.lang").alias("lang"), F.round("d.probability", 9).alias("probability"))


def lang_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select(F.col("lang").alias("labelled"), lang.detect(F.col("text"))["lang"].alias("detected"))
    return docs.groupBy("labelled", "detected").agg(F.count(F.lit(1)).alias("n"))


def lang_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _docs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(dims.languages_table(spark)), F.col("lang") == F.col("code"), "left").select("lang", "name", "n")


def _evidence_sql() -> str:
    rows = []
    for code, words in sorted(lang.WORDS.items()):
        hits = " + ".join(f"(length(t) - length(replace(t, ' {w} ', ''))) // {len(w) + 2}" for w in words)
        rows.append(f"SELECT doc_id, labelled, '{code}' AS code, {lang.WEIGHT} * ({hits}) AS n FROM t")
    return f"""WITH t AS (SELECT doc_id, lang AS labelled, ' ' || lower(coalesce(text, '')) || ' ' AS t FROM documents),
      e AS ({" UNION ALL ".join(rows)} UNION ALL SELECT doc_id, labelled, 'und', 1 FROM t),
      s AS (SELECT doc_id, labelled, code, n, max(n) OVER (PARTITION BY doc_id) AS best, sum(exp(n * 0.5)) OVER (PARTITION BY doc_id) AS total FROM e WHERE n > 0),
      d AS (SELECT doc_id, labelled, min(code) AS lang, any_value(CASE WHEN best > {lang.OVERFLOW} THEN 1.0 ELSE exp(best * 0.5) / total END) AS probability FROM s WHERE n = best GROUP BY doc_id, labelled)"""


# tokens, sentences, keywords, summaries


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(nlp.sentences(F.col("text"))).alias("idx", "sentence"))


def stopword_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.stopword_stats(_docs(spark, sf_dir), "doc_id", "text", "lang")


def keywords_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.keywords(_docs(spark, sf_dir), "doc_id", "text", "lang", 10).withColumn("score", F.round("score", 9))


def keywords_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.filtered_keywords(_docs(spark, sf_dir), "doc_id", "text", "lang").withColumn("score", F.round("score", 9))


def keywords_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.basic_keywords(_docs(spark, sf_dir), "doc_id", "text", "lang", 10).withColumn("score", F.round("score", 9))


def body_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(nlp.words(F.col("text"))).alias("n_words"), nlp.body_valid(F.col("text")).alias("valid"))


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their first line as title."""
    return _docs(spark, sf_dir).select("doc_id", "lang", F.split("text", "\n")[0].alias("title"), "text")


def sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nlp.sentence_scores(_titled(spark, sf_dir), "doc_id", "title", "text", "lang")
    return out.select("doc_id", "idx", *[F.floor(F.col(c) * 1000000 + 0.50001).cast("long").alias(c) for c in ("title_score", "sbs", "dbs", "length_score", "position_score", "score")])


def summary_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.summary(_titled(spark, sf_dir), "doc_id", "title", "text", "lang")


def _stop_sql() -> str:
    rows = ", ".join(f"('{c}', {_quoted(w)})" for c in ("de", "en", "es", "fr") for w in sorted(dims.stopwords()[c]))
    return f"stop(lang, token) AS (VALUES {rows})"


_TOKENS_SQL = (
    f"{_stop_sql()}, t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '{nlp.TOKEN}') AS t FROM documents), "
    "tok AS (SELECT doc_id, lang, len(t) AS n_tokens, unnest(t) AS token, unnest(range(len(t))) AS pos FROM t), "
    "marked AS (SELECT tok.*, s.token IS NOT NULL AS is_stop FROM tok LEFT JOIN stop s USING (lang, token))"
)


def _keywords_sql(k: int) -> str:
    return (
        f"{_TOKENS_SQL}, freq AS (SELECT doc_id, lang, token, CAST(count(*) AS BIGINT) AS freq, min(pos) AS first, max(n_tokens) AS n_tokens FROM marked WHERE NOT is_stop GROUP BY doc_id, lang, token), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, first, token) AS rank FROM freq), "
        f"kw AS (SELECT doc_id, lang, token, freq, freq * CAST(1.5 AS DOUBLE) / n_tokens + 1 AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {k})"
    )


_SENTENCES_SQL = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')), lambda x: strlen(x) > 10)"
_POSITION_SQL = "CASE WHEN p > 1.0 THEN 0.0 " + " ".join(f"WHEN p > {i / 10} THEN {nlp.POSITIONS[i]}" for i in range(9, -1, -1)) + " ELSE 0.0 END"
_SCORES_SQL = f"""{_keywords_sql(nlp.SUMMARY_KEYWORDS)},
  base AS (SELECT doc_id, lang, string_split(text, chr(10))[1] AS title, text FROM documents),
  pieces AS (SELECT doc_id, lang, len(s) AS n, unnest(range(len(s))) AS idx, unnest(s) AS sentence FROM (SELECT doc_id, lang, {_SENTENCES_SQL} AS s FROM base)),
  long AS (SELECT doc_id, lang, idx, len(t) AS n_tokens, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT *, regexp_extract_all(lower(sentence), '{nlp.TOKEN}') AS t FROM pieces)),
  heads AS (SELECT b.* FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(title), '{nlp.TOKEN}')) AS token FROM base) b ANTI JOIN stop USING (lang, token)),
  nheads AS (SELECT doc_id, count(*) AS n_title FROM heads GROUP BY doc_id),
  hit AS (SELECT l.*, k.score AS kw, h.token IS NOT NULL AS in_title FROM long l LEFT JOIN kw k USING (doc_id, token) LEFT JOIN (SELECT DISTINCT doc_id, token FROM heads) h USING (doc_id, token)),
  laps AS (SELECT *, pos - lag(pos) OVER w AS gap, lag(kw) OVER w AS before FROM hit WHERE kw IS NOT NULL WINDOW w AS (PARTITION BY doc_id, idx ORDER BY pos)),
  d AS (SELECT doc_id, idx, sum(before * kw / CAST(gap * gap AS DOUBLE)) AS summ, CAST(count(DISTINCT token) + 1 AS DOUBLE) AS k FROM laps GROUP BY doc_id, idx),
  s AS (SELECT doc_id, idx, sum(coalesce(kw, 0.0)) AS kw, CAST(sum(CASE WHEN in_title THEN 1 ELSE 0 END) AS DOUBLE) AS hits, max(n_tokens) AS n_tokens FROM hit GROUP BY doc_id, idx),
  f AS (SELECT p.doc_id, p.idx, p.sentence, coalesce(hits / n_title, 0.0) AS title_score, coalesce(kw / n_tokens / 10.0, 0.0) AS sbs, coalesce(coalesce(summ, 0.0) / (k * (k + 1.0)), 0.0) AS dbs,
      1 - abs(20 - coalesce(n_tokens, 0)) / CAST(20.0 AS DOUBLE) AS length_score, CAST(p.idx + 1 AS DOUBLE) / n AS p FROM pieces p LEFT JOIN s USING (doc_id, idx) LEFT JOIN d USING (doc_id, idx) LEFT JOIN nheads USING (doc_id)),
  g AS (SELECT *, CAST({_POSITION_SQL} AS DOUBLE) AS position_score FROM f),
  scored AS (SELECT *, (title_score * 1.5 + (sbs + dbs) / 2.0 * 10.0 * 2.0 + length_score + position_score) / 4.0 AS score FROM g)"""

QUERIES = {
    "ioc_all": ioc_all,
    "ioc_counts_by_type": ioc_counts_by_type,
    "ioc_priority": ioc_priority,
    "ioc_defang": ioc_defang,
    "ioc_csv": ioc_csv,
    "ioc_stats": ioc_stats,
    "ioc_table": ioc_table,
    "ioc_pages": ioc_pages,
    "lang_detect": lang_detect,
    "lang_confusion": lang_confusion,
    "lang_names": lang_names,
    "sentence_split": sentence_split,
    "stopword_stats": stopword_stats,
    "keywords_topk": keywords_topk,
    "keywords_filtered": keywords_filtered,
    "keywords_basic": keywords_basic,
    "body_valid": body_valid,
    "sentence_scores": sentence_scores,
    "summary_topn": summary_topn,
}

_NAMES_SQL = ", ".join(f"('{c}', {_quoted(n)})" for c, (n, _) in sorted(dims.languages().items()) if n)

ORACLES = {
    "ioc_all": _ioc_sql(),
    "ioc_counts_by_type": f"SELECT type, count(*) AS n FROM ({_ioc_sql()}) GROUP BY type",
    "ioc_priority": f"SELECT doc_id, type, ioc FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY type_ord DESC, ioc) AS r FROM ({_ioc_sql()})) WHERE r = 1",
    "ioc_defang": f"SELECT doc_id, type, ioc, type NOT IN ('Bitcoin', 'MD5', 'SHA1', 'SHA256', 'SHA512', 'File', 'CVE') AND {_fang_sql('ioc')} = ioc AS fanged, defanged, {_fang_sql('defanged')} AS back FROM (SELECT *, {_DEFANG_SQL} AS defanged FROM ({_ioc_sql()}))",
    "ioc_csv": f"SELECT doc_id, string_agg(ioc || '|' || type, chr(10) ORDER BY type_ord, ioc) AS out FROM ({_ioc_sql()}) GROUP BY doc_id",
    "ioc_stats": f"SELECT doc_id, string_agg(type || ': ' || n, chr(10) ORDER BY type_ord) AS out FROM (SELECT doc_id, type, type_ord, count(*) AS n FROM ({_ioc_sql()}) GROUP BY ALL) GROUP BY doc_id",
    "ioc_table": f"SELECT doc_id, string_agg('# ' || type || chr(10) || part, chr(10) || chr(10) ORDER BY type_ord) AS out FROM (SELECT doc_id, type, type_ord, string_agg(ioc, chr(10) ORDER BY ioc) AS part FROM ({_ioc_sql()}) GROUP BY ALL) GROUP BY doc_id",
    "ioc_pages": _ioc_sql("pages", "page_id", "html"),
    "lang_detect": f"{_evidence_sql()} SELECT doc_id, lang, round(probability, 9) AS probability FROM d",
    "lang_confusion": f"{_evidence_sql()} SELECT labelled, lang AS detected, count(*) AS n FROM d GROUP BY ALL",
    "lang_names": f"WITH names(code, name) AS (VALUES {_NAMES_SQL}) SELECT lang, name, n FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) LEFT JOIN names ON lang = code",
    "sentence_split": f"SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS idx, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES_SQL} AS s FROM documents)",
    "stopword_stats": f"WITH {_TOKENS_SQL} SELECT doc_id, count(*) AS n_tokens, CAST(sum(CASE WHEN is_stop THEN 1 ELSE 0 END) AS BIGINT) AS n_stop FROM marked GROUP BY doc_id",
    "keywords_topk": f"WITH {_keywords_sql(10)} SELECT doc_id, token, freq, round(score, 9) AS score, rank FROM kw",
    "keywords_filtered": f"WITH {_keywords_sql(nlp.MAX_KEYWORDS)}, c AS (SELECT doc_id, lang, score, lower(regexp_replace(token, '[^A-Za-z]', '', 'g')) AS keyword FROM kw) SELECT doc_id, keyword, round(max(score), 9) AS score FROM c ANTI JOIN stop ON stop.lang = c.lang AND stop.token = c.keyword WHERE length(keyword) > 3 AND keyword <> 'unk' GROUP BY doc_id, keyword",
    "keywords_basic": f"WITH {_stop_sql()}, w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\f\\r]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, lang, regexp_replace(unnest(w), '[^a-z]', '', 'g') AS keyword, unnest(range(len(w))) AS pos FROM w), f AS (SELECT doc_id, keyword, count(*) AS freq, min(pos) AS first FROM c ANTI JOIN stop ON stop.lang = c.lang AND stop.token = c.keyword WHERE length(keyword) >= 3 GROUP BY doc_id, keyword), r AS (SELECT doc_id, keyword, freq / sum(freq) OVER (PARTITION BY doc_id) AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, first, keyword) AS INTEGER) AS rank FROM f) SELECT doc_id, keyword, round(score, 9) AS score, rank FROM r WHERE rank <= 10",
    "body_valid": "SELECT doc_id, CAST(n AS INTEGER) AS n_words, n >= 300 AS valid FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\f\\r]+'), lambda x: x <> '')) AS n FROM documents)",
    "sentence_scores": f"WITH {_SCORES_SQL} SELECT doc_id, CAST(idx AS INTEGER) AS idx, " + ", ".join(f"CAST(floor({c} * 1000000 + CAST(0.50001 AS DOUBLE)) AS BIGINT) AS {c}" for c in ("title_score", "sbs", "dbs", "length_score", "position_score", "score")) + " FROM scored",
    "summary_topn": f"WITH {_SCORES_SQL}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS r FROM scored JOIN base USING (doc_id) WHERE length(title) > 0) WHERE r <= {nlp.MAX_SENTENCES}) SELECT doc_id, string_agg(sentence, ' ' ORDER BY idx) AS summary FROM top GROUP BY doc_id",
}


def conversation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent turns of one role dropped, with the running number of what is left."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag("role").over(order)
    return turns.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("role"))).select("conv_id", "turn", "role", F.row_number().over(order).alias("n"))


QUERIES["conversation_gaps"] = conversation_gaps
ORACLES["conversation_gaps"] = "SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS n FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NULL OR before <> role"
