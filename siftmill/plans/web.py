"""Queries of the URL algebra, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.functions import dims, urls


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.parsed(_pages(spark, sf_dir), "url").select("page_id", "u.*")


def url_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", "url", urls.clean(F.col("url")).alias("clean"))


def url_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five forms of reference, resolved against each page's address and cleaned."""
    forms = F.array(*[F.lit(x) for x in ("/a/b?utm_source=x&q=1", "c.html#top", "../up/", "//cdn.example.org/x//y", "https://other.example.com/?url=https%3A%2F%2Fgo.example.com%2Fz&m=1")])
    each = _pages(spark, sf_dir).select("page_id", "url", F.posexplode(forms).alias("form", "ref"))
    return each.select("page_id", "form", urls.prepare(F.col("ref"), F.col("url")).alias("prepared"))


def url_likely_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("url")
    return _pages(spark, sf_dir).select("page_id", "url", urls.likely_article(c).alias("likely"), urls.is_absolute(c).alias("absolute"), urls.is_asset(c).alias("asset"), urls.naive_domain(c).alias("naive_domain"))


def url_valid_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = urls.parsed(_pages(spark, sf_dir), "url")
    return p.select("page_id", urls.valid_category(F.col("u"), F.col("url")).alias("valid"), urls.no_stop_chunk(F.col("u")).alias("no_stop"))


def url_valid_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.parsed(_pages(spark, sf_dir), "url").select("page_id", urls.valid_news(F.col("u"), F.col("url")).alias("valid"))


def url_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.posexplode(urls.chunks(urls.path(F.col("url")))).alias("pos", "chunk"))


def feed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _pages(spark, sf_dir).select(F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host(F.col("url"))).alias("url")).distinct()
    return urls.feed_candidates(sources, "url")


def host_article_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _pages(spark, sf_dir).select(urls.host(F.col("url")).alias("host"), urls.likely_article(F.col("url")).alias("likely"))
    return each.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if("likely").alias("articles"))


def unique_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each cleaned address."""
    cleaned = _pages(spark, sf_dir).withColumn("clean", urls.clean(F.col("url")))
    return cleaned.withColumn("r", F.row_number().over(Window.partitionBy("clean").orderBy("page_id"))).where("r = 1").select("page_id", "clean")


def unique_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each conversation turn, unique without regard to case, first spelling kept, in order."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda x: x != "")
    each = turns.select("conv_id", "turn", F.posexplode(words).alias("pos", "word"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "turn", F.lower("word")).orderBy("pos"))
    return each.withColumn("r", rank).where("r = 1").select("conv_id", "turn", "pos", "word")


QUERIES = {
    "url_parts": url_parts,
    "url_clean": url_clean,
    "url_prepare": url_prepare,
    "url_likely_article": url_likely_article,
    "url_valid_category": url_valid_category,
    "url_valid_news": url_valid_news,
    "url_chunks": url_chunks,
    "feed_candidates": feed_candidates,
    "host_article_counts": host_article_counts,
    "unique_urls": unique_urls,
    "unique_ci": unique_ci,
}


def _list(words) -> str:  # noqa: ANN001
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_P = urls.RFC.replace("^(?:", "(?s)^(?:", 1)
_HOST = rf"regexp_replace(regexp_replace(regexp_extract(url, '{_P}', 2), '^.*@', ''), ':[0-9]*$', '')"
_CHUNKS = f"list_filter(string_split(regexp_extract(url, '{_P}', 3), '/'), lambda x: x <> '')"
_PARTS = f"""parts AS (SELECT page_id, url, lower(regexp_extract(url, '{_P}', 1)) AS scheme, {_HOST} AS host, regexp_extract(regexp_extract(url, '{_P}', 2), ':([0-9]+)$', 1) AS port,
    regexp_extract(url, '{_P}', 3) AS path, regexp_extract(url, '{_P}', 4) AS raw_query, regexp_extract(url, '{_P}', 5) AS fragment, {_CHUNKS} AS c FROM pages),
  named AS (SELECT *, lower(coalesce(regexp_extract(c[-1], '\\.([^.]*)$', 1), '')) AS ending, string_split(host, '.') AS l FROM parts),
  p AS (SELECT * EXCLUDE (ending, l), CASE WHEN strlen(ending) <= 5 OR list_contains({_list(dims.ARTICLE_TYPES)}, ending) THEN ending ELSE '' END AS file_type,
    array_to_string(l[:-3], '.') AS subdomain, l[-2] AS domain, l[-1] AS tld FROM named)"""
_CLEAN = """(SELECT page_id, url, front || replace(path, '//', '/') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS clean FROM (
    SELECT page_id, url, regexp_extract(url, '^((?:[^:/?#]+:)?(?://[^/?#]*)?)', 1) AS front, regexp_extract(url, '{P}', 3) AS path,
      array_to_string(list_sort(list_transform(list_filter(string_split(regexp_extract(url, '{P}', 4), '&'), lambda p: p <> '' AND NOT list_contains({T}, split_part(p, '=', 1))), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)), '&') AS q FROM {src}))"""


def _clean_sql(src: str = "pages") -> str:
    return _CLEAN.replace("{P}", _P).replace("{T}", _list(sorted(dims.TRACKING_PARAMS))).replace("{src}", src)


def _any(c: str, words) -> str:  # noqa: ANN001
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_LIKELY = f"CASE WHEN {_any('path', dims.NOT_ARTICLE)} THEN false WHEN contains(url, '/item?id=') THEN true WHEN {_any('path', dims.ARTICLE)} THEN true WHEN regexp_matches(url, '{urls.DATED}') THEN true ELSE raw_query <> '' END"
_NEWS = f"""SELECT page_id, CASE
    WHEN NOT regexp_matches(url, 'https?://') OR NOT starts_with(path, '/') THEN false
    WHEN len(c) > 0 AND file_type <> '' AND NOT known THEN false
    WHEN list_contains({_list(dims.BAD_DOMAINS)}, domain) THEN false
    WHEN (dashes > 4 OR bars > 4) AND NOT list_contains(list_transform(CASE WHEN dashes >= bars THEN string_split(slug, '-') ELSE string_split(slug, '_') END, lambda x: lower(x)), domain) THEN true
    WHEN len(d) <= 1 THEN false
    WHEN list_has_any(d, {_list(dims.BAD_CHUNKS)}) OR list_contains({_list(dims.BAD_CHUNKS)}, subdomain) THEN false
    WHEN regexp_matches(url, '{urls._DATE}') THEN true
    WHEN len(d) <= 3 AND regexp_matches(slug, '[0-9]{{3,}}$') THEN true
    WHEN len(d) = 3 AND regexp_matches(d[2], '[0-9]{{3,}}$') THEN true
    WHEN list_has_any(list_transform(d, lambda x: lower(x)), {_list(dims.GOOD_PATHS)}) THEN true
    ELSE file_type <> '' AND known END AS valid
  FROM (SELECT *, coalesce(d[-1], '') AS slug, length(coalesce(d[-1], '')) - length(replace(coalesce(d[-1], ''), '-', '')) AS dashes, length(coalesce(d[-1], '')) - length(replace(coalesce(d[-1], ''), '_', '')) AS bars,
    list_contains({_list(dims.ARTICLE_TYPES)}, file_type) AS known
  FROM (SELECT *, list_filter(list_concat(c[:-2], CASE WHEN len(c) > 0 THEN [CASE WHEN contains(c[-1], '.') THEN string_split(c[-1], '.')[-2] ELSE c[-1] END] ELSE [] END), lambda x: x <> 'index') AS d FROM p))"""

ORACLES = {
    "url_parts": f"WITH {_PARTS} SELECT page_id, scheme, host, port, path, raw_query, fragment, file_type, subdomain, domain, tld FROM p",
    "url_clean": _clean_sql(),
    "url_prepare": f"""WITH r AS (SELECT page_id, unnest(range(5)) AS form, unnest([
      regexp_extract(url, '^[a-z]+://[^/?#]*') || '/a/b?utm_source=x&q=1',
      regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_extract(p, '^(.*/)', 1) || 'c.html#top',
      regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_extract(regexp_extract(p, '^(.*)/', 1), '^(.*/)', 1) || 'up/',
      regexp_extract(url, '^[a-z]+:') || '//cdn.example.org/x//y', 'https://go.example.com/z']) AS url FROM (SELECT *, regexp_extract(url, '{_P}', 3) AS p FROM pages)),
      k AS (SELECT page_id * 5 + form AS page_id, page_id AS id, form, url FROM r)
      SELECT k.id AS page_id, CAST(form AS INTEGER) AS form, clean AS prepared FROM k JOIN {_clean_sql("k")} USING (page_id)""",
    "url_likely_article": f"WITH {_PARTS} SELECT page_id, url, {_LIKELY} AS likely, scheme <> '' AND host <> '' AS absolute, {_any('lower(url)', dims.ASSETS)} AS asset, coalesce(string_split(host, '.')[-2], '') AS naive_domain FROM p",
    "url_valid_category": f"""WITH {_PARTS}, k AS (SELECT *, list_filter(c, lambda x: x <> 'index.html') AS k FROM p) SELECT page_id, coalesce(raw_query = '' AND fragment = '' AND len(k) IN (1, 2) AND scheme IN ('http', 'https', '') AND NOT starts_with(array_to_string(k, '/'), '_') AND
      CASE WHEN len(k) = 2 THEN list_contains({_list(dims.CATEGORY_PREFIXES)}, k[1]) ELSE strlen(k[1]) BETWEEN 2 AND 19 END, false) AS valid,
      NOT list_has_any(list_concat(c, string_split(subdomain, '.')), {_list(sorted(dims.URL_STOPWORDS))}) AS no_stop FROM k""",
    "url_valid_news": f"WITH {_PARTS} {_NEWS}",
    "url_chunks": f"SELECT page_id, CAST(unnest(range(len(c))) AS INTEGER) AS pos, unnest(c) AS chunk FROM (SELECT page_id, {_CHUNKS} AS c FROM pages)",
    "feed_candidates": f"WITH s AS (SELECT DISTINCT lower(regexp_extract(url, '{_P}', 1)) || '://' || {_HOST} AS url FROM pages) SELECT url, url || unnest({_list(dims.FEED_SUFFIXES)}) AS feed FROM s",
    "host_article_counts": f"WITH {_PARTS} SELECT host, count(*) AS pages, count(*) FILTER (WHERE {_LIKELY}) AS articles FROM p GROUP BY host",
    "unique_urls": f"SELECT page_id, clean FROM (SELECT page_id, clean, row_number() OVER (PARTITION BY clean ORDER BY page_id) AS r FROM {_clean_sql()}) WHERE r = 1",
    "unique_ci": "WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[^\\p{L}]+'), lambda x: x <> '') AS w FROM conversations), e AS (SELECT conv_id, turn, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS word FROM w) SELECT conv_id, turn, pos, word FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(word) ORDER BY pos) AS r FROM e) WHERE r = 1",
}
