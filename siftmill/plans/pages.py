"""Queries over whole pages, with SQL where the tree can be read off the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftmill.functions import nlp, urls
from siftmill.operators import article, source
from siftmill.plans import text as texts
from siftmill.plans import web
from siftmill.sources.shared import spread


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = article.facts(_pages(spark, sf_dir), only=["title_tag", "h1", "meta_title", "meta_lang"])
    return f.select("page_id", article.title(F.col("title_tag"), F.col("h1"), F.col("meta_title"), F.col("meta_lang")).alias("title"), article.h1_title(F.col("h1")).alias("h1"))


def page_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.facts(_pages(spark, sf_dir), only=["meta_lang"]).select("page_id", "meta_lang")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors in order; of neighbours with one href the first."""
    f = article.facts(_pages(spark, sf_dir), only=["links"]).select("page_id", F.posexplode("links").alias("pos", "l"))
    before = F.lag("l.href").over(Window.partitionBy("page_id").orderBy("pos"))
    return f.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("l.href"))).select("page_id", "pos", F.col("l.href").alias("href"), F.col("l.text").alias("text"))


def page_links_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = article.facts(_pages(spark, sf_dir), only=["links"]).select("page_id", F.explode("links").alias("l"))
    return f.groupBy("page_id").agg(F.count_distinct("l.href").alias("n_links"))


def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of each tag a page has; b is left to the tests, as parsing opens it again."""
    n = article.nodes(_pages(spark, sf_dir)).where("tag <> 'b'")
    return n.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def page_sibling_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with one of the same tag among the three siblings before them: a window over the tree's rows."""
    n = article.nodes(_pages(spark, sf_dir))
    before = F.collect_list("tag").over(Window.partitionBy("page_id", "parent_id").orderBy("sib_idx").rowsBetween(-3, -1))
    return n.withColumn("before", before).where(F.array_contains("before", F.col("tag"))).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def page_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every page: title, language, words, length and the five top keywords."""
    a = article.articles(_pages(spark, sf_dir), only=["title", "language", "text", "keywords"])
    return a.select("page_id", "url", "title", "language", F.size(nlp.words(F.col("text"))).alias("n_words"), F.length("text").alias("n_chars"), F.array_join(F.slice("keywords", 1, 5), " ").alias("keywords"))


def article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.facts(_pages(spark, sf_dir), only=["text", "top_tag"]).select("page_id", "text", "top_tag")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.articles(_pages(spark, sf_dir)).drop("meta_data", "keyword_scores", "tags", "links")


def article_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.to_json(article.articles(_pages(spark, sf_dir), only=article.SHORT))


def article_full_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.to_json(article.articles(_pages(spark, sf_dir), only=article.FULL), full=True)


def article_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article.to_text(article.articles(_pages(spark, sf_dir)))


def page_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.page_categories(article.facts(_pages(spark, sf_dir), only=["links", "html"]))


def _homes(pages: DataFrame) -> DataFrame:
    """(source_url, body): every host as a source; its first page stands for its home."""
    home = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host(F.col("url")), F.lit("/"))
    return pages.groupBy(home.alias("source_url")).agg(F.min_by("html", "page_id").alias("body"))


def source_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.categories(_homes(_pages(spark, sf_dir)).withColumnRenamed("body", "html"))


def source_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article candidates of every host: pages with an even page_id come by a feed, the others by a link of a category page."""
    root = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host(F.col("url")), F.lit("/"))
    pages = _pages(spark, sf_dir).select("page_id", root.alias("source_url"), F.col("url").alias("address"), F.replace("url", F.lit("&"), F.lit("&amp;")).alias("x"))
    feeds = pages.where("page_id % 2 = 0").select("source_url", F.concat("source_url", F.lit("rss")).alias("url"), F.format_string("<rss><channel><item><title>an item</title><link>%s</link></item></channel></rss>", "x").alias("rss"))
    listed = pages.where("page_id % 2 = 1").select("source_url", F.concat("source_url", F.lit("all")).alias("url"), F.format_string('<a href="%s">page %d</a>', "x", "page_id").alias("html"))
    return source.candidates(source.feed_articles(feeds), source.category_articles(listed))


QUERIES = {
    "page_digest": page_digest,
    "page_title": page_title,
    "page_lang": page_lang,
    "page_links": page_links,
    "page_links_distinct": page_links_distinct,
    "page_tags": page_tags,
    "page_sibling_runs": page_sibling_runs,
    "article_text": article_text,
    "articles": articles,
    "article_json": article_json,
    "article_full_json": article_full_json,
    "article_report": article_report,
    "page_categories": page_categories,
    "source_categories": source_categories,
    "source_candidates": source_candidates,
}

_BODY = r"regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_PLAIN = "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\f\\r]+', ' ', 'g'))"
_H1 = _PLAIN.replace("{x}", "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")
_TITLE = _PLAIN.replace("{x}", "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
_ANCHORS = f"""a AS (SELECT page_id, unnest(regexp_extract_all(b, '(?s)<a href="[^"]*">.*?</a>')) AS a, CAST(unnest(range(len(regexp_extract_all(b, '(?s)<a href="[^"]*">.*?</a>')))) AS INTEGER) AS pos FROM (SELECT page_id, {_BODY} AS b FROM pages)),
  l AS (SELECT page_id, pos, replace(regexp_extract(a, 'href="([^"]*)"', 1), '&amp;', '&') AS href, {_PLAIN.replace("{x}", "a")} AS text FROM a)"""

ORACLES = {
    "page_title": f"SELECT page_id, {_TITLE} AS title, CASE WHEN len(list_filter(string_split({_H1}, ' '), lambda x: x <> '')) <= 2 THEN '' ELSE {_H1} END AS h1 FROM pages",
    "page_lang": "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS meta_lang FROM pages",
    "page_links": f"WITH {_ANCHORS} SELECT page_id, pos, href, text FROM (SELECT *, lag(href) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM l) WHERE before IS NULL OR before <> href",
    "page_links_distinct": f"WITH {_ANCHORS} SELECT page_id, count(DISTINCT href) AS n_links FROM l GROUP BY page_id",
    "page_tags": f"WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) AS tag FROM (SELECT page_id, {_BODY} AS html FROM pages) UNION ALL SELECT page_id, unnest(regexp_extract_all(html, '<(script|style)[ >]', 1)) FROM pages) SELECT page_id, tag, count(*) AS n FROM t WHERE tag <> 'b' GROUP BY ALL",
    # hrefs of these pages are a slash and one word
    "source_categories": f"""WITH h AS (SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' AS source_url, arg_min(html, page_id) AS html FROM pages GROUP BY 1),
      a AS (SELECT source_url, unnest(regexp_extract_all({_BODY}, '<a href="/([^"]*)">', 1)) AS w FROM h)
      SELECT DISTINCT source_url, source_url || replace(w, '&amp;', '&') AS url FROM a WHERE strlen(replace(w, '&amp;', '&')) BETWEEN 2 AND 19 AND NOT starts_with(w, '_') AND NOT regexp_matches(w, '[?#/]')""",
}


def _plain(x: str) -> str:
    return _PLAIN.replace("{x}", x)


def _stops(x: str) -> str:
    """How many tokens of a text are stop words of the row's language."""
    return f"len(list_filter(regexp_extract_all(lower({x}), '{nlp.TOKEN}'), lambda t: list_contains(words, t)))"


# The gravity of these pages: a nav, an ad and one article with a heading and paragraphs, none of which has a link. Its p elements,
# the article and (where there are few of them) the ad count their stop words, with the boosts for neighbours, for the article and
# the body above them; the higher one is the page's body, and the page itself where nothing counts.
_BODIES = f"""{texts._stop_sql()}, lists AS (SELECT lang, list(token) AS words FROM stop GROUP BY lang),
h AS (SELECT page_id, url, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, {_TITLE} AS title, replace(replace({_BODY}, '&copy;', '©'), '&middot;', '·') AS b FROM pages),
e AS (SELECT h.*, words, regexp_extract(b, '(?s)<article>(.*?)</article>', 1) AS a, {_plain("regexp_extract(b, '(?s)<div class=\"ad\">(.*?)</div>', 1)")} AS ad FROM h JOIN lists USING (lang)),
p0 AS (SELECT page_id, words, unnest(p) AS p, unnest(range(len(p))) AS i, len(p) AS n_p FROM (SELECT page_id, words, string_split(regexp_replace(a, '(?s)^<h1>.*?</h1>', ''), '<p>')[2:] AS p FROM e)),
p1 AS (SELECT page_id, i, n_p, {_stops(_plain("p"))} AS stop FROM p0),
p2 AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) > 5 AS boosted FROM p1),
p3 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS place, sum(CASE WHEN boosted THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS k FROM p2 WHERE stop > 2),
totals AS (SELECT page_id, sum(stop) AS inside, max(n_p) AS n_p, count(*) FILTER (WHERE stop > 2) AS kept FROM p1 GROUP BY page_id),
a1 AS (SELECT e.*, coalesce(n_p, 0) AS n_p, coalesce(kept, 0) AS kept, {_stops(_plain("a"))} AS a_total, {_stops(_plain("a"))} - coalesce(inside, 0) AS a_stop, CASE WHEN coalesce(n_p, 0) + 1 < 5 THEN {_stops("ad")} ELSE 0 END AS ad_stop FROM e LEFT JOIN totals USING (page_id)),
a2 AS (SELECT *, kept + CASE WHEN a_total > 2 THEN 1 ELSE 0 END + CASE WHEN ad_stop > 2 THEN 1 ELSE 0 END AS n FROM a1),
g AS (SELECT page_id, CASE WHEN n > 15 AND n - place <= 0.25 * n THEN CASE WHEN pow(0.25 * n - (n - place), 2) > 40 THEN 5 ELSE -pow(0.25 * n - (n - place), 2) END WHEN boosted THEN 30.0 / k ELSE 0 END + stop AS up FROM p3 JOIN (SELECT page_id, n FROM a2) USING (page_id)),
w AS (SELECT page_id, sum(up) AS up FROM g GROUP BY page_id),
late AS (SELECT *, CASE WHEN n > 15 AND n - place <= 0.25 * n THEN CASE WHEN pow(0.25 * n - (n - place), 2) > 40 THEN 5 ELSE -pow(0.25 * n - (n - place), 2) END ELSE 0 END AS boost FROM (SELECT page_id, n, unnest([n - 1, n - 2]) AS place, unnest(['a', 'ad']) AS what FROM a2)),
tops AS (SELECT a2.*, CASE WHEN w.up > 0.4 * w.up + CASE WHEN a_total > 2 THEN a_stop + (SELECT max(boost) FROM late WHERE late.page_id = a2.page_id AND what = 'a') ELSE 0 END + CASE WHEN ad_stop > 2 THEN ad_stop + (SELECT max(boost) FROM late WHERE late.page_id = a2.page_id AND what = 'ad') ELSE 0 END THEN 'article' ELSE 'body' END AS top_tag FROM a2 LEFT JOIN w USING (page_id)),
bodies AS (SELECT page_id, url, lang, title, top_tag, CASE top_tag WHEN 'article' THEN {_plain("a")} ELSE {_plain("regexp_replace(regexp_extract(b, '(?s)<body>(.*)</body>', 1), '(?s)<nav>.*?</nav>', '', 'g')")} END AS text FROM tops)"""

# keywords and summary of the bodies by the SQL of documents, which a query of that name hides
_KEYWORDS = f"""documents AS (SELECT page_id AS doc_id, lang, title, text FROM bodies), {texts._keywords_sql(nlp.MAX_KEYWORDS).removeprefix(texts._stop_sql() + ", ")},
c AS (SELECT doc_id, lang, lower(regexp_replace(token, '[^A-Za-z]', '', 'g')) AS keyword, max(score) AS score FROM kw GROUP BY ALL),
f AS (SELECT doc_id, keyword, score FROM c ANTI JOIN stop ON stop.lang = c.lang AND stop.token = c.keyword WHERE length(keyword) > 3 AND keyword <> 'unk'),
hw AS (SELECT DISTINCT doc_id, keyword FROM (SELECT doc_id, lang, regexp_replace(unnest(regexp_split_to_array(lower(title), '[ \\t\\n\\f\\r]+')), '[^a-z]', '', 'g') AS keyword FROM documents) x ANTI JOIN stop ON stop.lang = x.lang AND stop.token = x.keyword WHERE length(keyword) >= 3 AND doc_id IN (SELECT doc_id FROM f)),
scored_kw AS (SELECT doc_id, keyword, CASE WHEN f.score IS NULL THEN 0.1 WHEN hw.keyword IS NOT NULL THEN f.score * 1.5 ELSE f.score END AS score FROM f FULL JOIN hw USING (doc_id, keyword)),
ranked_kw AS (SELECT doc_id, keyword, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, keyword) AS r FROM scored_kw),
words AS (SELECT doc_id, string_agg(keyword, ' ' ORDER BY r) FILTER (WHERE r <= 5) AS five, string_agg(keyword, ' ' ORDER BY r) FILTER (WHERE r <= {nlp.MAX_KEYWORDS}) AS all_words FROM ranked_kw GROUP BY doc_id)"""

ORACLES["article_text"] = f"WITH {_BODIES} SELECT page_id, text, top_tag FROM bodies"
ORACLES["page_digest"] = f"""WITH {_BODIES}, {_KEYWORDS} SELECT page_id, url, title, lang AS language, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\f\\r]+'), lambda x: x <> '')) AS INTEGER) AS n_words,
  CAST(length(text) AS INTEGER) AS n_chars, coalesce(five, '') AS keywords FROM bodies LEFT JOIN words ON page_id = doc_id"""

_SOURCE = f"lower(regexp_extract(url, '{web._P}', 1)) || '://' || {web._HOST} || '/'"
# none of these pages has an absolute link or an address in quotes, so the root is their only category
ORACLES["page_categories"] = f"SELECT page_id, {_SOURCE} AS category FROM pages"
ORACLES["source_candidates"] = f"""WITH s AS (SELECT page_id, {_SOURCE} AS source_url FROM pages), cleaned AS (SELECT page_id, clean AS url FROM {web._clean_sql()}), {web._PARTS.replace("FROM pages", "FROM cleaned")},
  found AS (SELECT source_url, p.url, min(CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END) AS n, min(CASE WHEN page_id % 2 = 1 THEN 'page ' || page_id END) AS text FROM p JOIN s USING (page_id) WHERE {web._LIKELY.replace("url", "p.url")} GROUP BY source_url, p.url),
  ranked AS (SELECT source_url, url, CASE WHEN n = 0 THEN '' ELSE text END AS title, CAST(row_number() OVER (PARTITION BY source_url ORDER BY n, url) AS INTEGER) AS rank FROM found)
  SELECT * FROM ranked WHERE rank <= 1000"""

_SUMMARIES = f"""sums AS (WITH documents AS (SELECT page_id AS doc_id, lang, title, text FROM bodies), {texts._SCORES_SQL.removeprefix(texts._stop_sql() + ", ").replace("string_split(text, chr(10))[1] AS title", "title")}
  SELECT doc_id, string_agg(sentence, ' ' ORDER BY idx) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS r FROM scored JOIN base USING (doc_id) WHERE length(title) > 0) WHERE r <= {nlp.MAX_SENTENCES} GROUP BY doc_id)"""
# these pages name no authors, dates, images or description
ORACLES["article_report"] = f"""WITH {_BODIES}, {_KEYWORDS}, {_SUMMARIES}
  SELECT page_id, 'Article Title: ' || title || chr(10) || 'URL: ' || url || chr(10) || 'Authors: []' || chr(10) || 'Publish Date: <nil>' || chr(10) || 'Top Image: ' || chr(10) || 'Meta Description: ' || chr(10)
    || 'Keywords: [' || coalesce(all_words, '') || ']' || chr(10) || 'Summary: ' || coalesce(summary, '') || chr(10) || 'Text: ' || text AS out
  FROM bodies LEFT JOIN words ON words.doc_id = page_id LEFT JOIN sums ON sums.doc_id = page_id"""
# repeated siblings are the items of the one list and the paragraphs of the one article
ORACLES["page_sibling_runs"] = f"""WITH c AS (SELECT page_id, {_BODY} AS b FROM pages), n AS (SELECT page_id, unnest(['li', 'p']) AS tag, unnest([len(regexp_extract_all(b, '<li>')), len(regexp_extract_all(b, '<p>'))]) - 1 AS n FROM c)
  SELECT page_id, tag, CAST(n AS BIGINT) AS n FROM n WHERE n > 0"""
