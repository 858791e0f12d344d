"""Home pages to article candidates.

The web is a table web(url, status, body): a fetcher fills it (``siftmill.sources``), or it
is what is at hand. Downloads are joins with it; links, feeds and limits are relational.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions import dom, urls
from siftmill.functions.dims import FEED_SUFFIXES
from siftmill.sources.shared import cut


@dataclass(frozen=True)
class BuildOptions:
    only_homepage: bool = False
    limit_categories: int = 100
    limit_articles: int = 1000
    max_feeds: int = 100
    same_domain: bool = True
    allow_subdomain: bool = True
    shuffle_seed: int | None = None


def _domain(of: DataFrame, url: str, name: str) -> DataFrame:
    parts = urls.suffix_parts(urls.load_suffixes(of.sparkSession))
    return of.withColumn("_p", parts(urls.host(F.col(url)))).withColumn(name, F.col("_p.domain")).drop("_p")


def downloaded(of: DataFrame, web: DataFrame, url: str = "url", least_error: int = 400) -> DataFrame:
    """of with ``html``: the body of its address; rows whose download failed go."""
    good = web.where(F.col("status") < least_error).select(F.col("url").alias("_u"), F.col("body").alias("html"))
    return of.join(good, F.col(url) == F.col("_u")).drop("_u")


def links(of: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., pos, href, text, kind): anchors and feed links of the html of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *k, page in batch[[*keys, "html"]].itertuples(index=False):
                doc = dom.parse(page)
                found = [("a", n.get("href"), dom.text(n)) for n in doc.find("a") if n.get("href") not in ("", "/", "#")]
                found += [("feed", n.get("href"), "") for n in doc.find("link") if n.get("type") in ("application/rss+xml", "application/atom+xml") and n.get("href")]
                out += [(*k, i, href, text, kind) for i, (kind, href, text) in enumerate(found)]
            yield pd.DataFrame(out, columns=[*keys, "pos", "href", "text", "kind"])

    kinds = dict(of.dtypes)
    ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", pos int, href string, text string, kind string"
    return of.select(*keys, "html").mapInPandas(run, ddl)


def categories(homes: DataFrame, options: BuildOptions | None = None) -> DataFrame:
    """(source_url, url): category addresses on the home pages homes(source_url, html), of the same domain."""
    options = options or BuildOptions()
    if options.only_homepage:
        return homes.select("source_url", F.col("source_url").alias("url"))
    found = links(homes, ["source_url"]).where("kind = 'a'").withColumn("url", urls.prepare(F.col("href"), F.col("source_url")))
    found = _domain(urls.parsed(found, "url"), "source_url", "home")
    good = found.where(urls.valid_category(F.col("u"), F.col("url")) & (F.col("url") != F.col("source_url")) & (F.col("u.domain") == F.col("home")))
    first = good.groupBy("source_url", "url").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("source_url").orderBy("pos"))
    return first.withColumn("r", rank).where(F.col("r") <= options.limit_categories).select("source_url", "url")


def page_categories(facts: DataFrame, compat: bool = False) -> DataFrame:
    """(page_id, category): category links of pages, without stop chunks, and the root; each once, in order within a page.

    Pages (page_id, url, links, html) without any take addresses in quotes anywhere in their html (``compat``: see ``other_links``). Rows that
    share a page_id are one page; a null page_id has no rows.
    """
    pages = facts.where("page_id IS NOT NULL").select("page_id", F.col("url").alias("base"), "links", "html")
    each = pages.select("page_id", "base", F.explode("links").alias("l")).select("page_id", "base", F.col("l.href").alias("href"))
    p = urls.parsed(each, "href")
    good = p.where(urls.valid_category(F.col("u"), F.col("href")) & urls.no_stop_chunk(F.col("u"))).select("page_id", "base", "href")
    lacking = pages.join(good.select("page_id").distinct(), "page_id", "left_anti")
    other = urls.parsed(other_links(lacking, compat), "href").where(urls.valid_category(F.col("u"), F.col("href")) & urls.no_stop_chunk(F.col("u"))).select("page_id", "base", "href")
    roots = pages.select("page_id", "base", F.lit("/").alias("href"))
    both = good.unionByName(other).unionByName(roots)
    both = both.withColumn("category", F.when(F.col("base") == "", F.col("href")).otherwise(urls.prepare(F.col("href"), F.col("base"))))
    lists = both.groupBy("page_id").agg(F.sort_array(F.collect_set("category")).alias("c"))
    return lists.select("page_id", F.explode("c").alias("category"))


def other_links(pages: DataFrame, compat: bool = False) -> DataFrame:
    """(page_id, base, href): addresses in quotes anywhere in pages (page_id, base, html), of the page's own brand, no assets, one or two chunks.

    Slashes may be escaped as in JSON; with ``compat`` those after the scheme may not.
    """
    pattern = r'"(https?://[^"]*)"' if compat else r'"(https?:(?:\\?/){2}[^"]*)"'
    found = pages.select("page_id", "base", F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("x")).withColumn("href", F.replace("x", F.lit("\\/"), F.lit("/")))
    size = F.size(urls.chunks(urls.path(F.col("href"))))
    return found.where((urls.naive_domain(F.col("href")) == urls.naive_domain(F.col("base"))) & ~urls.is_asset(F.col("href")) & size.between(1, 2)).select("page_id", "base", "href").distinct()


def feed_urls(homes: DataFrame, cats: DataFrame, options: BuildOptions | None = None) -> DataFrame:
    """(source_url, url): common feed addresses of sources and of categories whose last chunk has no dot."""
    options = options or BuildOptions()
    plain = cats.where(~F.contains(F.coalesce(F.try_element_at(urls.chunks(urls.path(F.col("url"))), F.lit(-1)), F.lit("")), F.lit("."))).withColumn("n", F.lit(1))
    bases = homes.select("source_url", F.col("source_url").alias("url"), F.lit(0).alias("n")).unionByName(plain)
    medium = F.when(F.contains(urls.host(F.col("url")), F.lit("medium.com")), F.array(F.concat(F.regexp_extract("url", "^([a-z]+://[^/]+)", 1), F.lit("/feed"), urls.path(F.col("url")))))
    ends = F.transform(F.array(*[F.lit(x) for x in FEED_SUFFIXES]), lambda e: F.concat(F.regexp_replace("url", "/+$", ""), e))
    each = bases.select("source_url", "n", "url", F.posexplode(F.concat(F.coalesce(medium, F.array().cast("array<string>")), ends)).alias("pos", "feed"))
    rank = F.row_number().over(Window.partitionBy("source_url").orderBy("n", "url", "pos"))
    first = each.groupBy("source_url", "feed").agg(F.min("n").alias("n"), F.min("url").alias("url"), F.min("pos").alias("pos"))
    return first.withColumn("r", rank).where(F.col("r") <= options.max_feeds).select("source_url", F.col("feed").alias("url"))


def linked_feeds(cat_pages: DataFrame) -> DataFrame:
    """(source_url, url): feeds that category pages (source_url, url, html) link to."""
    found = links(cat_pages.withColumnRenamed("url", "page"), ["source_url", "page"]).where("kind = 'feed'").withColumn("url", urls.prepare(F.col("href"), F.col("page")))
    found = urls.parsed(_domain(found, "source_url", "home"), "url")
    return found.where(urls.valid_category(F.col("u"), F.col("url")) & (F.col("home") == F.col("u.domain"))).select("source_url", "url").distinct()


_URL = re.compile(r"https?://[^\s<>\"']+")


_ITEM = re.compile(r"<(item|entry)\b[^>]*>(.*?)</\1>", re.S | re.I)
_INNER = re.compile(r"<(link|guid)\b[^>]*>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*</\1>", re.S | re.I)


def _loose_items(body: str) -> list[str]:
    """The same from a feed that is no XML, read as HTML."""
    out = []
    for m in _ITEM.finditer(body):
        inner = {k.lower(): v for k, v in reversed(_INNER.findall(m[2]))}
        item = dom.parse(m[2])
        tries = [inner.get("link", ""), *[n.get("href") for n in item.find("link")][:1], inner.get("guid", ""), *[n.get("url") for n in item.find("enclosure")][:1], *[n.get("href") for n in item.find("link")], *_URL.findall(m[2])[:1]]
        found = next((html.unescape(t).strip() for t in tries if t.strip()), None)
        if found:
            out.append(found)
    return out


def feed_items(body: str | None) -> list[str]:
    """Addresses of the items of an RSS or Atom feed: link text, link href, guid, enclosure, or any address in the item."""
    try:
        root = ET.fromstring((body or "").strip())
    except (ET.ParseError, ValueError):
        return _loose_items(body or "")
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    out = []
    for item in root.iter():
        if local(item) not in ("item", "entry"):
            continue
        parts = {}
        for e in item:
            parts.setdefault(local(e), e)
        tries = [parts[k].text or "" if k in parts else "" for k in ("link",)] + [parts["link"].get("href", "") if "link" in parts else "", parts["guid"].text or "" if "guid" in parts else ""]
        tries += [parts["enclosure"].get("url", "") if "enclosure" in parts else "", *[m for m in _URL.findall(" ".join(item.itertext()))[:1]]]
        found = next((t.strip() for t in tries if t and t.strip()), None)
        if found:
            out.append(found)
    return out


def feed_articles(feeds: DataFrame) -> DataFrame:
    """(source_url, url, pos): likely articles of feeds(source_url, url, rss), of the source's domain."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, u, i, x) for s, u, rss in batch[["source_url", "url", "rss"]].itertuples(index=False) for i, x in enumerate(feed_items(rss))]
            yield pd.DataFrame(rows, columns=["source_url", "feed", "pos", "href"])

    found = feeds.mapInPandas(run, "source_url string, feed string, pos int, href string").withColumn("url", urls.prepare(F.col("href"), F.col("source_url")))
    found = _domain(_domain(found, "source_url", "home"), "url", "there")
    return found.where(urls.likely_article(F.col("url")) & (F.col("home") == F.col("there")) & (F.col("url") != F.col("feed"))).select("source_url", "url", "pos")


def category_articles(cat_pages: DataFrame) -> DataFrame:
    """(source_url, url, title, pos): likely articles that category pages (source_url, url, html) link to."""
    found = links(cat_pages.withColumnRenamed("url", "page"), ["source_url", "page"]).where("kind = 'a'").withColumn("url", urls.prepare(F.col("href"), F.col("page")))
    found = _domain(_domain(found, "source_url", "home"), "url", "there")
    good = urls.likely_article(F.col("url")) & (F.col("url") != F.col("source_url")) & (F.col("url") != F.col("page")) & (F.col("home") == F.col("there"))
    return found.where(good).select("source_url", "url", F.col("text").alias("title"), "pos")


def candidates(from_feeds: DataFrame, from_categories: DataFrame, options: BuildOptions | None = None) -> DataFrame:
    """(source_url, url, title): the union, feeds first, unique by address, within the limit for each source (0: none)."""
    options = options or BuildOptions()
    both = from_feeds.select("source_url", "url", F.lit("").alias("title"), F.lit(0).alias("n"), "pos").unionByName(from_categories.select("source_url", "url", "title", F.lit(1).alias("n"), "pos"))
    first = both.groupBy("source_url", "url").agg(F.min(F.struct("n", "pos", "title")).alias("x"))
    if options.same_domain and not options.allow_subdomain:
        parts = urls.suffix_parts(urls.load_suffixes(first.sparkSession))
        first = first.where(parts(urls.host(F.col("url")))["subdomain"] == parts(urls.host(F.col("source_url")))["subdomain"])
    order: list[Column] = [F.xxhash64(F.lit(options.shuffle_seed), "url")] if options.shuffle_seed is not None else [F.col("x.n"), F.col("x.pos"), F.col("url")]
    rank = F.row_number().over(Window.partitionBy("source_url").orderBy(*order))
    ranked = first.withColumn("rank", rank)
    if options.limit_articles:
        ranked = ranked.where(F.col("rank") <= options.limit_articles)
    return ranked.select("source_url", "url", F.col("x.title").alias("title"), "rank")


def build(sources: DataFrame, web: DataFrame, options: BuildOptions | None = None) -> DataFrame:
    """Article candidates of sources(source_url) on web(url, status, body): home, categories, feeds, union.

    Tasks are the workers of downloads; failed ones are dropped.
    """
    options = options or BuildOptions()
    # what a download or a parse brought is used several times: computed once
    homes = cut(downloaded(sources.withColumn("url", F.col("source_url")), web).drop("url"))
    cats = cut(categories(homes, options))
    cat_pages = cut(downloaded(cats, web))
    probed = downloaded(feed_urls(homes, cats, options), web, least_error=300).withColumnRenamed("html", "rss")
    linked = downloaded(linked_feeds(cat_pages), web, least_error=300).withColumnRenamed("html", "rss")
    feeds = probed.unionByName(linked).dropDuplicates(["source_url", "url"])
    return candidates(feed_articles(feeds), category_articles(cat_pages), options)


def described(homes: DataFrame) -> DataFrame:
    """(source_url, brand, description) of home pages (source_url, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, dom.meta_field(dom.parse(h), "description")) for s, h in batch[["source_url", "html"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["source_url", "description"])

    found = homes.select("source_url", "html").mapInPandas(run, "source_url string, description string")
    return _domain(found, "source_url", "brand")
