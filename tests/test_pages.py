import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from siftmill.functions import dom, urls
from siftmill.operators import article, source
from siftmill.sources import fetch
from siftmill.streaming import pages as streams

PARAGRAPH = "It was in the morning that the workers came to the harbour, and they had been on the road for most of the night. "
PAGE = f"""<!doctype html><html dir='ltr' lang='en'><head data-x='1'><title>Harbour Workers Start New Shift Today</title>
<meta property='og:title' content='Harbour Workers Start New Shift Today'><meta name='description' content='A report from the docks'>
<meta property='og:image' content='/img/lead.png'><meta name='author' content='Ann Example'><meta name='author' content='Bob Sample'>
<meta property='article:published_time' content='2024-03-02T08:00:00Z'><meta name='keywords' content='harbour, , work'>
<meta property='og:site_name' content='Docks Daily'><link rel='icon' href='/fav.ico'><link rel='canonical' href='/news/harbour'>
<script type='application/ld+json'>{{"@type": "NewsArticle", "author": {{"name": ["Cleo Third"]}}, "datePublished": "2024-03-01"}}</script>
<script type='application/ld+json'>{{"@graph": [{{"@type": "Person", "name": "Dan Fourth"}}, {{"@type": "VideoObject", "contentUrl": "https://cdn.example.org/v.mp4"}}]}}</script>
<script>var broken = "</p><p>";</script></head><body id="top"><header id="h"><nav><a href='/sport'>Sport</a><a href='/sport'>Sport</a><a href='/about'>About</a></nav></header>
<h1>Harbour Workers Start New Shift Today</h1><h1>Other</h1>
<article><img src='https://cdn.example.org/a.jpg'><img data-src='b.jpg'><img src='data:image/gif;base64,xx'><p class='byline'>By Eve Fifth and Fay Sixth | Reuters</p>
<p>{PARAGRAPH}</p><p>{PARAGRAPH} <b>Mail desk@docks.example.com or see report.pdf.<p>{PARAGRAPH}</b></p><em>gone</em><div class='comment-box'>drop me</div></article>
<iframe src='https://www.youtube.com/embed/1'></iframe><iframe src='https://ads.example.com/x'></iframe><video src='v.webm'></video><a href='/files/report.pdf'>pdf</a></body></html>"""


@pytest.fixture(scope="module")
def made(spark):
    pages = spark.createDataFrame([(1, "https://docks.example.com/2024/03/02/harbour", PAGE), (2, "", ""), (3, None, None)], "page_id long, url string, html string")
    return {r["page_id"]: r for r in article.articles(pages).collect()}


def test_article(made):
    a = made[1]
    assert a["title"] == "Harbour Workers Start New Shift Today" and a["language"] == "en" and a["meta_lang"] == "en"
    assert a["authors"] == ["Cleo Third", "Dan Fourth", "Ann Example", "Bob Sample", "Eve Fifth", "Fay Sixth"]
    assert a["meta_description"] == "A report from the docks" and a["meta_keywords"] == ["harbour", "work"] and a["meta_site_name"] == "Docks Daily"
    assert a["publish_date"].replace(tzinfo=timezone.utc).astimezone(timezone.utc).strftime("%Y-%m-%d") == "2024-03-02"
    assert a["canonical_link"] == "https://docks.example.com/news/harbour" and a["meta_img"] == "https://docks.example.com/img/lead.png" and a["meta_favicon"] == "/fav.ico"
    assert a["images"] == ["https://cdn.example.org/a.jpg", "https://docks.example.com/2024/03/02/b.jpg"] and a["top_image"] == "https://cdn.example.org/a.jpg"
    assert a["movies"] == ["https://docks.example.com/2024/03/02/v.webm", "https://www.youtube.com/embed/1", "https://cdn.example.org/v.mp4"]
    assert a["text"].count("It was in the morning") == 3 and "drop me" not in a["text"] and "gone" not in a["text"] and "Eve" not in a["text"]
    assert a["emails"] == ["desk@docks.example.com"] and a["files"] == ["/files/report.pdf"] and "docks.example.com" in a["domains"]
    assert a["keywords"] and all(len(k) >= 3 for k in a["keywords"]) and "harbour" in a["keywords"] and set(a["keywords"]) <= set(a["keyword_scores"])
    assert a["summary"] and len(a["summary"]) < len(a["text"]) and a["download_state"] == 2 and a["likely_article"]


def test_empty_pages(made):
    for i in (2, 3):
        assert made[i]["title"] == "" and made[i]["text"] == "" and made[i]["authors"] == [] and made[i]["keywords"] == [] and made[i]["publish_date"] is None
    assert (made[2]["is_parsed"], made[2]["download_state"]) == (True, 2) and (made[3]["is_parsed"], made[3]["download_state"]) == (False, 0)


def test_no_page_ends_the_job(spark):
    """Deep nesting, lone surrogates, dates out of range, a comment and tags that don't end."""
    deep = [f"<body><{t}>" * 3000 + f"<p>{PARAGRAPH}</p>" for t in ("div", "span", "section", "b", "blockquote")]
    odd = [
        '<script type="application/ld+json">{"author": "\\ud800 Ann Lee", "datePublished": "0001-01-01T00:00:00+14:00"}</script><p>x &#xD800; y</p>',
        "<p>" + "<" * 50_000, "<p>a <!-- never <b>", "<a " * 20_000, "<p 'x" * 3000, "text < 5 & <p>more > ok", "\x00<p>\x00</p>", '<meta name="date" content="99999999999999"><time datetime="9999-12-31T23:59:59-14:00">x</time>',
    ]
    pages = spark.createDataFrame(list(enumerate("http://a.com/x" for _ in deep + odd)), "page_id long, url string").join(spark.createDataFrame(list(enumerate(deep + odd)), "page_id long, html string"), "page_id")
    rows = {r["page_id"]: r for r in article.articles(pages, only=[*article.FULL, "links"]).collect()}
    assert len(rows) == len(deep + odd) and all("It was in the morning" in rows[i]["text"] for i in range(4))
    assert rows[5]["authors"] == ["\ufffd Ann Lee"] or "Ann Lee" in rows[5]["authors"][0]
    assert dom.text(dom.parse(odd[2])) == "a" and rows[12]["publish_date"] is None
    assert article.nodes(pages.where("page_id < 2")).count() > 3000


def test_index_and_columns_on_demand(spark):
    pages = spark.createDataFrame([(1, "https://docks.example.com/2024/03/02/harbour", PAGE)], "page_id long, url string, html string")
    every = article.articles(pages, only=list(article.COLUMNS)).first()
    for some in (["keywords"], ["files", "language"], ["top_image", "authors", "publish_date", "movies", "title"]):
        r = article.articles(pages, only=some).first()
        assert all(r[c] == every[c] for c in some), some
    plan = article.articles(pages, only=["title", "language", "text", "keywords"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    basic = article.articles(pages, article.Options(tokenizer=False), only=["keywords", "summary"]).first()
    assert basic["keywords"] and basic["summary"].endswith(".")


def test_tree_edits():
    d = dom.parse("<div><p>a<i>b</i></p><ul><li>1</li><li>2</li><li>3</li></ul></div>")
    assert dom.depth(d.find("ul")[0]) == 4 and dom.depth(d.find("li")[0]) == 1
    dom.drop_tags(d, "p", frozenset({"i"}))
    assert dom.serialise(d.find("div")[0]) == "<div><i>b</i><ul><li>1</li><li>2</li><li>3</li></ul></div>"
    dom.drop_tags(d, "ul")
    assert dom.serialise(d.find("div")[0].copy()) == "<div><i>b</i></div>"


def test_json(spark):
    pages = spark.createDataFrame([(1, "https://docks.example.com/x", PAGE), (2, "", "")], "page_id long, url string, html string")
    of = article.articles(pages, only=[*article.FULL, "is_parsed"])
    short = {r["page_id"]: json.loads(r["json"]) for r in article.to_json(of).collect()}
    assert len(short[1]) == 27 and list(short[1]) == sorted(short[1]) and short[2]["publish_date"] is None and short[1]["publish_date"] == "2024-03-01T00:00:00Z"
    full = json.loads(article.to_json(of, full=True).where("page_id = 1").first()["json"])
    assert set(short[1]) < set(full) and full["is_parsed"] is True and len(full) == 44
    assert full["html"] == PAGE and full["doc_html"].startswith("<html") and "<nav>" in full["doc_html"] and "<nav>" not in full["clean_doc_html"] and "It was in the morning" in full["top_node_html"]
    assert "https://docks.example.com/" in full["categories"] and full["categories"] == sorted(full["categories"])
    unread = article.articles(pages.selectExpr("page_id", "url", "CAST(NULL AS STRING) AS html"), only=article.FULL)
    assert article.to_json(unread, full=True).count() == 0
    assert article.to_text(of).where("page_id = 1").first()["out"].startswith("Article Title: Harbour")


@pytest.mark.parametrize(
    ("tag", "h1", "meta", "want"),
    [
        ("A long headline here", ["A long headline here"], "", "A long headline here"),
        ("Site name: x", ["One two three four"], "One two three four", "One two three four"),
        ("Big story of the day|The Site", ["big story of the day!"], "", "big story of the day!"),
        ("Big story of the day | The Site", ["big story of the day!"], "", "Big story of the day"),
        ("Short - A much longer piece of title", [], "", "A much longer piece of title"),
        ("Story about water – Some Paper", [], "Story about water", "Story about water"),
        ("a_b", ["Two words"], "", "a"),
        (None, ["x y z"], "m", ""),
    ],
)
def test_title_rules(spark, tag, h1, meta, want):
    df = spark.createDataFrame([(tag, h1, meta)], "t string, h array<string>, m string")
    assert df.select(article.title(F.col("t"), F.col("h"), F.col("m"), F.lit("en"))).first()[0] == want


def test_trees():
    d = dom.parse("<p><b>x<br><p>y</b> z<div>q</div><ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table>")
    assert dom.serialise(d) == "<html><head></head><body><p><b>x<br></b></p><p><b>y</b> z</p><div>q</div><ul><li>1</li><li>2</li></ul><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table></body></html>"
    p = dom.parse("<html><body><div><p>t</p></div>").find("p")[0]
    assert p.level == 3
    assert dom.text(dom.parse("<body>a<script>no()</script> &amp;lt;b&amp;gt; <i>c</i>d</body>")) == "a cd"
    assert dom.link_dense(dom.parse("<div><a>one two three</a><a>four five</a><a>six</a></div>").find("div")[0])
    assert not dom.link_dense(dom.parse("<div>many words that are no link at all <a>x</a></div>").find("div")[0])
    assert dom.distance(["html", "body", "div", "p"], ["html", "body", "img"]) == 3
    assert dom.clean_whitespace("\ta \n\n b\n") == "a\n\nb"
    assert [n.get("id") for n in dom.tags(dom.parse('<p id="a" class="x y"><p id="b" class="y">'), "p", {"class": "x"}, "word")] == ["a"]
    assert len(dom.at_level(dom.parse("<div><p></p></div><div></div>").elements()[0], 2)) == 2


def test_cleaning():
    def left(html, tag):
        return len(dom.clean(dom.parse(f"<html><body>{html}</body></html>")).find(tag))

    assert left("<em>x</em>", "em") == 0 and left("<em><img></em>", "em") == 1
    assert left("<p>a<span>b</span></p>", "span") == 0 and left("<aside>x</aside><nav>y</nav>", "aside") == 0
    assert left('<div class="footer">x</div>', "div") == 0 and left('<div class="footer"><article>x</article></div>', "article") == 1
    assert left("<figure><img><figcaption>c</figcaption></figure>", "img") == 1 and left("<div id='twitter-box'>x</div>", "div") == 0


def test_body_prefers_the_text_to_the_links():
    links = "".join(f'<a href="/{i}">the link of the day and more</a> ' for i in range(12))
    page = f"<html><body><div id='menu'>{links}</div><div id='main'><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>"
    found = dom.body(dom.parse(page), dom.stop_for("en"))
    assert dom.text(found).count("It was in the morning") == 3 and "link of the day" not in dom.text(found)


def test_dates_and_names():
    assert article.parse_date("Aug 27, 2025") == datetime(2025, 8, 27, tzinfo=timezone.utc) and article.parse_date("2025/8/27") == datetime(2025, 8, 27, tzinfo=timezone.utc)
    assert article.parse_date("Tue, 05 Mar 2024 10:00:00 GMT").hour == 10 and article.parse_date("soon") is None
    for text, want in {
        "May 8, 2009 5:57:51 PM": (2009, 5, 8, 17, 57, 51), "oct 7, 1970": (1970, 10, 7), "12 Feb 2006, 19:17": (2006, 2, 12, 19, 17), "7 oct 1970": (1970, 10, 7), "2013-Feb-03": (2013, 2, 3), "Mon Jan 2 15:04:05 2006": (2006, 1, 2, 15, 4, 5),
        "Monday, 02-Jan-2006 15:04:05 MST": (2006, 1, 2, 22, 4, 5), "4/8/2014 22:05": (2014, 4, 8, 22, 5), "2014.03.30": (2014, 3, 30), "1332151919": (2012, 3, 19, 10, 11, 59), "2009-08-12T22:15:09-07:00": (2009, 8, 13, 5, 15, 9), "September 17, 2012 at 10:09am PST": (2012, 9, 17, 18, 9), "June 2014": (2014, 6, 1),
    }.items():
        assert article.parse_date(text) == datetime(*want, tzinfo=timezone.utc), text
    assert article.parse_date("0001-01-01T00:00:00+14:00") is None and article.parse_date("room 12 at 99:99") is None and article.parse_date("2024-13-45") is None
    assert article.byline("Von x | By Ann Lee, Bob Ray and Room 5") == ["Ann Lee", "Bob Ray"]
    assert article.clean_authors(["By Ann Lee", "ann lee", "Reuters", "- Bob"]) == ["Ann Lee", "Bob"]
    assert article.author_names([{"name": "A"}, "B", {"name": ["C", "D"]}]) == ["A", "B", "C", "D"]


def test_node_table(spark):
    n = {r["node_id"]: r for r in article.nodes(spark.createDataFrame([(1, "u", "<div><p id=a>x<b>y</b></p></div>")], "page_id long, url string, html string")).collect()}
    p = next(r for r in n.values() if r["tag"] == "p")
    assert p["text"] == "xy" and p["own_text"] == "x" and p["level"] == 3 and n[p["parent_id"]]["tag"] == "div" and n[p["post_id"]]["tag"] == "b" and p["attrs"] == {"id": "a"}


@pytest.mark.parametrize(
    ("url", "news", "category", "likely"),
    [
        ("https://paper.co.uk/careers/some-job", False, False, False),
        ("https://paper.co.uk/story/one/2", True, False, True),
        ("https://paper.co.uk/", False, False, False),
        ("https://paper.co.uk/sport", False, True, False),
        ("https://paper.co.uk/topics/water", False, True, False),
        ("https://paper.co.uk/a/the-very-long-slug-of-a-report", True, False, False),
        ("https://paper.co.uk/2024/05/06/x", True, False, True),
        ("https://news.site.com/item?id=3", False, False, True),
        ("https://twitter.com/a/12345", False, False, False),
        ("/sport", False, False, False),
    ],
)
def test_address_classes(spark, url, news, category, likely):
    r = urls.parsed(spark.createDataFrame([(url,)], "url string"), "url").select(urls.valid_news(F.col("u"), F.col("url")), urls.valid_category(F.col("u"), F.col("url")), urls.likely_article(F.col("url"))).first()
    assert tuple(r) == (news, category, likely)


def test_address_parts_and_cleaning(spark):
    u = urls.parsed(spark.createDataFrame([("http://my.sample.co.uk:8081/way/to/leaf.html?q=7#part",)], "url string"), "url").first()["u"]
    assert (u["scheme"], u["domain"], u["subdomain"], u["tld"], u["port"], u["path"], u["raw_query"], u["fragment"], u["file_type"]) == ("http", "sample", "my", "co.uk", "8081", "/way/to/leaf.html", "q=7", "part", "html")
    cases = [("http://a.com//path//to?utm_source=x&b=2&a=1#f", "http://a.com/path/to?a=1&b=2"), ("", ""), ("http://a.com/?gclid=1", "http://a.com/")]
    assert [r[0] for r in spark.createDataFrame([(a,) for a, _ in cases], "u string").select(urls.clean(F.col("u"))).collect()] == [b for _, b in cases]
    p = spark.createDataFrame([("../b", "https://x.com/a/c"), ("https://x.com/r?url=https%3A%2F%2Fy.com%2Fz", "https://x.com"), ("a", "no address")], "r string, s string").select(urls.prepare(F.col("r"), F.col("s"))).collect()
    assert [x[0] for x in p] == ["https://x.com/b", "https://y.com/z", ""]


RSS = "<?xml version='1.0'?><rss><channel><item><link>https://paper.com/story/1</link></item><item><guid>https://paper.com/story/2</guid></item><item><enclosure url='https://paper.com/story/3'/></item><item><link>https://other.com/story/9</link></item></channel></rss>"
ATOM = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><link href='https://paper.com/story/4'/></entry></feed>"


def test_source_pipeline(spark):
    home = "<html><head><meta name='description' content='All of it'></head><body><a href='/sport'>Sport</a><a href='https://paper.com/sport'>again</a><a href='/topics/water'>Water</a><a href='https://else.com/x'>out</a><a href='/'>home</a></body></html>"
    sport = "<html><head><link type='application/rss+xml' href='/linked'></head><body><a href='/story/5'>Five</a><a href='/story/1'>One</a><a href='/login'>no</a></body></html>"
    web = spark.createDataFrame(
        [("https://paper.com", 200, home), ("https://paper.com/sport", 200, sport), ("https://paper.com/topics/water", 500, ""), ("https://paper.com/rss", 200, RSS), ("https://paper.com/linked", 200, ATOM), ("https://paper.com/feed", 404, RSS)],
        "url string, status int, body string",
    )
    sources = spark.createDataFrame([("https://paper.com",)], "source_url string")
    homes = source.downloaded(sources.withColumn("url", F.col("source_url")), web).drop("url")
    assert sorted(r["url"] for r in source.categories(homes).collect()) == ["https://paper.com/sport", "https://paper.com/topics/water"]
    assert tuple(source.described(homes).select("brand", "description").first()) == ("paper", "All of it")
    found = source.build(sources, web).collect()
    got = {r["url"]: r for r in found}
    assert set(got) == {f"https://paper.com/story/{i}" for i in (1, 2, 3, 4, 5)}
    assert got["https://paper.com/story/5"]["title"] == "Five" and got["https://paper.com/story/1"]["title"] == ""  # feeds come first


def test_feeds_that_are_no_xml():
    body = "<rss><channel><item><title>a &nbsp; b</title><link>https://p.com/1</link></item><item><guid>https://p.com/2</guid></item><item><enclosure url='https://p.com/3?a=1&amp;b=2'></item><entry><link href='https://p.com/4'/></entry><item>see https://p.com/5 </item>"
    assert source.feed_items(body) == ["https://p.com/1", "https://p.com/2", "https://p.com/3?a=1&b=2", "https://p.com/4", "https://p.com/5"]
    assert source.feed_items(None) == [] and source.feed_items("no feed") == []


def test_page_categories_fall_back_to_quoted_addresses(spark):
    pages = spark.createDataFrame([
        (1, "https://paper.com/x", '<a href="https://paper.com/sport">s</a><a href="https://paper.com/login">no</a><script>x = "https://paper.com/late"</script>'),
        (2, "https://paper.com/y", '<a href="/relative">r</a><script>x = "https:\\/\\/paper.com\\/late"; y = "https://paper.com/a.css"; z = "https://other.com/z"; "https://paper.com/sport"</script>'), (3, "https://paper.com/z", None), (None, "https://paper.com/z", "<a href='https://paper.com/sport'>"),
    ], "page_id long, url string, html string")
    rows = [(r["page_id"], r["category"]) for r in source.page_categories(article.facts(pages, only=["links", "html"])).collect()]
    by = {i: [c for k, c in rows if k == i] for i in (1, 2, 3, None)}
    assert by == {1: ["https://paper.com/", "https://paper.com/sport"], 2: ["https://paper.com/", "https://paper.com/late", "https://paper.com/sport"], 3: ["https://paper.com/"], None: []}
    as_it_was = source.page_categories(article.facts(pages, only=["links", "html"]), compat=True).where("page_id = 2")
    assert [r["category"] for r in as_it_was.collect()] == ["https://paper.com/", "https://paper.com/sport"]


def test_candidates(spark):
    feeds = spark.createDataFrame([("s", f"https://p.com/{i}", i) for i in range(4)], "source_url string, url string, pos int")
    pages = spark.createDataFrame([("s", f"https://p.com/{i}", f"title {i}", i) for i in range(2, 7)], "source_url string, url string, title string, pos int")
    assert [r["url"][-1] for r in source.candidates(feeds, pages).orderBy("rank").collect()] == list("0123456")
    assert source.candidates(feeds, pages, source.BuildOptions(limit_articles=2)).count() == 2
    assert source.candidates(feeds, pages, source.BuildOptions(limit_articles=0, shuffle_seed=3)).count() == 7


def test_fetching(spark):
    def get(url):
        if url.endswith("bad"):
            raise OSError("no route")
        return (200, f"<p>{url}</p>")

    df = spark.createDataFrame([("http://a",), ("http://a",), ("http://bad",), (None,), ("",)], "url string")
    web = fetch.fetch(df, get=get, workers=2)
    assert {r["url"]: (r["status"], r["error"]) for r in web.collect()} == {"http://a": (200, None), "http://bad": (0, "no route")}
    pages = spark.createDataFrame([(1, "http://a", None, None), (2, "http://a", "own", None), (3, "x", "own", "given"), (4, "http://bad", None, None), (5, "", "", "")], "page_id long, url string, html string, input_html string")
    got = {r["page_id"]: (r["html"], r["download_state"], r["error"]) for r in fetch.requested(pages, web).collect()}
    assert got == {1: ("<p>http://a</p>", 2, None), 2: ("own", 2, None), 3: ("given", 2, None), 4: (None, 1, "not downloaded"), 5: (None, 1, "neither address nor text")}


def test_streams(spark, tmp_path):
    rows = [(i, f"http://a.com/{i % 3}?utm_source={i}", f"mail u{i}@b.com", datetime(2024, 1, 1, 0, i)) for i in range(6)]
    spark.createDataFrame(rows, "page_id long, url string, html string, ts timestamp").write.parquet(f"{tmp_path}/in")
    landing = streams.landing(spark, f"{tmp_path}/in", "page_id long, url string, html string, ts timestamp")
    streams.write(streams.first_of_each_url(landing, "ts"), f"{tmp_path}/once", f"{tmp_path}/c1").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/once").count() == 3
    streams.write(streams.indicators(landing, "html", ["page_id"]), f"{tmp_path}/ioc", f"{tmp_path}/c2").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/ioc").where("type = 'Email'").count() == 6


def test_windows_drop_late_events(spark, tmp_path):
    """Files come one after another; the watermark follows the latest time less the delay."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    batches = [[(1, at(0, 5), 1, "a", 1.0, ""), (2, at(0, 50), 1, "a", 2.0, ""), (3, at(0, 55), 1, "b", 4.0, "")], [(4, at(3, 0), 1, "a", 8.0, "")], [(5, at(0, 30), 1, "a", 16.0, ""), (6, at(2, 55), 1, "a", 32.0, "")], [(7, at(9, 0), 1, "a", 64.0, "")]]
    got = f"{tmp_path}/out"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.write(streams.counts(streams.landing(spark, f"{tmp_path}/in", schema)), got, f"{tmp_path}/c").awaitTermination(60)
    rows = {(r["start"].hour, r["event_type"]): (r["n"], r["total"]) for r in spark.read.parquet(got).collect()}
    assert rows == {(0, "a"): (2, 3.0), (0, "b"): (1, 4.0), (2, "a"): (1, 32.0), (3, "a"): (1, 8.0)}
