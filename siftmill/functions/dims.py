"""Static dimensions: stop words, languages, top-level domains and rule lists."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_DATA = Path(__file__).parent / "data"


@cache
def stopwords() -> dict[str, frozenset[str]]:
    """Lower-cased stop words by language code."""
    rows = (line.split("\t") for line in (_DATA / "stopwords.tsv").read_text("utf-8").split("\n") if line)
    return {code: frozenset(words) for code, *words in rows}


def stopwords_for(lang: str | None) -> frozenset[str]:
    """The words of a language; English for one that has none."""
    every = stopwords()
    return every.get((lang or "").lower(), every["en"])


@cache
def languages() -> dict[str, tuple[str, str]]:
    """Code to (English name, character class or ''). The file has ranges as hexadecimal numbers, anything else after '='."""

    def char_class(ranges: str) -> str:
        parts = [x[1:] if x.startswith("=") else "-".join("\\u" + end for end in x.split("..")) for x in ranges.split()]
        return f"[{''.join(parts)}]" if parts else ""

    rows = (line.split("\t") for line in (_DATA / "languages.tsv").read_text("utf-8").split("\n") if line)
    return {code: (name, char_class(ranges)) for code, name, ranges in rows}


@cache
def tlds() -> list[str]:
    return sorted((_DATA / "tlds.txt").read_text().split())


def is_language(code: str | None) -> bool:
    return code in languages() and bool(languages()[code][0])


def language_name(code: str) -> str | None:
    return languages()[code][0] if is_language(code) else None


def language_code(name: str) -> str | None:
    """The code of an English name, whatever its case."""
    return next((c for c, (n, _) in sorted(languages().items()) if n.lower() == name.lower()), None)


def language_class(tag: str | None) -> str:
    """Inside of a character class with the letters of a language tag; Latin letters by default."""
    tag = tag or ""
    pattern = languages().get(tag, ("", ""))[1] or languages().get(tag.split("-")[0][:2], ("", ""))[1]
    return pattern.strip()[1:-1] if pattern else r"a-zA-Z0-9\s"


def languages_table(spark: SparkSession) -> DataFrame:
    """(code, name, char_class)"""
    return spark.createDataFrame([(c, n, language_class(c)) for c, (n, _) in sorted(languages().items()) if n], "code string, name string, char_class string")


def _words(text: str) -> tuple[str, ...]:
    return tuple(text.split())


TRACKING_PARAMS = frozenset(
    _words(
        "adgroupid adid adposition aceid campaignid creative dclid device devicemodel epik fbclid feeditemid gclid gclsrc icid icm icn ici ict "
        "igshid keyword lmd_campaign lmd_cid lmd_content lmd_creation lmd_eid lmd_medium lmd_position lmd_sequence lmd_source lmd_term "
        "lmd_type_de_page loc_interest_ms loc_physical_ms m matchtype mc mc_cid mc_eid mca mcb mcc mkt_tok msclkid network oly_anon_id "
        "oly_enc_id pk_campaign pk_kwd pk_source placement ref referrer soc_src soc_trk spref target targetid utm_campaign utm_content "
        "utm_medium utm_source utm_term vero_conv vero_email vero_id wbraid yclid"
    )
)
URL_STOPWORDS = frozenset(
    _words(
        "toc xmlrpc download upload feed board password subscribe youtube myspace preference mobile profile store purchase advertise browse donate "
        "archive tag shopping search feedback facebook legal mail forum linkedin login wp-login admin wp-admin subscription stumbleupon wp-json bebo "
        "vimeo info how-to howto map site-map sitemap xmlrpc.php help shop stop signup faq career developer friendster register newsletter twitter "
        "flickr author imgur jobs downloads uploads feeds boards services preferences wp-includes profiles itunes archives terms forums coupons maps "
        "sitemaps faqs careers developers newsletters authors contacts products tickets comments events charts adverts plus contact product edit "
        "comment wp-content event account advert about siteindex privacy privacy-policy academy proxy"
    )
)
NOT_ARTICLE = _words("/ask /comments /from /front /hide /jobs /login /logout /newcomments /newest /news /past /show /submit /user /vote")
ARTICLE = _words("/article /blog/ /content /entry /item?id= /news/ /p/ /post /story")
CATEGORY_PREFIXES = _words("cat cats categories category section sections subject subjects topic topics")
FEED_SUFFIXES = _words(
    "/rss /rss/ /feed /feed/ /rss.xml /feed.xml /atom.xml /new/.rss /blog/rss /news/rss /blog/feed /news/feed "
    "/blog/rss.xml /news/rss.xml /news/feed.xml /comments/feed/ /feed/@username /blogs/news.rss /blogs/news.atom /blog?format=rss /feeds/latest.xml /rss.xml?format=xml /feeds/posts/default /feed/publication-name /feeds/posts/default?alt=rss"
)
ARTICLE_TYPES = _words("asp aspx cgi htm html jhtml jsp md rhtml rst shtml xhtml")
GOOD_PATHS = _words("article feature featured gallery media news press radio slides slideshow story v video")
BAD_CHUNKS = _words(
    "about account admin adserver advert annonces auth_user blog boutique browse careers clicannonces contact contribution courrierdeslecteurs "
    "donate emploi espaceclient faq feedback howto info page_newsletters preferences privacy services shop subscribe terms"
)
BAD_DOMAINS = _words("amazon doubleclick facebook google instagram pinterest twitter youtube")
VIDEO_PROVIDERS = _words("youtube youtu.be vimeo dailymotion kewego twitch")
ASSETS = _words(".css .jpeg .jpg .js .json .png .rss .xml")
