"""Pages to articles.

``facts`` crosses to Python once: a page is parsed, and what depends on its tree leaves
as one struct. Everything after that (title choice, language, keywords, summary,
indicators, JSON) is column expressions and joins on page_id, without the HTML.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions import dims, dom, ioc, lang, nlp, urls
from siftmill.operators import source
from siftmill.sources.shared import cut


@dataclass(frozen=True)
class Options:
    """What a caller can set; ``now`` makes date scores repeatable."""

    language: str = ""
    max_keywords: int = nlp.MAX_KEYWORDS
    max_sentences: int = nlp.MAX_SENTENCES
    min_words: int = nlp.MIN_WORDS
    fetch_images: bool = True
    compat: bool = False
    tokenizer: bool = True
    now: datetime = datetime(2026, 1, 1, tzinfo=timezone.utc)

    def __post_init__(self) -> None:
        if self.language and len(self.language) != 2:
            raise ValueError("a language has two letters")


AUTHOR_ATTRS = "name rel itemprop class id property".split()
AUTHOR_VALUES = [*"author byline dc.creator byl article:author article:author_name".split(), "story-byline", "article-author", *(f"{x}author" for x in ("parsely-", "sailthru.", "citation_"))]
_AUTHOR_KEYS, _AUTHOR_SET = set(AUTHOR_ATTRS), frozenset(AUTHOR_VALUES)
AUTHOR_STOP = re.compile(r"(?i)\b(?:Opinion Writer|Senior Reporter|Reporter|Reuters|Writer|IANS|AFP|ANI|DPA|PTI|AP|By)\b", re.ASCII)
TITLE_METAS = "dc.title og:title headline articletitle article-title parsely-title title".split()
DATE_METAS = (
    "date Date pubdate pub_date publish_date publish-date publishdate PublishDate publishedDate publishedAtDate published_date published_time publication_date publishtime "
    "datePublished rnews:datePublished article:published_time article.published article_date_original og:published_time og:regDate published_time_telegram original-publish-date OriginalPublicationDate "
    "prism.publicationDate parsely-pub-date cXenseParse:publishtime sailthru.date displaydate uploadDate coverageEndTime creationDateTime dcterms.created dcterms.date dc.date DC.Date DC.date.issued "
    "datemodified DC.date.modified dc.dcterms.modified article:modified_time modified_time modifiedDateTime lastmod last-modified Last-Modified updated_time og:updated_time eomportal-lastUpdate"
).split()
_URL_DATE = re.compile(r"([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})")
_FORMATS = ("%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M%z", "%Y-%m-%d %H:%M:%S%z", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d", "%d %b %Y %H:%M:%S", "%d %b %Y", "%d %B %Y", "%b %d, %Y %H:%M", "%b %d, %Y", "%B %d, %Y", "%a, %d %b %Y %H:%M:%S %z", "%a, %d %b %Y %H:%M:%S", "%m/%d/%Y", "%d.%m.%Y", "%Y%m%d")


def parse_date(s: str | None) -> datetime | None:
    """A date in any common form, UTC; None if it is none."""
    s = re.sub(r"\s+", " ", (s or "").strip()).replace("GMT", "+0000").replace("UTC", "+0000")
    s = re.sub(r"Z$", "+0000", s)
    if len(s) > 80 or not re.search(r"[0-9]", s):
        return None
    for form in _FORMATS:
        try:
            return _utc(datetime.strptime(s, form))
        except ValueError:
            continue
    return _any_date(s)


def _utc(d: datetime) -> datetime | None:
    try:
        return d.astimezone(timezone.utc) if d.tzinfo else d.replace(tzinfo=timezone.utc)
    except OverflowError:  # beyond the years 1 to 9999
        return None


_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_CLOCK = re.compile(r"(?<![0-9:])([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)? ?([ap]\.?m\.?)?", re.I)
_ZONE = re.compile(r"([+-])([0-9]{2}):?([0-9]{2})$")
_ZONES = {"est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "cet": 1, "cest": 2, "bst": 1}


def _any_date(s: str) -> datetime | None:
    """A date in any layout: a clock, a zone, a month by name or the order year-month-day or month-day-year; seconds since 1970."""
    if re.fullmatch(r"[0-9]{10}|[0-9]{13}", s):
        return datetime.fromtimestamp(int(s[:10]), timezone.utc)
    clock, zone = _CLOCK.search(s), timezone.utc
    hour, minute, second, micro = 0, 0, 0, 0
    rest = s
    if clock:
        hour, minute, second = int(clock[1]), int(clock[2]), int(clock[3] or 0)
        micro = int((clock[4] or "0").ljust(6, "0")[:6])
        half = (clock[5] or "").lower()[:1]
        if half:
            hour = hour % 12 + (12 if half == "p" else 0)
        tail = s[clock.end() :].strip()
        found = _ZONE.search(tail)
        if found:
            zone = timezone((1 if found[1] == "+" else -1) * timedelta(hours=int(found[2]), minutes=int(found[3])))
            tail = tail[: found.start()]
        for name, hours in _ZONES.items():
            if re.search(rf"\b{name}\b", tail, re.I):
                zone = timezone(timedelta(hours=hours))
        rest = f"{s[: clock.start()]} {tail}"
    named = re.search(r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*", rest, re.I)
    numbers = [x for x in re.findall(r"[0-9]+", rest)]
    year = next((x for x in numbers if len(x) == 4), None)
    others = [int(x) for x in numbers if x is not year and len(x) <= 2]
    try:
        if named and year and others:
            return _utc(datetime(int(year), _MONTHS[named[1].lower()], others[0], hour, minute, second, micro, zone))
        if named and year:
            return _utc(datetime(int(year), _MONTHS[named[1].lower()], 1, hour, minute, second, micro, zone))
        if year and len(others) >= 2:
            month, day = others[:2]
            if numbers[0] is not year and month > 12:
                month, day = day, month
            return _utc(datetime(int(year), month, day, hour, minute, second, micro, zone))
    except ValueError:
        return None
    return None


def json_ld(doc: dom.Node | dom.Index) -> list[dict]:
    """Objects of the page's JSON-LD scripts; arrays flattened one level, broken ones skipped."""
    out: list[dict] = []
    for s in doc.find("script"):
        if s.get("type") == "application/ld+json":
            try:
                value = json.loads(dom.raw_text(s))
            except ValueError:
                continue
            out += [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict)]
    return out


def _graph(o: dict) -> list[dict] | None:
    g = o.get("@graph")
    return [x for x in g if isinstance(x, dict)] if isinstance(g, list) else None


def author_names(value: object) -> list[str]:
    """Names in an author value: a string, an object with name, or a list of these."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        name = value.get("name")
        return [name] if isinstance(name, str) else [x for x in name if isinstance(x, str)] if isinstance(name, list) else []
    return [n for v in value if isinstance(v, (str, dict)) for n in author_names(v)] if isinstance(value, list) else []


def byline(s: str) -> list[str]:
    """Names of a byline: after by or from, split at separators, two to five words without digits."""
    s = re.sub(r"[\n\t\r\xa0]", " ", re.sub(r"<[^>]+>", "", s))
    m = re.search(r"(?i)\b(?:by|from)[:\s](.*)", s, re.ASCII)
    out = []
    for part in re.split(r"[·,|]| and | et | und |/", m[1] if m else s):
        part = part.strip()
        if part and not re.search(r"[0-9]", part) and 2 <= len(re.findall(r"\w+", part, re.ASCII)) <= 5:
            out.append(part)
    return out


def clean_authors(names: list[str]) -> list[str]:
    seen: dict[str, str] = {}
    for name in names:
        name = re.sub(r"^[^\w]+|[^\w]+$", "", AUTHOR_STOP.sub("", name), flags=re.ASCII).strip()
        if name:
            seen.setdefault(name.lower(), name)
    return list(seen.values())


def authors(doc: dom.Node | dom.Index, ld: list[dict]) -> list[str]:
    names: list[str] = []
    for o in ld:
        graph = _graph(o)
        for item in graph if graph is not None else [o]:
            if graph is not None and item.get("@type") == "Person" and isinstance(item.get("name"), str):
                names.append(item["name"])
            names += author_names(item.get("author"))
    marked: dict[tuple[str, str], list[dom.Node]] = {}
    for n in doc.walk():
        for key in _AUTHOR_KEYS & n.attrs.keys():
            if n.attrs[key] in _AUTHOR_SET:
                marked.setdefault((key, n.attrs[key]), []).append(n)
    for key in AUTHOR_ATTRS if marked else []:
        for value in AUTHOR_VALUES:
            for n in marked.get((key, value), []):
                names += [n.get("content")] if n.tag == "meta" else byline(dom.text(n))
    return clean_authors(names)


def publish_date(doc: dom.Node | dom.Index, ld: list[dict], url: str, now: datetime) -> datetime | None:
    """The best scored of the dates in address, JSON-LD, time elements and metas; the first on ties."""
    found: list[tuple[int, datetime]] = []
    m = _URL_DATE.search(url)
    if m:
        found += [(10, d) for d in [parse_date(f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}")] if d]
    for o in ld:
        graph = _graph(o)
        for item in graph if graph is not None else [o]:
            found += [(10 if graph is not None else 9, d) for key in ("datePublished", "dateCreated") if isinstance(item.get(key), str) for d in [parse_date(item[key])] if d]
    for t in doc.find("time"):
        d = parse_date(t.get("datetime"))
        if d:
            s = dom.text(t).lower()
            found.append((8 if "published" in s or "on:" in s else 5, d))
    for name in DATE_METAS:
        for n in dom.metas(doc, name):
            d = parse_date(n.get("content"))
            if d:
                days = int((now - d).total_seconds() / 86400)
                found.append((5 if days <= -1 else 6 if days > 25 * 365 else 7, d))
    return max(found, key=lambda x: x[0])[1] if found else None


def _resolve(base: str, ref: str) -> str:
    try:
        return urljoin(base, ref)
    except ValueError:
        return ref


def _provider(url: str) -> bool:
    m = re.match(r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]+)", url, re.I)
    return bool(m) and any(p in m[1].lower().removeprefix("www.") for p in dims.VIDEO_PROVIDERS)


def videos(doc: dom.Node | dom.Index, ld: list[dict], url: str) -> list[str]:
    out = [v.get("src") for v in doc.find("video") if v.get("src")]
    for tag, key in (("iframe", "src"), ("embed", "src"), ("object", "data")):
        out += [n.get(key) for n in doc.find(tag) if _provider(n.get(key))]
    for o in ld:
        for item in [o, *(_graph(o) or [])]:
            if item.get("@type") == "VideoObject" and isinstance(item.get("contentUrl"), str):
                out.append(item["contentUrl"])
    return [_resolve(url, v) for v in out]


_META_IMAGES = [("meta", "property", r"^og:image$", "content", 10), ("link", "rel", "image_src|img_src", "href", 8), ("meta", "name", r"^og:image$", "content", 8), ("link", "rel", "^icon$", "href", 5)]


def meta_image(doc: dom.Node | dom.Index, url: str) -> str:
    found = [(score, n.get(key)) for tag, attr, rx, key, score in _META_IMAGES for n in doc.find(tag) if attr in n.attrs and re.search(rx, n.get(attr)) and n.get(key)]
    return _resolve(url, max(found, key=lambda x: x[0])[1]) if found else ""


_SOURCES = "src data-src data-original data-lazy-src".split()


def image_source(n: dom.Node) -> str:
    return next((n.get(k) for k in _SOURCES if n.get(k)), "")


def images(doc: dom.Node | dom.Index, url: str) -> list[str]:
    return [_resolve(url, s) for n in doc.find("img") for s in [image_source(n)] if s and not s.startswith("data:")]


def top_image(doc: dom.Node | dom.Index, top: dom.Node | None, meta: str, url: str, fetch: bool) -> str:
    """The meta image if images are not fetched, else the image nearest to the article by tag path."""
    if meta and not fetch:
        return meta
    here = dom.tree_path(top) if top is not None else []
    found = [(dom.distance(here, dom.tree_path(n)), n.get("src")) for n in doc.find("img") if n.get("src") and not n.get("src").startswith("data:")]
    return _resolve(url, min(found, key=lambda x: x[0])[1]) if found else meta


def meta_language(doc: dom.Node | dom.Index) -> str:
    root = next(iter(doc.find("html")), None)
    tries = [root.get("lang") if root is not None else ""]
    for key, value in (("property", "og:locale"), ("http-equiv", "content-language"), ("name", "lang")):
        tries += [m.get("content") for m in doc.find("meta") if m.get(key) == value]
    return next((t.strip().lower() for t in tries if len(t.strip()) == 2 and dims.is_language(t.strip().lower())), "")


def canonical(doc: dom.Node | dom.Index, url: str) -> str:
    ref = next((n.get("href") for n in doc.find("link") if n.get("rel") == "canonical" and n.get("href")), "") or dom.meta_field(doc, "og:url")
    return _resolve(url, ref) if ref else ""


def meta_data(doc: dom.Node | dom.Index) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in doc.find("meta"):
        key = (m.get("property") or m.get("name") or m.get("itemprop")).strip()
        if key:
            out[key] = m.get("content").strip()
    return out


def detect(s: str) -> str:
    """The language of a text by the same evidence as ``lang.detect``."""
    t = f" {s.lower()} "
    counts = {c: lang.WEIGHT * sum(t.count(f" {w} ") for w in ws) for c, ws in lang.WORDS.items()} | {"und": 1}
    return min(counts, key=lambda c: (-counts[c], c))


_TEXT, _TEXTS = ("string", pa.string()), ("array<string>", pa.list_(pa.string()))
#: What can be asked of a page: type in Spark and in Arrow.
FACTS: dict[str, tuple[str, pa.DataType]] = {
    "meta_lang": _TEXT, "title_tag": _TEXT, "h1": _TEXTS, "meta_title": _TEXT, "canonical_link": _TEXT, "meta_description": _TEXT, "meta_site_name": _TEXT, "meta_keywords": _TEXT,
    "meta_data": ("map<string,string>", pa.map_(pa.string(), pa.string())), "authors": _TEXTS, "publish_date": ("timestamp", pa.timestamp("us", "UTC")), "meta_favicon": _TEXT, "meta_img": _TEXT, "images": _TEXTS,
    "top_image": _TEXT, "movies": _TEXTS, "links": ("array<struct<href:string,text:string>>", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))), "feed_links": _TEXTS,
    "raw_body": _TEXT, "text": _TEXT, "article_html": _TEXT, "top_tag": _TEXT, "top_node_html": _TEXT, "doc_html": _TEXT, "clean_doc_html": _TEXT, "html": _TEXT, "is_null": ("boolean", pa.bool_()),
}
_BODY = frozenset("raw_body text article_html top_tag top_image top_node_html".split())


def page_facts(url: str | None, html: str | None, options: Options, wanted: frozenset[str]) -> dict:
    """The wanted facts of a page; what several of them need is made once, what none needs is not made."""
    url = url or ""
    doc = dom.Index(dom.parse(html))
    ld = json_ld(doc) if wanted & {"authors", "publish_date", "movies"} else []
    out: dict = {"html": html, "is_null": html is None}
    meta = meta_image(doc, url) if wanted & {"meta_img", "top_image"} else ""
    titles = doc.find("title")
    makers = {
        "meta_lang": lambda: meta_language(doc), "title_tag": lambda: dom.text(titles[0]) if titles else None, "h1": lambda: [dom.text(h) for h in doc.find("h1")],
        "meta_title": lambda: dom.meta_field(doc, *TITLE_METAS), "canonical_link": lambda: canonical(doc, url), "meta_description": lambda: dom.meta_field(doc, "description", "og:description"),
        "meta_site_name": lambda: dom.meta_field(doc, "og:site_name"), "meta_keywords": lambda: dom.meta_field(doc, "keywords"), "meta_data": lambda: list(meta_data(doc).items()),
        "authors": lambda: authors(doc, ld), "publish_date": lambda: publish_date(doc, ld, url, options.now),
        "meta_favicon": lambda: next((n.get("href") for n in doc.find("link") if n.get("rel") in ("icon", "shortcut icon") and n.get("href")), ""), "meta_img": lambda: meta,
        "images": lambda: images(doc, url), "movies": lambda: videos(doc, ld, url), "links": lambda: [{"href": a.get("href"), "text": dom.text(a)} for a in doc.find("a") if "href" in a.attrs],
        "feed_links": lambda: [n.get("href") for n in doc.find("link") if n.get("type") in ("application/rss+xml", "application/atom+xml") and n.get("href")],
        "doc_html": lambda: dom.serialise(doc.find("html")[0]), "clean_doc_html": lambda: dom.serialise(dom.clean(doc.doc.copy())),
    }
    out |= {k: make() for k, make in makers.items() if k in wanted}
    if wanted & _BODY:
        language = options.language or meta_language(doc) or detect(dom.text(doc.doc))
        found = dom.body(doc, dims.stopwords_for(language), options.compat)
        out |= {"raw_body": dom.text(found) if found is not None else "", "top_tag": found.tag if found is not None else None, "text": "", "article_html": ""}
        if "top_node_html" in wanted:
            out["top_node_html"] = dom.serialise(found) if found is not None else ""
        if "top_image" in wanted:
            out["top_image"] = top_image(doc, found if found is not None and found.parent is not None else None, meta, url, options.fetch_images)
        if found is not None and wanted & {"text", "article_html"}:
            cleaned = dom.clean(found)
            out["text"] = dom.text(cleaned)
            out["article_html"] = dom.serialise(cleaned) if "article_html" in wanted else ""
    return out


def _whole(value: object) -> object:
    """A value that UTF-8 can hold: lone surrogates, which JSON may spell out, are replaced."""
    if isinstance(value, str):
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(value, dict):
        return {_whole(k): _whole(v) for k, v in value.items()}
    return type(value)(map(_whole, value)) if isinstance(value, (list, tuple)) else value


def facts(pages: DataFrame, options: Options | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """What the tree of each page (page_id, url, html) says, or ``only`` some of FACTS; a null html is an empty page."""
    options = options or Options()
    names = [k for k in FACTS if k in set(FACTS if only is None else only)]
    wanted = frozenset(names)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), *[(k, FACTS[k][1]) for k in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in nlp.slices(batch.columns):
                rows = [{"page_id": r["page_id"], "url": r["url"] or ""} | page_facts(r["url"], r["html"], options, wanted) for r in batch.slice(*at).to_pylist()]
                try:
                    table = pa.Table.from_pylist(rows, schema)
                except UnicodeEncodeError:
                    table = pa.Table.from_pylist([_whole(r) for r in rows], schema)
                yield from table.to_batches()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, ", ".join(["page_id long", "url string", *[f"{k} {FACTS[k][0]}" for k in names]]))


NODES_DDL = "page_id long, node_id int, post_id int, parent_id int, grandparent_id int, level int, sib_idx int, tag string, attrs map<string,string>, own_text string, text string"


def nodes(pages: DataFrame) -> DataFrame:
    """The trees as rows: pre-order node_id, last node_id below as post_id, parents, level, tag, attributes, texts.

    d lies below a in one page if ``d.node_id > a.node_id AND d.node_id <= a.post_id``.
    """

    def rows_of(page_id: int, html: str | None) -> list[dict]:
        doc = dom.parse(html)
        every = list(doc.walk())
        number = {id(n): i for i, n in enumerate(every)}
        last = {id(n): number[id(n)] for n in every}
        for n in reversed(every):
            if id(n.parent) in last:
                last[id(n.parent)] = max(last[id(n.parent)], last[id(n)])
        out = []
        place = {id(c): k for n in (doc, *every) for k, c in enumerate(n.elements())}
        for i, n in enumerate(every):
            up = n.parent if id(n.parent) in number else None
            top = up.parent if up is not None and id(up.parent) in number else None
            out.append(
                {
                    "page_id": page_id, "node_id": i, "post_id": last[id(n)], "parent_id": number[id(up)] if up is not None else None, "grandparent_id": number[id(top)] if top is not None else None,
                    "level": n.level, "sib_idx": place[id(n)], "tag": n.tag, "attrs": list(n.attrs.items()), "own_text": "".join(c for c in n.children if isinstance(c, str)), "text": dom.text(n),
                }
            )
        return out

    kinds = pa.schema([("page_id", pa.int64()), *[(c, pa.int32()) for c in ("node_id", "post_id", "parent_id", "grandparent_id", "level", "sib_idx")], ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("own_text", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = [x for r in batch.slice(i, 64).to_pylist() for x in rows_of(r["page_id"], r["html"])]
                yield from pa.Table.from_pylist(rows, kinds).to_batches()

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, NODES_DDL)


# what follows the tree, as expressions


def h1_title(h1: Column) -> Column:
    """The longest h1 in bytes, the first on ties; '' if it has two words at most."""
    filled = F.filter(h1, lambda x: x != "")
    ranked = F.transform(filled, lambda x, i: F.struct((-F.octet_length(x)).alias("n"), i.alias("i"), x.alias("x")))
    best = F.coalesce(F.get(F.array_sort(ranked), F.lit(0))["x"], F.lit(""))
    return F.when(F.size(nlp.words(best)) <= 2, "").otherwise(F.regexp_replace(best, r"\s+", " "))


def _split_title(title: Column, delimiter: str, hint: Column) -> Column:
    quoted = re.sub(r"([|/ ])", r"\\\1", delimiter) if delimiter == "|" else delimiter
    pieces = F.split(title, quoted, -1)
    plain = lambda x: F.lower(F.regexp_replace(x, r"[^a-zA-Z0-9\ ]", ""))
    fits = F.filter(pieces, lambda x: (hint != "") & F.contains(plain(x), hint))
    ranked = F.transform(pieces, lambda x, i: F.struct((-F.octet_length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.replace(F.when(F.size(fits) > 0, fits[0]).otherwise(F.array_sort(ranked)[0]["x"]), F.lit("&raquo;"), F.lit("»"))


def title(tag: Column, h1: Column, meta: Column, language: Column) -> Column:
    """One of title element, longest h1 and meta title, or the main piece of the title element."""
    t, h, m = tag, h1_title(h1), F.coalesce(meta, F.lit(""))
    # only the classes of languages that pages have differ from the Latin one
    special = {c: dims.language_class(c) for c in sorted(dims.languages()) if dims.language_class(c) != r"a-zA-Z0-9\s"}
    pattern = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for c, k in special.items() for x in (c, f"[^{k}]")]), F.coalesce(language, F.lit(""))), F.lit(r"[^a-zA-Z0-9\s]"))
    bare = lambda x: F.regexp_replace(F.lower(x), pattern, "")
    ft, fh, fm = bare(t), bare(h), bare(m)
    hint = F.lower(F.regexp_replace(h, r"[^a-zA-Z0-9\ ]", ""))
    piece = F.when(F.contains(t, F.lit("|")), _split_title(t, "|", hint)).when(F.contains(t, F.lit("-")), _split_title(t, "-", hint)).when(F.contains(t, F.lit("_")), _split_title(t, "_", hint))
    piece = piece.when(F.contains(t, F.lit("/")), _split_title(t, "/", hint)).when(F.contains(t, F.lit(" » ")), _split_title(t, " » ", hint)).otherwise(t)
    piece = F.replace(piece, F.lit("&#65533;"), F.lit(""))
    chosen = (
        F.when(h == t, t)
        .when((fh != "") & (fh == fm), h)
        .when((fh != "") & (fm != "") & F.contains(ft, fh) & F.contains(ft, fm) & (F.octet_length(h) > F.octet_length(m)), h)
        .when((fm != "") & (fm != ft) & ft.startswith(fm), m)
        .otherwise(F.when((h != "") & (fh == bare(piece)), h).otherwise(piece))
    )
    return F.coalesce(F.trim(chosen), F.lit(""))


def language(meta_lang: Column, title_: Column, text: Column, override: str = "") -> Column:
    found = lang.detect(F.trim(F.concat(title_, F.lit(" "), text)))["lang"]
    return F.coalesce(F.lit(override or None), F.nullif(meta_lang, F.lit("")), F.nullif(found, F.lit("und")))


IOC_COLUMNS = {"Bitcoin": "bitcoins", "MD5": "md5s", "SHA1": "sha1s", "SHA256": "sha256s", "SHA512": "sha512s", "Domain": "domains", "Email": "emails", "IPv4": "ipv4s", "IPv6": "ipv6s", "URL": "other_urls", "File": "files", "CVE": "cves", "CAPEC": "capecs", "CWE": "cwes", "CPE": "cpes"}


def with_links(files: Column, found: Column) -> Column:
    """File names to the first address that ends with them."""
    return F.array_distinct(F.transform(files, lambda f: F.when(F.contains(f, F.lit("://")), f).otherwise(F.coalesce(F.get(F.filter(found, lambda u: u.endswith(f)), F.lit(0)), f))))


#: Columns of an article, and the facts that each needs.
COLUMNS: dict[str, str] = {
    "source_url": "", "title": "title_tag h1 meta_title meta_lang", "top_image": "top_image", "meta_img": "meta_img", "images": "images", "movies": "movies", "text": "text",
    "keywords": "title language text", "keyword_scores": "title language text", "meta_keywords": "meta_keywords", "tags": "", "authors": "authors", "publish_date": "publish_date", "summary": "title language text",
    "article_html": "article_html", "is_parsed": "is_null", "download_state": "is_null", "meta_description": "meta_description", "meta_lang": "meta_lang", "meta_favicon": "meta_favicon", "meta_site_name": "meta_site_name",
    "meta_data": "meta_data", "canonical_link": "canonical_link", "links": "links", "language": "title meta_lang raw_body", **{c: "raw_body" for c in IOC_COLUMNS.values()}, "files": "raw_body links",
    "valid_body": "text", "likely_article": "", "html": "html", "doc_html": "doc_html", "clean_doc_html": "clean_doc_html", "top_node_html": "top_node_html", "categories": "links html",
}
#: Columns that are large or dear and come only when asked for.
EXTRA = "html doc_html clean_doc_html top_node_html categories".split()


def _needed(columns: Iterable[str]) -> set[str]:
    out: set[str] = set()
    for c in columns:
        for x in COLUMNS[c].split():
            out |= _needed([x]) if x in ("title", "language") else {x}
    return out


def articles(pages: DataFrame, options: Options | None = None, only: Iterable[str] | None = None) -> DataFrame:
    """The articles of pages(page_id, url, html): all columns but EXTRA, or ``only`` some of COLUMNS.

    A page is parsed for what the columns need and no more. Nothing is shuffled (but for categories).
    A null html is a page that was not downloaded: is_parsed false, download_state 0, everything else as of an empty page.
    """
    options = options or Options()
    names = [c for c in COLUMNS if c in set(only)] if only is not None else [c for c in COLUMNS if c not in EXTRA]
    f = facts(pages, options, _needed(names))
    if "categories" in names:
        f = cut(f)  # read twice
        found = source.page_categories(f, options.compat).groupBy("page_id").agg(F.sort_array(F.collect_set("category")).alias("categories"))
        f = f.join(found, "page_id", "left")
    has = set(f.columns)
    if {"title_tag", "h1", "meta_title"} <= has:
        f = f.withColumn("title", title(F.col("title_tag"), F.col("h1"), F.col("meta_title"), F.nullif(F.col("meta_lang"), F.lit(""))))
    if {"title_tag", "raw_body"} <= has:
        f = f.withColumn("language", F.coalesce(language(F.col("meta_lang"), F.col("title"), F.col("raw_body"), options.language), F.nullif("meta_lang", F.lit("")), F.lit("en")))
    if {"keywords", "keyword_scores", "summary"} & set(names):
        f = f.withColumn("_d", nlp.digest(F.col("title"), F.col("text"), F.col("language"), options.max_keywords, options.max_sentences, options.tokenizer))
    empty = F.array().cast("array<string>")
    made = {
        "source_url": lambda: F.lit(""), "keywords": lambda: F.col("_d.keywords"), "keyword_scores": lambda: F.col("_d.scores"), "summary": lambda: F.col("_d.summary"),
        "meta_keywords": lambda: F.filter(F.transform(F.split("meta_keywords", ","), lambda x: F.trim(x)), lambda x: x != ""), "tags": lambda: F.create_map().cast("map<string,string>"),
        "is_parsed": lambda: ~F.col("is_null"), "download_state": lambda: F.when(F.col("is_null"), 0).otherwise(2), "valid_body": lambda: nlp.body_valid(F.col("text"), options.min_words),
        "likely_article": lambda: urls.likely_article(F.col("url")), "categories": lambda: F.coalesce("categories", empty),
        **{c: lambda kind=kind: ioc.matches(F.col("raw_body"), kind) for kind, c in IOC_COLUMNS.items()},
        "files": lambda: with_links(ioc.matches(F.col("raw_body"), "File"), F.concat(ioc.matches(F.col("raw_body"), "URL"), F.transform("links", lambda x: x.href))),
    }
    return f.select("page_id", "url", *[(made[c]() if c in made else F.col(c)).alias(c) for c in names])


_SHORT = sorted(["authors", "images", "keywords", "language", "meta_description", "movies", "publish_date", "summary", "text", "title", "top_image", "url", *IOC_COLUMNS.values()])
_FULL = sorted({*_SHORT, *EXTRA, "article_html", "canonical_link", "is_parsed", "keyword_scores", "meta_data", "meta_favicon", "meta_img", "meta_keywords", "meta_lang", "meta_site_name", "source_url", "tags"})


def to_json(of: DataFrame, full: bool = False) -> DataFrame:
    """(page_id, json): the short or the full form; keys in alphabetical order, nulls written, dates as RFC 3339.

    ``of`` has the columns SHORT or FULL; pages that are not parsed have no JSON and no row.
    """
    cols = [F.date_format("publish_date", "yyyy-MM-dd'T'HH:mm:ssXXX").alias(c) if c == "publish_date" else F.col(c) for c in (_FULL if full else _SHORT)]
    return of.where("is_parsed").select("page_id", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


SHORT, FULL = [*_SHORT, "is_parsed"], list(_FULL)


def to_text(of: DataFrame) -> DataFrame:
    """(page_id, out): the article for people to read."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, " "), F.lit("]"))
    form = "\n".join(f"{x}: %s" for x in ("Article Title", "URL", "Authors", "Publish Date", "Top Image", "Meta Description", "Keywords", "Summary", "Text"))
    return of.select("page_id", F.format_string(form, "title", "url", listed("authors"), F.coalesce(F.col("publish_date").cast("string"), F.lit("<nil>")), "top_image", "meta_description", listed("keywords"), "summary", "text").alias("out"))
