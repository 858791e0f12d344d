"""URL algebra as column expressions: parts, public suffix, cleaning, joining, classification."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache
from urllib.parse import parse_qs, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dims

#: scheme, authority, path, query, fragment, by RFC 3986 appendix B.
RFC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, f"(?s){RFC}", i)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """Host without user and port."""
    return F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":[0-9]*$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(part(url, 2), r":([0-9]+)$", 1)


def path(url: Column) -> Column:
    return part(url, 3)


def chunks(of: Column) -> Column:
    """Non-empty pieces of a path."""
    return F.filter(F.split(of, "/"), lambda x: x != "")


def file_type(of: Column) -> Column:
    """Lower-cased ending of the last chunk of a path if it is short or known, else ''."""
    last = F.coalesce(F.try_element_at(chunks(of), F.lit(-1)), F.lit(""))
    ending = F.lower(F.regexp_extract(last, r"\.([^.]*)$", 1))
    return F.when((F.octet_length(ending) <= 5) | ending.isin(*dims.ARTICLE_TYPES), ending).otherwise("")


def is_absolute(url: Column) -> Column:
    return (scheme(url) != "") & (host(url) != "")


@cache
def suffix_rules() -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """(rules, wildcard rules, exceptions) where no list is given: the plain and a few two-part suffixes."""
    two = "ac co com edu gov net org".split()
    return frozenset([*dims.tlds(), *(f"{a}.{b}" for a in two for b in "uk jp nz za in kr br au il th".split())]), frozenset(), frozenset()


def load_suffixes(spark: SparkSession) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """The public suffix list that Spark's jars bring; the built-in rules where they don't."""
    stream = spark._jvm.Thread.currentThread().getContextClassLoader().getResourceAsStream("mozilla/public-suffix-list.txt")
    if stream is None:
        return suffix_rules()
    text = bytes(stream.readAllBytes()).decode("utf-8")
    rules = [x.split()[0] for x in text.split("\n") if x.strip() and not x.startswith("//")]
    ascii_form = [r if r.isascii() else r.encode("idna").decode() if not r.startswith("*") else r for r in rules]
    return (
        frozenset(r for r in ascii_form if r[0] not in "*!"),
        frozenset(r[2:] for r in ascii_form if r.startswith("*.")),
        frozenset(r[1:] for r in ascii_form if r.startswith("!")),
    )


def split_host(name: str, rules: tuple[frozenset[str], frozenset[str], frozenset[str]]) -> tuple[str, str, str]:
    """(subdomain, domain, suffix) of a host; all empty for bare labels and addresses."""
    labels = name.lower().rstrip(".").split(".")
    if len(labels) < 2 or re.fullmatch(r"[0-9.]+", name):
        return "", "", ""
    plain, wild, but = rules
    start = len(labels) - 1
    for i in range(len(labels)):
        tail = ".".join(labels[i:])
        if tail in but:
            start = i + 1
            break
        if tail in plain or ".".join(labels[i + 1 :]) in wild:
            start = i
            break
    if start == 0:  # the host is itself a suffix
        start = 1
    return ".".join(labels[: start - 1]), labels[start - 1], ".".join(labels[start:])


def suffix_parts(rules: tuple[frozenset[str], frozenset[str], frozenset[str]]) -> Callable[[Column], Column]:
    """Column function host -> struct(subdomain, domain, tld); each distinct host of a batch is split once."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("subdomain", "domain", "tld")]))
    def parts(hosts: pd.Series) -> pd.DataFrame:
        codes, names = pd.factorize(hosts.fillna(""))
        split = pd.DataFrame([split_host(n, rules) for n in names], columns=["subdomain", "domain", "tld"])
        return split.iloc[codes].reset_index(drop=True)

    return parts


def parsed(df: DataFrame, url: str) -> DataFrame:
    """df with ``u``: struct(scheme, host, port, path, raw_query, fragment, file_type, subdomain, domain, tld)."""
    c = F.col(url)
    parts = suffix_parts(load_suffixes(df.sparkSession))
    with_host = df.withColumn("_h", host(c)).withColumn("_s", parts(F.col("_h")))
    return with_host.withColumn(
        "u",
        F.struct(scheme(c).alias("scheme"), F.col("_h").alias("host"), port(c).alias("port"), path(c).alias("path"), part(c, 4).alias("raw_query"), part(c, 5).alias("fragment"), file_type(path(c)).alias("file_type"), "_s.subdomain", "_s.domain", "_s.tld"),
    ).drop("_h", "_s")


def clean(url: Column) -> Column:
    """Without fragment and tracking parameters; parameters sorted by name, doubled slashes of the path single."""
    base = F.regexp_replace(url, "(?s)#.*$", "")
    pairs = F.filter(F.split(part(base, 4), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).isin(*sorted(dims.TRACKING_PARAMS)))
    named = F.transform(pairs, lambda p, i: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    query = F.array_join(F.transform(F.array_sort(named), lambda x: x.p), "&")
    front = F.regexp_extract(base, r"^((?:[^:/?#]+:)?(?://[^/?#]*)?)", 1)
    return F.concat(front, F.replace(path(base), F.lit("//"), F.lit("/")), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


@F.pandas_udf(T.StringType())
def join(base: pd.Series, relative: pd.Series) -> pd.Series:
    """RFC 3986 reference resolution; what does not parse stays as it is."""

    def one(b: str | None, r: str | None) -> str | None:
        if r is None:
            return None
        try:
            return urljoin(b or "", r)
        except ValueError:
            return r

    return pd.Series([one(b, r) for b, r in zip(base, relative, strict=True)], dtype=object)


def redirect_back(url: Column) -> Column:
    """The address in the ``url`` parameter if there is one."""
    inner = F.regexp_extract(part(url, 4), r"(?:^|&)url=([^&]+)", 1)
    return F.when(inner != "", F.coalesce(F.try_url_decode(inner), url)).otherwise(url)


def prepare(url: Column, source: Column) -> Column:
    """Joined with its source, redirected back and cleaned; '' where the source is no address."""
    return F.when((source != "") & ~is_absolute(source), F.lit("")).otherwise(clean(redirect_back(F.when(is_absolute(url) | (source == ""), url).otherwise(join(source, url)))))


#: Year, month and day as pieces of a path.
DATED = "/[0-9]{4}(?:/[0-9]{1,2}){2}/"


def likely_article(url: Column) -> Column:
    """By stop and good pieces of the path, a date in it, or a query."""
    p = path(url)
    has = lambda c, words: F.greatest(*[F.contains(c, F.lit(w)) for w in words])
    return (
        F.when(has(p, dims.NOT_ARTICLE), False)
        .when(F.contains(url, F.lit("/item?id=")), True)
        .when(has(p, dims.ARTICLE), True)
        .when(url.rlike(DATED), True)
        .otherwise(part(url, 4) != "")
    )


def valid_category(u: Column, url: Column) -> Column:
    """Is a parsed address (``parsed``) that of a category page: one short chunk, or a known prefix and one more."""
    c = chunks(u["path"])
    rest = F.concat(F.slice(c, 1, F.greatest(F.array_position(c, "index.html") - 1, F.lit(0)).cast("int")), F.slice(c, (F.array_position(c, "index.html") + 1).cast("int"), F.lit(1 << 20)))
    kept = F.when(F.array_contains(c, "index.html"), rest).otherwise(c)
    ok = (url != "") & (u["host"] != "") & (u["tld"] != "") & (u["domain"] != "") & u["scheme"].isin("http", "https", "") & (u["raw_query"] == "") & (u["fragment"] == "")
    ok = ok & F.size(kept).isin(1, 2) & ~F.exists(kept, lambda x: x.startswith("_") | x.startswith("#"))
    one = F.octet_length(kept[0]).between(2, 19)
    return F.coalesce(ok & F.when(F.size(kept) == 2, kept[0].isin(*dims.CATEGORY_PREFIXES)).otherwise(one), F.lit(False))


_SEP, _DAY = r"[./\-_\s]", "[0-3]?[0-9]"
_DATE = rf"(?:{_SEP}?(?:19|20)[0-9]{{2}}){_SEP}?(?:(?:{_DAY}|\w{{3,5}}){_SEP}){_DAY}(?:[./\-+?]|$)"


def valid_news(u: Column, url: Column) -> Column:
    """Is a parsed address that of a news article: known types, no bad chunk or domain, a long slug, a date, a number or a good chunk."""
    c0 = chunks(F.regexp_replace(u["path"], "/$", ""))
    last = F.coalesce(F.try_element_at(c0, F.lit(-1)), F.lit(""))
    bare = F.when(F.contains(last, F.lit(".")), F.element_at(F.split(last, r"\."), -2)).otherwise(last)
    c = F.filter(F.concat(F.slice(c0, 1, F.greatest(F.size(c0) - 1, F.lit(0))), F.when(F.size(c0) > 0, F.array(bare)).otherwise(F.array().cast("array<string>"))), lambda x: x != "index")
    slug = F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(""))
    dashes, bars = F.length(slug) - F.length(F.replace(slug, F.lit("-"), F.lit(""))), F.length(slug) - F.length(F.replace(slug, F.lit("_"), F.lit("")))
    pieces = F.when(dashes >= bars, F.split(slug, "-")).otherwise(F.split(slug, "_"))
    brand = F.lower(u["domain"])
    known, size = u["file_type"].isin(*dims.ARTICLE_TYPES), F.size(c)
    digits = lambda x: x.rlike(r"[0-9]{3,}$")
    return F.coalesce(
        F.when(F.contains(url, F.lit("mailto:")) | ~url.rlike("https?://") | ~u["path"].startswith("/"), False)
        .when((F.size(c0) > 0) & (u["file_type"] != "") & ~known, False)
        .when((u["domain"] == "") | brand.isin(*dims.BAD_DOMAINS), False)
        .when(((dashes > 4) | (bars > 4)) & ~F.exists(pieces, lambda x: F.lower(x) == brand), True)
        .when(size <= 1, False)
        .when(F.arrays_overlap(c, F.array(*[F.lit(x) for x in dims.BAD_CHUNKS])) | u["subdomain"].isin(*dims.BAD_CHUNKS), False)
        .when(url.rlike(_DATE), True)
        .when((size <= 3) & digits(slug), True)
        .when((size == 3) & digits(F.get(c, F.lit(1))), True)
        .when(F.exists(c, lambda x: F.lower(x).isin(*dims.GOOD_PATHS)), True)
        .otherwise((u["file_type"] != "") & known),
        F.lit(False),
    )


def is_asset(url: Column) -> Column:
    return F.greatest(*[F.contains(F.lower(url), F.lit(e)) for e in dims.ASSETS])


def no_stop_chunk(u: Column) -> Column:
    """No chunk of the path and no label of the subdomain is a stop word of addresses."""
    return ~F.arrays_overlap(F.concat(chunks(u["path"]), F.split(u["subdomain"], r"\.")), F.array(*[F.lit(x) for x in sorted(dims.URL_STOPWORDS)]))


def naive_domain(url: Column) -> Column:
    """The second label of the host from the right."""
    return F.coalesce(F.try_element_at(F.split(host(url), r"\."), F.lit(-2)), F.lit(""))


def feed_candidates(df: DataFrame, url: str) -> DataFrame:
    """(url, feed): each address with each of the common feed endings."""
    endings = F.array(*[F.lit(x) for x in dims.FEED_SUFFIXES])
    return df.select(url, F.explode(F.transform(endings, lambda e: F.concat(F.regexp_replace(F.col(url), "/+$", ""), e))).alias("feed"))


def query_value(query: str, name: str) -> str | None:
    """First value of a parameter of a raw query."""
    return (parse_qs(query).get(name) or [None])[0]
