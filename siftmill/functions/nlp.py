"""Tokens, sentences, keywords and summaries.

Tokens are runs of letters and digits, or single other signs, of the lower-cased text
(CJK languages: runs of ASCII letters, digits and ``_``, or single signs, case kept).
Ties are broken by first position and then by the string.

A row's work needs its row only, so nothing here shuffles: a batch goes to Python once as
Arrow and comes back as the rows that the query asks for, no token ever becomes a row of
Spark. Rows that share a key are each handled by itself; a null or empty text has no tokens
and no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, MapType, StringType, StructField, StructType

from . import dims

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
CJK_TOKEN = r"[0-9A-Za-z_]+|[^ \n\t\r0-9A-Za-z_]"
#: Value of a place by tenths of the text, from the first.
POSITIONS = (0.17, 0.23, 0.14, 0.08, 0.05, 0.04, 0.06, 0.04, 0.04, 0.15)
MEAN_SENTENCE, SUMMARY_KEYWORDS, MAX_KEYWORDS, MAX_SENTENCES, MIN_WORDS = 20, 10, 35, 5, 300


def tokens(text: Column, lang: Column | None = None) -> Column:
    plain = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    if lang is None:
        return plain
    return F.when(lang.isin("zh", "ja", "ko"), F.regexp_extract_all(text, F.lit(CJK_TOKEN), F.lit(0))).otherwise(plain)


def sentences(text: Column) -> Column:
    """Trimmed pieces between ``.!?`` of more than ten bytes."""
    trimmed = F.transform(F.split(text, "[.!?]+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: F.octet_length(x) > 10)


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def body_valid(text: Column, least: int = MIN_WORDS) -> Column:
    return F.size(words(text)) >= least


def clean_keyword(word: Column) -> Column:
    """ASCII letters only, lower case; '' if fewer than three are left."""
    letters = F.lower(F.regexp_replace(word, "[^A-Za-z]", ""))
    return F.when(F.length(letters) >= 3, letters).otherwise("")


# the same in Python, a row at a time within an Arrow batch

_SPACE = " \t\n\x0b\f\r"
_TOKEN = re.compile(r"[^\W_]+|[^\w \t\n\x0b\f\r]|_")
_CJK_TOKEN = re.compile(CJK_TOKEN)
_ENDS, _SPACES, _NO_LETTERS = re.compile("[.!?]+"), re.compile(r"[ \t\n\x0b\f\r]+"), re.compile("[^A-Za-z]")
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
#: Bytes of text, and rows, that are Python objects at a time, however large Spark's batches are.
_BYTES, _ROWS = 1 << 20, 256


def tokens_of(text: str, lang: str | None = None) -> list[str]:
    return _CJK_TOKEN.findall(text) if lang in ("zh", "ja", "ko") else _TOKEN.findall(text.lower())


def sentences_of(text: str) -> list[str]:
    return [x for x in (x.strip(_SPACE) for x in _ENDS.split(text)) if len(x.encode()) > 10]


def words_of(text: str) -> list[str]:
    return [x for x in _SPACES.split(text) if x]


def clean_of(word: str) -> str:
    letters = _NO_LETTERS.sub("", word).lower()
    return letters if len(letters) >= 3 else ""


def keywords_of(text: str, lang: str | None, k: int | None = MAX_KEYWORDS) -> list[tuple[str, int, float]]:
    """(token, freq, score) of the k most frequent tokens that are no stop words."""
    every = tokens_of(text)
    stop = dims.stopwords_for(lang)
    counts = [x for x in Counter(every).items() if x[0] not in stop]  # in the order of first places
    counts.sort(key=lambda x: -x[1])
    return [(t, n, n * 1.5 / len(every) + 1) for t, n in counts[:k]]


def filtered_of(found: list[tuple[str, int, float]], lang: str | None) -> dict[str, float]:
    """Keywords cleaned: letters only, over three of them, no stop word; of equal forms the best score."""
    stop = dims.stopwords_for(lang)
    out: dict[str, float] = {}
    for token, _, score in found:
        clean = clean_of(token)
        if len(clean) > 3 and clean != "unk" and clean not in stop:
            out[clean] = max(score, out.get(clean, score))
    return out


def with_title_of(found: dict[str, float], title: str | None, lang: str | None) -> list[tuple[str, float]]:
    """Keywords, the best first, boosted by half if in the title; other title words get 0.1. None without any keyword."""
    if not found:
        return []
    stop = dims.stopwords_for(lang)
    inside = {clean_of(w) for w in words_of((title or "").lower())} - {""} - stop
    scored = {k: s * 1.5 if k in inside else s for k, s in found.items()} | {w: 0.1 for w in inside if w not in found}
    return sorted(scored.items(), key=lambda x: (-x[1], x[0]))


def position_score(i: int, size: int) -> float:
    """Value of a sentence's place, from 1: the end points 0.1 and 1.0 belong to the step below them."""
    p = i / size
    return 0.0 if p > 1 else next((POSITIONS[t] for t in range(9, -1, -1) if p > t / 10), 0.0)


def scores_of(title: str | None, text: str, lang: str | None) -> list[tuple]:
    """(idx, sentence, title_score, sbs, dbs, length_score, position_score, score) of every sentence.

    The four features weigh 1.5 (title), 2 (keywords), 1 and 1, over 4.
    """
    pieces = sentences_of(text)
    if not pieces:
        return []
    keys = {t: s for t, _, s in keywords_of(text, lang, SUMMARY_KEYWORDS)}
    stop = dims.stopwords_for(lang)
    heads = [t for t in tokens_of(title or "") if t not in stop]
    inside = frozenset(heads)
    out = []
    for idx, piece in enumerate(pieces):
        t = tokens_of(piece)
        hits = [(pos, x, keys[x]) for pos, x in enumerate(t) if x in keys]
        title_score = sum(x in inside for x in t) / len(heads) if heads else 0.0
        sbs = sum(s for _, _, s in hits) / len(t) / 10.0 if t else 0.0
        near = sum(a[2] * b[2] / float((b[0] - a[0]) ** 2) for a, b in zip(hits, hits[1:], strict=False))
        k = len({x for _, x, _ in hits}) + 1
        dbs = near / (k * (k + 1.0)) if hits else 0.0
        length = 1 - abs(MEAN_SENTENCE - len(t)) / float(MEAN_SENTENCE)
        position = position_score(idx + 1, len(pieces))
        out.append((idx, piece, title_score, sbs, dbs, length, position, (title_score * 1.5 + (sbs + dbs) / 2.0 * 10.0 * 2.0 + length + position) / 4.0))
    return out


def summary_of(title: str | None, text: str, lang: str | None, top: int = MAX_SENTENCES) -> str | None:
    """The best sentences in the order of the text; none without a title."""
    best = sorted(scores_of(title, text, lang), key=lambda x: (-x[-1], x[0]))[:top] if title else []
    return " ".join(x[1] for x in sorted(best)) if best else None


def basic_of(text: str, lang: str | None, k: int = MAX_KEYWORDS) -> list[tuple[str, float]]:
    """(keyword, score): the fallback without a tokenizer: cleaned words, term frequency."""
    stop = dims.stopwords_for(lang)
    counts = Counter(x for x in map(clean_of, words_of(text.lower())) if x and x not in stop)
    total = sum(counts.values())
    return [(w, n / total) for w, n in sorted(counts.items(), key=lambda x: -x[1])[:k]]


def basic_summary_of(text: str, keywords: list[str], top: int = MAX_SENTENCES) -> str | None:
    """Pieces between dots, by keywords in them and half a point for 6 to 29 words."""
    pieces = [x for x in (x.strip(_SPACE) for x in text.split(".")) if x]
    known = frozenset(keywords)
    scored = []
    for idx, piece in enumerate(pieces):
        w = words_of(piece.lower())
        scored.append((-(sum(x in known for x in w) + (0.5 if 5 < len(w) < 30 else 0.0)), idx, piece))
    out = ". ".join(x[2] for x in sorted(scored)[:top])
    return (out if out.endswith(".") else f"{out}.") if pieces else None


def slices(columns: list[pa.Array]) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows with up to _BYTES bytes of strings, or one row, and _ROWS rows."""
    n = len(columns[0])
    sizes = [pc.fill_null(pc.cast(pc.binary_length(c), pa.int64()), 0).to_numpy(zero_copy_only=False) for c in columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
    ends = sum(sizes).cumsum() if sizes else []
    start = 0
    while start < n:
        before = ends[start - 1] if sizes and start else 0
        stop = int(ends.searchsorted(before + _BYTES, "right")) if sizes else n
        stop = min(max(stop, start + 1), start + _ROWS, n)
        yield start, stop - start
        start = stop


def _each(df: DataFrame, key: str, columns: list[str], ddl: str, rows: Callable[..., list[tuple]]) -> DataFrame:
    """(key, ddl...): the rows that ``rows`` makes of the columns' values, for each row of df."""
    kind = dict(df.select(key).dtypes)[key]
    names = [x.split()[0] for x in ddl.split(", ")]
    types = [_ARROW[x.split()[1]] for x in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, length in slices(batch.columns[1:]):
                part = batch.slice(start, length)
                out: list[tuple] = []
                owner: list[int] = []
                for i, values in enumerate(zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)):
                    new = rows(*values)
                    out += new
                    owner += [i] * len(new)
                if out:
                    made = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)]
                    yield pa.record_batch([part.column(0).take(pa.array(owner, pa.int64())), *made], [key, *names])

    return df.select(F.col(key), *[F.col(c) for c in columns]).mapInArrow(run, f"`{key}` {kind}, {ddl}")


def stopword_stats(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, n_tokens, n_stop)"""

    def rows(t: str | None, c: str | None) -> list[tuple]:
        counts = Counter(tokens_of(t or ""))
        stop = dims.stopwords_for(c)
        return [(counts.total(), sum(n for w, n in counts.items() if w in stop))] if counts else []

    return _each(df, key, [text, lang], "n_tokens long, n_stop long", rows)


def keywords(df: DataFrame, key: str, text: str, lang: str, k: int = MAX_KEYWORDS) -> DataFrame:
    """(key, token, freq, score, rank): the k most frequent tokens that are no stop words; score 1 + 1.5 * share."""
    return _each(df, key, [text, lang], "token string, freq long, score double, rank int", lambda t, c: [(*x, i) for i, x in enumerate(keywords_of(t or "", c, k), 1)])


def filtered_keywords(df: DataFrame, key: str, text: str, lang: str, k: int = MAX_KEYWORDS) -> DataFrame:
    """(key, keyword, score): cleaned keywords of each row."""
    return _each(df, key, [text, lang], "keyword string, score double", lambda t, c: list(filtered_of(keywords_of(t or "", c, k), c).items()))


def sentence_scores(df: DataFrame, key: str, title: str, text: str, lang: str) -> DataFrame:
    """(key, idx, sentence, title_score, sbs, dbs, length_score, position_score, score) of every sentence."""
    ddl = "idx int, sentence string, title_score double, sbs double, dbs double, length_score double, position_score double, score double"
    return _each(df, key, [title, text, lang], ddl, lambda h, t, c: scores_of(h, t or "", c))


def summary(df: DataFrame, key: str, title: str, text: str, lang: str, top: int = MAX_SENTENCES) -> DataFrame:
    """(key, summary): the best sentences in the order of the text; none without a title."""
    return _each(df, key, [title, text, lang], "summary string", lambda h, t, c: [(s,) for s in [summary_of(h, t or "", c, top)] if s is not None])


def basic_keywords(df: DataFrame, key: str, text: str, lang: str, k: int = MAX_KEYWORDS) -> DataFrame:
    """(key, keyword, score, rank): the fallback without a tokenizer."""
    return _each(df, key, [text, lang], "keyword string, score double, rank int", lambda t, c: [(*x, i) for i, x in enumerate(basic_of(t or "", c, k), 1)])


def basic_summary(df: DataFrame, key: str, text: str, lang: str, k: int = MAX_KEYWORDS, top: int = MAX_SENTENCES) -> DataFrame:
    """(key, summary): the fallback's summary, by its keywords."""
    return _each(df, key, [text, lang], "summary string", lambda t, c: [(s,) for s in [basic_summary_of(t or "", [w for w, _ in basic_of(t or "", c, k)], top)] if s is not None])


_DIGEST = StructType([StructField("keywords", ArrayType(StringType())), StructField("scores", MapType(StringType(), DoubleType())), StructField("summary", StringType())])
_DIGEST_ARROW = pa.struct([("keywords", pa.list_(pa.string())), ("scores", pa.map_(pa.string(), pa.float64())), ("summary", pa.string())])


def digest(title: Column, text: Column, lang: Column, k: int = MAX_KEYWORDS, top: int = MAX_SENTENCES, tokenizer: bool = True) -> Column:
    """struct(keywords, scores, summary) of an article: the list is cut to k, the scores are not.

    Without the tokenizer: the fallback's keywords and summary.
    """

    def one(h: str | None, t: str, c: str | None) -> dict:
        if tokenizer:
            ranked, short = with_title_of(filtered_of(keywords_of(t, c, k), c), h, c), summary_of(h, t, c, top)
        else:
            ranked = basic_of(t, c, k)
            short = basic_summary_of(t, [w for w, _ in ranked], top)
        return {"keywords": [w for w, _ in ranked[:k]], "scores": ranked, "summary": short or ""}

    def run(h: pa.Array, t: pa.Array, c: pa.Array, h_again: pa.Array, c_again: pa.Array) -> pa.Array:
        given = (h, pc.fill_null(t, ""), c)
        made = [pa.array([one(*x) for x in zip(*(x.slice(*at).to_pylist() for x in given), strict=True)], _DIGEST_ARROW) for at in slices([h, t])]
        return pa.concat_arrays(made) if made else pa.array([], _DIGEST_ARROW)

    run.__annotations__ = dict.fromkeys(["h", "t", "c", "h_again", "c_again", "return"], pa.Array)
    # Title and language go in twice, as what is used twice is not inlined: a call with lambdas in its arguments is not
    # recognised when calls are taken out of a projection (its lambdas are numbered anew), and can't be evaluated then.
    return F.arrow_udf(run, _DIGEST)(title, text, lang, title, lang)
