"""Language detection by evidence counts and softmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims

WORDS: dict[str, tuple[str, ...]] = {
    "de": ("das", "der", "die", "ein", "eine", "ist", "und"),
    "en": ("and", "in", "is", "of", "that", "the", "to"),
    "es": ("el", "en", "la", "las", "los", "que", "un", "una", "y"),
    "fr": ("des", "et", "la", "le", "les", "que", "un", "une"),
    "it": ("che", "di", "e", "il", "la", "un"),
    "nl": ("de", "een", "en", "het", "van"),
    "pl": ("i", "nie", "się", "w", "z", "że"),
    "pt": ("a", "da", "de", "do", "e", "o", "que"),
}
RESCALE, OVERFLOW, WEIGHT = 0.5, 709, 3


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def evidence(t: Column) -> dict[str, Column]:
    """Counts by code in a padded text: three for each stop word with spaces around it (not overlapping), one for 'und'."""

    def hits(word: str) -> Column:
        spaced = f" {word} "
        return ((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(spaced), F.lit("")))) / len(spaced.encode())).cast("int")

    out = {code: sum((hits(w) for w in words[1:]), hits(words[0])) * WEIGHT for code, words in WORDS.items()}
    return out | {"und": F.lit(1)}


def script_evidence(text: Column, codes: list[str]) -> dict[str, Column]:
    """Characters of each language's script; not part of the default evidence."""
    return {c: F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{dims.language_class(c)}]", "")) for c in codes if dims.languages().get(c, ("", ""))[1]}


def detect(text: Column, scripts: list[str] | None = None) -> Column:
    """struct(lang, probability): the code with most evidence (alphabetically first on ties), its softmax."""

    def entries(t: Column) -> Column:
        counts = evidence(t)
        for code, n in script_evidence(t, scripts or []).items():
            counts[code] = counts[code] + n if code in counts else n
        return F.array(*[F.struct(F.lit(c).alias("code"), counts[c].cast("int").alias("n")) for c in sorted(counts)])

    # a value is bound once by transform(array(value), ...), so the text is lower-cased and scanned once for each word
    best = lambda e: F.array_max(F.transform(e, lambda x: x.n))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + F.exp(x.n * RESCALE))
    return F.transform(
        F.transform(F.array(padded(text)), lambda t: F.filter(entries(t), lambda x: x.n > 0)),
        lambda e: F.struct(
            F.filter(e, lambda x: x.n == best(e))[0].code.alias("lang"),
            F.when(best(e) > OVERFLOW, F.lit(1.0)).otherwise(F.exp(best(e) * RESCALE) / total(e)).alias("probability"),
        ),
    )[0]
