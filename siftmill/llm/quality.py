"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the counts behind all measurements come from
one vectorised pass over the UTF-8 bytes of a batch. The ledger (``stored``) holds the
measurements and one integer whose bit i says that rule i failed, so that a policy is a
mask: a policy version rejects a document when ``fail_mask & mask <> 0``, and the effect
of adding or leaving out rules is found by aggregating masks, without reading a text again.

Defined results: a null text counts as empty. A ratio over nothing is 0. The ledger has
one row for each input row, so repeated rows repeat and a null doc_id stays null. Other
columns of the input are ignored. Length does not matter: all measurements are totals
over the whole text.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import textkit
from .common import chunks, documents, fresh

SYMBOLS = r"[#$%&*|<>=~^{}\\@_+]"

#: name and test over the measurements m, in SQL that Spark and DuckDB share. The position is the bit.
RULES: list[tuple[str, str]] = [
    ("no_words", "m.n_words = 0"),
    ("few_words", "m.n_words < 5"),
    ("upper_case", "m.n_letters >= 20 AND m.upper_ratio > 0.5"),
    ("symbols", "m.n_words >= 5 AND m.symbol_ratio > 0.3"),
    ("shouting", "m.n_words >= 5 AND m.bang_ratio > 0.3"),
    ("stutter", "m.n_words >= 5 AND m.stutter_ratio > 0.3"),
    ("not_letters", "m.n_words >= 5 AND m.letter_ratio < 0.5"),
    ("word_length", "m.n_words >= 5 AND (m.mean_word < 2 OR m.mean_word > 20)"),
    ("repeated_lines", "m.n_lines >= 4 AND m.line_ratio < 0.5"),
    ("braces", "m.n_words >= 5 AND m.brace_ratio > 0.1"),
]
#: Measurement and the counts that it divides (the second None: a count as it is).
MEASURES: list[tuple[str, str, str | None]] = [
    ("n_words", "n_words", None),
    ("n_letters", "n_letters", None),
    ("n_lines", "n_lines", None),
    ("upper_ratio", "n_upper", "n_letters"),
    ("symbol_ratio", "n_symbols", "n_words"),
    ("bang_ratio", "n_bangs", "n_words"),
    ("stutter_ratio", "n_stutter", "n_words"),
    ("letter_ratio", "n_letters", "n_solid"),
    ("mean_word", "n_solid", "n_words"),
    ("line_ratio", "n_lines_distinct", "n_lines"),
    ("brace_ratio", "n_braces", "n_words"),
]


def bits(*names: str) -> int:
    at = [name for name, _ in RULES]
    return sum(1 << at.index(name) for name in names)


#: Policy versions: the rules whose failure rejects a document.
POLICIES: dict[str, int] = {
    "v1": bits("no_words", "upper_case", "symbols", "not_letters"),
    "v2": bits("no_words", "upper_case", "symbols", "shouting", "stutter", "not_letters", "word_length", "repeated_lines", "braces"),
}
CURRENT = "v2"

COUNTS = ["n_words", "n_letters", "n_upper", "n_symbols", "n_bangs", "n_braces", "n_solid", "n_stutter", "n_lines", "n_lines_distinct"]

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 12, 13, 32]] = True
_SOLID, _IN_LINE = (~_BLANK).astype(np.int8), (np.arange(256) != 10).astype(np.int8)


def _signs(signs: str) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(signs.encode(), np.uint8))


_SYMBOL, _BRACE, _BANG = _signs("#$%&*|<>=~^{}\\@_+"), _signs("{}[]<>;"), _signs("!")
_UPPER = _signs("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _signs("abcdefghijklmnopqrstuvwxyz")


@cache
def _categories() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and capital letters."""
    kinds = [unicodedata.category(chr(i)) for i in range(0x110000)]
    return np.array([k[0] == "L" for k in kinds]), np.array([k == "Lu" for k in kinds])


def _code_points(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of the sequences of two bytes or more that start at these places."""
    lead = raw[at].astype(np.int32)
    more = [raw[np.minimum(at + i, len(raw) - 1)].astype(np.int32) & 63 for i in (1, 2, 3)]
    two = (lead & 31) << 6 | more[0]
    three = (lead & 15) << 12 | more[0] << 6 | more[1]
    four = (lead & 7) << 18 | more[0] << 12 | more[1] << 6 | more[2]
    return np.minimum(np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four)), 0x10FFFF)


def _measured(column: pa.Array) -> list[np.ndarray]:
    """COUNTS of every text of a column, in one pass over its bytes."""
    raw, offsets = textkit.utf8(column)

    def total(flags: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(flags, out=upto[1:])
        return np.diff(upto[offsets])

    wide = np.flatnonzero(raw >= 0xC0)  # where code points beyond ASCII start
    letter, upper = _LETTER[raw], _UPPER[raw]
    if len(wide):
        letters, capitals = _categories()
        points = _code_points(raw, wide)
        letter[wide], upper[wide] = letters[points], capitals[points]
    words, lines = textkit.cut(raw, offsets, _SOLID), textkit.cut(raw, offsets, _IN_LINE, 10)
    again = np.zeros(len(words.hash), np.int64)
    again[1:] = words.hash[1:] == words.hash[:-1]
    again[words.first[:-1][words.first[:-1] < len(again)]] = 0
    upto = np.append(0, np.cumsum(again))
    # lines of spaces only don't count
    solid = np.append(0, np.cumsum(lines.data != 32))
    real = np.flatnonzero(solid[lines.end] > solid[lines.start])
    row, sign = lines.doc()[real], lines.hash[real]
    order = np.lexsort((sign, row))
    row, sign = row[order], sign[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (sign[1:] != sign[:-1])
    rows = len(offsets) - 1
    return [
        np.diff(words.first), total(letter), total(upper), total(_SYMBOL[raw]), total(_BANG[raw]), total(_BRACE[raw]),
        total((raw & 0xC0) != 0x80) - total(_BLANK[raw]), np.diff(upto[words.first]), np.bincount(row, minlength=rows), np.bincount(row[new], minlength=rows),
    ]


@F.arrow_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def _counted(text: pa.Array) -> pa.Array:
    parts = [_measured(b.column(0)) for b in chunks(iter([pa.record_batch([text], ["text"])]))]
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], COUNTS)


def _ratios(c: str) -> Column:
    """The struct of measurements from that of counts."""
    each = (f"'{k}', {c}.{a}" if b is None else f"'{k}', CASE WHEN {c}.{b} > 0 THEN CAST({c}.{a} AS DOUBLE) / CAST({c}.{b} AS DOUBLE) ELSE 0D END" for k, a, b in MEASURES)
    return F.expr(f"named_struct({', '.join(each)})")


def _mask(suffix: str = "") -> str:
    return " + ".join(f"CASE WHEN {test} THEN {1 << i}{suffix} ELSE 0{suffix} END" for i, (_, test) in enumerate(RULES))


def _evaluated(docs: DataFrame) -> DataFrame:
    """(row: all columns of docs, m: measurements, fail_mask): the text alone goes to Python, once."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    counted = docs.select(row, _counted(F.col("text")).alias("c"))
    return counted.select("row", _ratios("c").alias("m")).withColumn("fail_mask", F.expr(_mask("L")))


def _kept(mask: int) -> Column:
    return F.col("fail_mask").bitwiseAND(F.lit(mask).cast("long")) == 0


def ledger(docs: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, fail_mask, measurements..., keep_<version>...) of every row of docs."""
    policies = POLICIES if policies is None else policies
    out = _evaluated(docs.select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "fail_mask", *[F.col(f"m.{k}").alias(k) for k, _, _ in MEASURES], *[_kept(m).alias(f"keep_{v}") for v, m in policies.items()])


def stored(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The ledger, written to the shared folder (or path) and read from there: (doc_id, text_hash, fail_mask, measurements...).

    Policies and ablations of later days need this table only, no text.
    """
    path = path or fresh(docs.sparkSession, "ledger")
    out = _evaluated(docs.select("doc_id", "text"))
    out.select(F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("text_hash"), "fail_mask", *[F.col(f"m.{k}").alias(k) for k, _, _ in MEASURES]).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def accept(docs: DataFrame, version: str = CURRENT, led: DataFrame | None = None) -> DataFrame:
    """The rows of docs that the policy keeps, all columns as they were.

    Without a stored ledger the rules are evaluated in passing, without a shuffle; with one they
    are not evaluated at all, and a join finds the masks by doc_id and hash of the text. A
    row that the ledger does not know stays out.
    """
    if led is None:
        return _evaluated(docs).where(_kept(POLICIES[version])).select("row.*")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"))
    good = led.where(_kept(POLICIES[version])).select(F.col("doc_id").alias("d_led"), F.col("text_hash").alias("t_led"))
    return row.join(good, F.col("d").eqNullSafe(F.col("d_led")) & (F.col("t") == F.col("t_led")), "left_semi").select("row.*")


def ablation(led: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """What each rule does in each policy: (version, rule, n_fail, n_only, kept, kept_without).

    One aggregation to distinct masks (at most 2 ** rules rows), then bit arithmetic on
    those. n_only: documents that no other rule of the policy rejects.
    """
    policies = POLICIES if policies is None else policies
    masks = led.groupBy("fail_mask").agg(F.count(F.lit(1)).alias("n"))
    grid = [(v, name, m, 1 << i) for v, m in policies.items() for i, (name, _) in enumerate(RULES) if m >> i & 1]
    row = lambda v, name, m, bit: F.struct(F.lit(v).alias("version"), F.lit(name).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(bit).cast("long").alias("bit"))
    both = masks.select("fail_mask", "n", F.inline(F.array(*[row(*g) for g in grid])))
    failed = F.col("fail_mask").bitwiseAND(F.col("mask"))
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return both.groupBy("version", "rule").agg(
        total(failed.bitwiseAND(F.col("bit")) != 0).alias("n_fail"),
        total(failed == F.col("bit")).alias("n_only"),
        total(failed == 0).alias("kept"),
        total(failed.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(documents(spark, sf_dir))


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every rule of every policy does, from a stored ledger of all documents."""
    return ablation(stored(documents(spark, sf_dir)))


_COUNTS_SQL = rf"""
  SELECT doc_id,
    CAST(len(w) AS BIGINT) AS n_words,
    CAST(len(regexp_extract_all(t, '\p{{L}}')) AS BIGINT) AS n_letters,
    CAST(len(regexp_extract_all(t, '\p{{Lu}}')) AS BIGINT) AS n_upper,
    CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_bangs,
    CAST(len(regexp_extract_all(t, '[\[\]{{}}<>;]')) AS BIGINT) AS n_braces,
    CAST(length(regexp_replace(t, '[ \t\r\n\f]', '', 'g')) AS BIGINT) AS n_solid,
    CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_stutter,
    CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(list_distinct(l)) AS BIGINT) AS n_lines_distinct
  FROM (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\r\n\f]+'), lambda x: x <> '') AS w,
               list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS l
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""

SQL = (
    "SELECT doc_id, CAST(fail_mask AS BIGINT) AS fail_mask, " + ", ".join(k for k, _, _ in MEASURES) + ", "
    + ", ".join(f"(fail_mask & {m}) = 0 AS keep_{v}" for v, m in POLICIES.items())
    + f" FROM (SELECT m.*, {_mask()} AS fail_mask FROM (SELECT doc_id, "
    + ", ".join(f"{a} AS {k}" if b is None else f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0.0 END AS {k}" for k, a, b in MEASURES)
    + f" FROM ({_COUNTS_SQL})) m)"
)


def _ablation_sql() -> str:
    grid = " UNION ALL ".join(f"SELECT '{v}' AS version, '{name}' AS rule, {m} AS mask, {1 << i} AS bit" for v, m in POLICIES.items() for i, (name, _) in enumerate(RULES) if m >> i & 1)
    total = lambda test: f"CAST(coalesce(sum(n) FILTER (WHERE {test}), 0) AS BIGINT)"
    return f"""WITH led AS ({SQL}), masks AS (SELECT fail_mask, count(*) AS n FROM led GROUP BY fail_mask), grid AS ({grid})
SELECT version, rule, {total("(fail_mask & mask & bit) <> 0")} AS n_fail, {total("(fail_mask & mask) = bit")} AS n_only, {total("(fail_mask & mask) = 0")} AS kept, {total("(fail_mask & mask & ~bit) = 0")} AS kept_without
FROM masks, grid GROUP BY version, rule"""


ABLATION_SQL = _ablation_sql()
