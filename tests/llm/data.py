"""Small tables with everything that has to have a defined result."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alder birch cedar dahlia elm fern gorse hazel iris juniper kelp larch maple nettle oak pine quince rowan sedge thyme umbel violet willow yarrow zinnia".split()


def prose(seed: int, n: int, sentence: int = 12) -> str:
    """Words from a vocabulary of 625 pairs, some lines."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS) + r.choice(WORDS)
        out.append(w + ("." if i % sentence == sentence - 1 else "") + ("\n" if i % (3 * sentence) == 3 * sentence - 1 else " "))
    return "".join(out).strip()


def edited(text: str, share: float, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("changed" + r.choice(WORDS) if r.random() < share else w for w in text.split(" "))


def hard_rows() -> list[tuple]:
    """Null, empty, blank, repeated, tied and very long documents among ordinary ones."""
    a, b = prose(1, 150), prose(2, 150)
    rows = [(i, prose(100 + i, 80 + i), "en", f"src{i % 4}", 5) for i in range(10)]
    rows += [(20, a, "en", "src0", 5), (21, a, "en", "src1", 5), (22, edited(a, 0.05, 3), "en", "src2", 5)]
    rows += [(30, b, "de", "src1", 5), (30, b, "de", "src1", 5)]  # a repeated row
    rows += [(40, None, "en", "src1", None), (41, "", "en", None, 0), (42, "  \n\n ", None, "src1", 4), (43, "word", "fr", "src9", 4), (44, "?!", "fr", "src9", 2)]
    rows += [(None, prose(5, 60), "en", "src3", 5), (None, None, None, None, None)]
    rows += [(50, prose(6, 30_000), "es", "src2", 5)]  # very long
    return rows


def frame(spark: SparkSession, rows: list[tuple], clash: bool = False) -> DataFrame:
    """documents; with clash also columns named like what operators add or use inside."""
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        for name in ("score", "keep", "row", "k", "t", "path", "size", "fail_mask", "dropped", "epoch", "name", "hash", "m", "w", "h", "x"):
            df = df.selectExpr("*", f"'own' AS `{name}`")
    return df


def save(spark: SparkSession, folder: Path, **tables: DataFrame) -> str:
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
