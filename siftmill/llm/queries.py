"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, linededup, mixing, nbsvm, quality, setjoin, suffixes, toxicity, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontam.query,
    "op2_mixing": mixing.query,
    "op3_quality_rules": quality.query,
    "quality_ablation": quality.ablation_query,  # the second half of op3: from the stored ledger
    "op4_toxicity": toxicity.query,
    "op5_url_filter": urlfilter.query,
    "op6_line_dedup": linededup.query,
    "op7_jaccard_join": setjoin.query,
    "op8_quality_classifier": nbsvm.query,
    "op9_warc": warc.query,
    "op10_suffix_dedup": suffixes.query,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.SQL,
    "op3_quality_rules": quality.SQL,
    "quality_ablation": quality.ABLATION_SQL,
    "op5_url_filter": urlfilter.SQL,
    "op6_line_dedup": linededup.SQL,
    "op7_jaccard_join": setjoin.SQL,
    "op9_warc": warc.SQL,
    "op10_suffix_dedup": suffixes.SQL,
}
