"""Queries of the extraction and text operators, by name, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import pages, text, web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**pages.QUERIES, **text.QUERIES, **web.QUERIES}
ORACLES: dict[str, str] = {**pages.ORACLES, **text.ORACLES, **web.ORACLES}
