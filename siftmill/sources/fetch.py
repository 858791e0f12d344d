"""Fetching addresses: from a table, over HTTP, or as a data source of Spark's own."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WEB = "url string, status int, body string, error string"


def http(url: str, timeout: float = 10.0) -> tuple[int, str]:
    """(status, body) of a GET."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


def fetch(of: DataFrame, url: str = "url", get: Callable[[str], tuple[int, str]] = http, workers: int = 20) -> DataFrame:
    """web(url, status, body, error): every distinct address once; ``workers`` tasks run at a time on a large enough cluster.

    A failure is a row with status 0 and the error, not an exception.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for u in batch["url"]:
                try:
                    out.append((u, *get(u), None))
                except Exception as e:  # noqa: BLE001 - what a server does must not end the job
                    out.append((u, 0, "", str(e)))
            yield pd.DataFrame(out, columns=["url", "status", "body", "error"])

    distinct = of.select(F.col(url).alias("url")).where("url IS NOT NULL AND url <> ''").distinct()
    return distinct.repartition(workers, "url").mapInPandas(run, WEB)


def requested(pages: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url, html, input_html?) with html by precedence: given with the request, in the row, downloaded.

    ``download_state`` is 2 if there is a text, else 1 with an error; neither address nor text is an error too.
    """
    given = [F.nullif(F.col(c), F.lit("")) for c in ("input_html", "html") if c in pages.columns]
    if web is not None:
        got = web.where("status BETWEEN 1 AND 399").select(F.col("url").alias("_u"), F.col("body").alias("_b"))
        pages = pages.join(got, F.col("url") == F.col("_u"), "left").drop("_u")
        given.append(F.nullif("_b", F.lit("")))
    html = F.coalesce(*given)
    state = F.when(html.isNotNull(), 2).otherwise(1)
    error = F.when(html.isNull() & (F.coalesce("url", F.lit("")) == ""), "neither address nor text").when(html.isNull(), "not downloaded")
    return pages.withColumn("html", html).withColumn("download_state", state).withColumn("error", error).drop("_b", "input_html")


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.timeout = float(options.get("timeout", "10"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            status, body = http(partition.value, self.timeout)
            yield partition.value, status, body, None
        except Exception as e:  # noqa: BLE001
            yield partition.value, 0, "", str(e)


class PageSource(DataSource):
    """spark.read.format("siftmill_pages").option("urls", "http://a http://b").load()"""

    @classmethod
    def name(cls) -> str:
        return "siftmill_pages"

    def schema(self) -> str:
        return WEB

    def reader(self, schema: object) -> DataSourceReader:
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of a folder of HTML files, one page each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
