"""The operators on streams: pages that land in a folder, events with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftmill.functions import ioc, urls

PAGE = "page_id long, url string, html string"
EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def landing(spark: SparkSession, folder: str, schema: str = PAGE, files: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def indicators(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Indicators of each row as it arrives; no state."""
    return ioc.extract(texts, text, keys)


def first_of_each_url(pages: DataFrame, seen: str, delay: str = "1 day") -> DataFrame:
    """Pages whose cleaned address has not come within the delay; ``seen`` is the event time column."""
    return pages.withColumn("clean_url", urls.clean(F.col("url"))).withWatermark(seen, delay).dropDuplicatesWithinWatermark(["clean_url"])


def counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events and their value by type and window; late ones beyond the delay are dropped."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def write(of: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Exactly once to Parquet; with once, what is there and no more."""
    writer = of.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
