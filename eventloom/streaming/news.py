"""A streaming front end of the collection: the first article of each title, and daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_landed(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_of_title(news: DataFrame, time: str = "published", late: str = "7 days") -> DataFrame:
    """Each title once within the watermark; state for older titles is dropped."""
    return news.withWatermark(time, late).dropDuplicatesWithinWatermark(["title"])


def daily_counts(news: DataFrame, time: str = "published", late: str = "2 days", by: str = "query") -> DataFrame:
    """(day, by, n): counts in windows of a day, final once the watermark has passed."""
    counts = news.withWatermark(time, late).groupBy(F.window(time, "1 day"), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), by, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet table; with its checkpoint a broken-off run goes on where it stopped. once: all that is there, then stop."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).format("parquet").start(path)
