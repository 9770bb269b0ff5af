"""The scan and its results over streams of pages, and event-time windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pages import paged
from ..plans.scan import Options, scan


def page_stream(spark: SparkSession, folder: str, schema: str, column: str, source: str, files_per_trigger: int = 16, page: int = 1 << 20, margin: int = 1 << 16) -> DataFrame:
    """Pages of new Parquet files of a folder; at most so many files a trigger hold back the source."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return paged(rows.select(F.col(source).cast("string").alias("source"), column), column, ["source"], page, margin)


def scanned_stream(pages: DataFrame, options: Options | None = None) -> DataFrame:
    """The scan's rows, page by page; a page is scanned again only if its trigger is."""
    return scan(pages, options)


def unique_stream(rows: DataFrame, key: str = "sha1", time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows whose key was not met before; with a time, state older than the delay is let go."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if time else rows.dropDuplicates([key])


def histogram_stream(rows: DataFrame) -> DataFrame:
    """Running counts by recorder and feature (output mode complete or update)."""
    return rows.where("kind = 'feature'").groupBy("recorder", "feature").agg(F.count("*").alias("n"), F.count_if("is_utf16").alias("n_utf16"))


def each_batch(rows: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a callback on every batch; the checkpoint lets a stopped scan go on where it was."""
    return rows.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str = "ts", by: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))
