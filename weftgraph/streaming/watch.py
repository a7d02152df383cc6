"""Folders watched as streams: every new file goes once through extraction and into the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], pattern: str = "*", once: bool = True) -> StreamingQuery:
    """Run ``handle(files, batch)`` on the new files (path, content) of a folder; a file is handled exactly once.

    The stream's checkpoint is the registry of what has been done; ``once`` takes what is there and ends.
    """
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    named = files.select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    writer = named.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def append_graph(target: str, extract: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A handler that appends what ``extract`` finds to a Parquet folder, one directory per batch, replaced on retry."""

    def handle(files: DataFrame, batch: int) -> None:
        extract(files).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return handle


def running_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension beyond the batch graph: events per type and window, late ones dropped behind the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
