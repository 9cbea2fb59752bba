"""Pages that arrive as a stream: chunks by document, each document once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators import chunking


def ingest(pages: DataFrame, target: str, checkpoint: str, size: chunking.ChunkSize = chunking.ChunkSize()) -> StreamingQuery:
    """Chunk streamed pages (file, page_number, cleaned_text) into Parquet below ``target``, a folder a batch.

    A batch that is run again overwrites its own folder, so chunks are there
    once whatever fails in between. Available data is read, then it stops.
    """

    def batch(rows: DataFrame, number: int) -> None:
        chunking.chunk_pages(rows, size).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def current_chunks(spark: SparkSession, target: str) -> DataFrame:
    """Of each file the chunks of the last batch that had it."""
    rows = spark.read.parquet(target)
    last = F.max("batch").over(Window.partitionBy("file"))
    return rows.withColumn("__last", last).filter("batch = __last").drop("__last")


def usage(events: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts and values by type in windows of event time; what comes later than the watermark is dropped."""
    rows = events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select("window.start", "event_type", "events", "value")
