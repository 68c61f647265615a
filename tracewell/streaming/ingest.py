"""Continuous ingestion: new files of a folder become chunks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.functions.text import extension_of, folder_of, normalize_newlines
from tracewell.operators.context import chunk_documents
from tracewell.sources.files import artifact_kind


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the folder's text files, whole: relative_path, text, sha256, artifact_kind."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    path = F.col("_metadata.file_path")
    text = normalize_newlines(F.col("value"))
    extension = extension_of(path)
    return files.select(path.alias("relative_path"), folder_of(path).alias("folder"), text.alias("text"), F.sha2(text, 256).alias("sha256"), artifact_kind(extension).alias("artifact_kind"))


def ingest_stream(files: DataFrame, table: str, checkpoint: str, size: int = 4000, overlap: int = 200) -> StreamingQuery:
    """Write the arriving files' chunks to a Parquet table; what is there now is worked off, then the query ends.

    Exactly once: the checkpoint holds which files were read, and the file sink which batches were written.
    """
    chunks = chunk_documents(files.select(F.col("relative_path").alias("document_id"), "text"), size, overlap)
    return chunks.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events of each type and time window, of a stream or a table with ts and event_type; late events count until ``delay`` has passed."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(
        F.col("window.start").alias("window_start"), "event_type", "events", "value"
    )
