"""Dated documents as a stream: new files become chunks of their segments as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.corpus import build_corpus


def watch_sources(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """(file_path, title, text) of the .txt and .md files that appear below ``root``."""
    rows = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").option("maxFilesPerTrigger", files_per_trigger).text(root)
    return rows.select(F.col("_metadata.file_path").alias("file_path"), F.regexp_replace(F.col("_metadata.file_name"), r"\.(txt|md)", "").alias("title"), F.col("value").alias("text"))


def ingest(files: DataFrame, segments: DataFrame, out: str, checkpoint: str, **chunking: int) -> StreamingQuery:
    """Write chunks by segment; each micro-batch has a folder of its own, so that a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        key = F.when(F.col("segment_id") == -1, "timeless").otherwise(F.col("segment_id").cast("string"))
        build_corpus(batch, segments, **chunking).withColumns({"segment_key": key, "batch": F.lit(number)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "segment_key").parquet(out)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "5 days", late: str = "1 day") -> DataFrame:
    """(start, end, event_type, n) of a stream (ts, event_type); rows later than the watermark are left out."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")
