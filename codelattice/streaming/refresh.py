"""Keep an index up to date with a file stream: each micro-batch brings the index up to date for its own paths."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import Index


def watch(spark: SparkSession, root: str, folder: str, once: bool = True, interval: str = "10 seconds") -> StreamingQuery:
    """Start a query that applies new and changed source files below root to the index in folder.

    A micro-batch looks at its own files only, and its number goes into the manifest together with what it changes,
    so a batch that is delivered twice changes nothing. A file stream doesn't tell of removed files: a refresh
    of the whole index finds them. once: handle what is there and stop.
    """
    root = os.path.abspath(root)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    files = files.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{java,py}").load(f"file://{root}").select("path")
    writer = files.writeStream.foreachBatch(lambda batch, number: upsert(batch, number, root, folder)).option("checkpointLocation", f"{folder}/stream")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def upsert(batch: DataFrame, number: int, root: str, folder: str) -> dict[str, int]:
    """Apply the files of a micro-batch (path, as the stream names it); files by action."""
    names = F.url_decode(F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    paths = batch.select(F.substring(names, F.lit(len(root) + 2), F.length(names)).alias("path")).distinct()
    return Index(batch.sparkSession, folder).refresh(root, paths, number)
