"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that a join may copy to every task.
BROADCAST_ROWS = 20_000


def shared_folder(spark: SparkSession) -> None:
    """Name the checkpoint folder of the session; a local one only on a local master whose session names none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once into the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def apart(df: DataFrame) -> DataFrame:
    """df as a side of joins that deal both sides by their keys.

    Without a word, Spark broadcasts what its compressed files and columns make look small, and the driver would hold all of its rows.
    """
    return df.hint("merge")


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut(), but as a Parquet table: compressed and read by column; apart() in joins."""
    return apart(_written(df, name))


def few(df: DataFrame) -> bool:
    """Whether each task of a join may have all rows of df, which are counted."""
    return df.count() <= BROADCAST_ROWS


def beside(df: DataFrame, name: str) -> DataFrame:
    """As stored(), but broadcast in joins if its rows are few."""
    df = _written(df, name)
    return F.broadcast(df) if few(df) else apart(df)


def _written(df: DataFrame, name: str) -> DataFrame:
    shared_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
