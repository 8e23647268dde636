"""Small helpers shared by the operators: reading tables and cutting lineage in shared storage."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship

#: White space of every word contract: blank, and the control characters tab to carriage return.
SPACE = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE}]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, where the session has Spark's own number: texts are long, so its batches would be large.
BATCH_ROWS = "1000"


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with this package at hand on every executor, in small batches; workers give memory back after a task."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(trimmed, schema)


def _give_back() -> None:
    """Hand free memory to the system: a worker lives on, and its executor has a limit for all of its processes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only on a local master whose session names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder."""
    spark = df.sparkSession
    at = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut(), but as a Parquet table: compressed, and read by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the folders of stored() tables that nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def corpus_key(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Two 64-bit seeds of hashes, out of all texts: the same in every run, and unknown to who has written some of the texts."""
    text = F.col(text_col)
    small = F.xxhash64(text, F.lit(1)).bitwiseAND(F.lit((1 << 24) - 1))
    facts = docs.select(text).agg(F.bit_xor(F.xxhash64(text)).alias("x"), F.sum(small).alias("s"), F.count("*").alias("n")).first()
    digest = hashlib.blake2b(repr(tuple(facts)).encode(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")


def count_words(text):
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")
