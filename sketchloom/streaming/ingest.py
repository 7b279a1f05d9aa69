"""Structured Streaming: sketches that grow as sequence files arrive.

A file-source stream of sequence files is tokenized and counted by key; there is no event time, so
counts are kept for good. ``append`` instead adds each micro-batch's samples to a stored sketch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sketchloom.operators.entries import finalize
from sketchloom.operators.tokenize import KmerLayout, tokenized
from sketchloom.sources.fastx import RECORD, whole_files
from sketchloom.streaming import markers

FILES = "path string, modificationTime timestamp, length long, content binary"


def record_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Records of files as they arrive in ``folder``; a sample for each file, its id from the file's path."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    got = files.select("path", "content").mapInArrow(whole_files, RECORD)
    return got.withColumn("sample_id", F.xxhash64("path"))


def counted_stream(records: DataFrame, layout: KmerLayout = KmerLayout.coden()) -> DataFrame:
    """Running counts of every key, for complete or update mode."""
    return tokenized(records, layout).groupBy("sample_id", "ctx", "obj").agg(F.count("*").alias("cnt"), F.min("pos").alias("pos"))


def append(records: DataFrame, path: str, checkpoint: str, layout: KmerLayout = KmerLayout.coden(), least: int = 1, conflicts: bool = False, owners: str | None = None, merge_every: int = 16) -> StreamingQuery:
    """Finish each micro-batch's files and add them to the Parquet dataset at ``path``.

    A batch is written to a folder of its own number, which a repeated batch overwrites, so each file counts once. With ``owners``, a store of
    :mod:`sketchloom.streaming.markers`, keys' owners follow, and its runs are merged now and then.
    """

    def add(batch: DataFrame, number: int) -> None:
        finalize(tokenized(batch, layout), least, conflicts=conflicts).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if owners is not None:
            spark = batch.sparkSession
            markers.add(owners, spark.read.parquet(f"{path}/batch={number}"), number)
            if number % merge_every == merge_every - 1:
                markers.merge(spark, owners)

    return records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
