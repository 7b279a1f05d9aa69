"""Owners of keys that follow appended batches: which keys one sample alone has, without reading all entries again.

A key's owners are summed up as their least and their greatest id: equal, they are one. Both are associative, and adding a batch
twice changes nothing, so each batch is a run of its own number (a repeated batch overwrites its run), and runs are merged by key. :func:`merge` makes one
base of all runs up to a number, now and then; readers take the newest finished base and the runs after it. Runs and bases lie in the same ``buckets``
of keys, by folder, so a question about some keys reads their buckets alone.

Defined results: repeated entries count once; entries without a sample, context or object take no part; an empty store has no keys.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
STATE = "bucket int, ctx long, obj long, lo long, hi long"


def bucket_of(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("ctx", "obj"), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, buckets: int) -> None:
    rows.repartition(min(buckets, 32), "bucket").sortWithinPartitions("bucket", "ctx", "obj").write.mode("overwrite").partitionBy("bucket").parquet(path)


def add(path: str, entries: DataFrame, batch: int, buckets: int = BUCKETS) -> None:
    """The owners of a batch's keys as run ``batch``."""
    rows = entries.where("sample_id IS NOT NULL AND ctx IS NOT NULL AND obj IS NOT NULL")
    _write(rows.groupBy("ctx", "obj").agg(F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi")).withColumn("bucket", bucket_of(buckets)), f"{path}/batch={batch}", buckets)


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the finished runs or bases."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and done(n))


def runs(spark: SparkSession, path: str, upto: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
    """The rows of the newest base and of the runs after it, up to a batch; of some buckets if they are given."""
    bases = [n for n in _numbers(spark, path, "base") if upto is None or n <= upto]
    newest = bases[-1] if bases else -1
    names = [f"base={newest}"] * bool(bases) + [f"batch={n}" for n in _numbers(spark, path, "batch") if n > newest and (upto is None or n <= upto)]
    out = None
    for name in names:
        one = spark.read.schema(STATE).parquet(f"{path}/{name}").select("bucket", "ctx", "obj", "lo", "hi")
        out = one if out is None else out.unionByName(one)
    out = spark.createDataFrame([], STATE) if out is None else out
    return out if buckets is None else out.where(F.col("bucket").isin(*buckets))


def owners(spark: SparkSession, path: str, upto: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
    """Each key's least and greatest owner."""
    return runs(spark, path, upto, buckets).groupBy("bucket", "ctx", "obj").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def merge(spark: SparkSession, path: str, buckets: int = BUCKETS) -> int | None:
    """Make the newest batch's number a base of all until then; older runs and bases are deleted once it is written."""
    batches = _numbers(spark, path, "batch")
    if not batches:
        return None
    last = batches[-1]
    _write(owners(spark, path), f"{path}/base={last}", buckets)
    for kind in ("batch", "base"):
        for n in _numbers(spark, path, kind):
            if n < last or kind == "batch":
                where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}")
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return last


def unique_keys(state: DataFrame) -> DataFrame:
    """Keys that one sample alone has, and that sample."""
    return state.where("lo = hi").select("ctx", "obj", F.col("lo").alias("sample_id"))


def unique_owners(state: DataFrame) -> DataFrame:
    """Contexts that one sample alone has, whatever the objects."""
    return state.groupBy("ctx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo = hi").select("ctx", F.col("lo").alias("sample_id"))
