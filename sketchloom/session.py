"""Session helpers: table access, shared scratch tables and small-side broadcasts.

Everything an operator has to keep between two Spark jobs is written as a
Parquet table below ``spark.checkpoint.dir``.  A written table survives the
loss of an executor, has exact statistics for the next plan, and is visible
to every executor, which a machine-local folder is not.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Rows below which a side of narrow rows may be broadcast (ids, codes, counts).
BROADCAST_ROWS = 1_000_000

_written: list[tuple[SparkSession, str]] = []


def get_spark(app: str = "sketchloom", shuffle_partitions: int | None = None) -> SparkSession:
    """The active session, or a new one with adaptive execution on."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder, by a path that any Hadoop store can hold."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset (tests, a laptop) a folder of our own is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
        if not found:
            if not sc.master.startswith("local["):
                found = spark.conf.get("spark.sql.warehouse.dir") + "/.scratch"
                if found.startswith("file:") or ":" not in found:
                    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            else:
                found = "file://" + tempfile.mkdtemp(prefix="sketchloom-")
            sc.setCheckpointDir(found)
            found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    return f"{shared_dir(spark)}/sketchloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; this cuts lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    _written.append((spark, path))
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch = path
    return made


def measured(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """:func:`materialize` and the values of some aggregates over ``df``, taken while it is written."""
    seen = Observation()
    made = materialize(df.observe(seen, *(c.alias(k) for k, c in measures.items())), label)
    return made, seen.get


def numbered(df: DataFrame, keys: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of some keys that tell rows apart; no task sorts all rows.

    Rows are sorted in ranges and written with their range's number; a place is that in the range after those in the ranges before.
    """
    part, first = fresh((*df.columns, name), "part", "first")
    rows = materialize(df.orderBy(*keys).withColumn(part, F.spark_partition_id()), "numbered")
    over = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # of a row for each range
    counts = rows.groupBy(part).agg(F.count("*").alias("_n")).select(part, F.coalesce(F.sum("_n").over(over), F.lit(0)).alias(first))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*keys)) - 1
    return rows.withColumn(name, inside).join(F.broadcast(counts), part).withColumn(name, (F.col(quoted(name)) + F.col(first)).cast("long")).drop(part, first)


def discard(made: DataFrame) -> None:
    """Delete a table of :func:`materialize` that no frame in use reads any more."""
    spark, path = made.sparkSession, made.scratch
    _delete(spark, path)
    _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _forget() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone at exit; the folder's owner clears it then
            return


atexit.register(_forget)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores in front until none of ``columns`` is called so, whatever the case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as an expression refers to it."""
    return "`" + name.replace("`", "``") + "`"


def plainly_named(df: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run(df)`` for a function that keeps all columns in their places, also where names hold dots, which Arrow functions can't take.

    Such names are replaced while it runs.
    """
    if not any("." in c for c in df.columns):
        return run(df)
    names = [c.replace(".", "_") if "." in c else c for c in df.columns]
    for i, c in enumerate(df.columns):
        if "." in c:
            names[i] = fresh([*df.columns, *names[:i], *names[i + 1 :]], names[i])[0]
    return run(df.toDF(*names)).toDF(*df.columns)


def without(columns: Iterable[str], *made: str) -> list[str]:
    """The columns that aren't called like those that are made, whatever the case of letters."""
    taken = {c.lower() for c in made}
    return [c for c in columns if c.lower() not in taken]


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its measured row count is at most ``limit``.

    Beyond that the frame is returned as it is and the join shuffles.
    """
    if rows is None:
        rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df


#: Spark's own bound of an Arrow batch, which a session has that sets none. Fixed value.
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound the bytes of Arrow batches to Python in this session, unless the session has set a bound.

    Rows of long texts otherwise come in batches of tens of megabytes, several at a time in a worker.
    """
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, str(size))


#: Bytes of a compiled method beyond which a stage isn't one method. The JVM compiles none beyond 8,000, so longer ones are interpreted.
_METHOD_KEY, _METHOD_DEFAULT, _METHOD = "spark.sql.codegen.hugeMethodLimit", "65535", "8000"


def short_methods(spark: SparkSession) -> None:
    """Let stages of long expressions, as the distance models are, run as several methods that the JVM compiles, unless the session has set a limit."""
    if spark.conf.get(_METHOD_KEY, _METHOD_DEFAULT) == _METHOD_DEFAULT:
        spark.conf.set(_METHOD_KEY, _METHOD)


def lean(run):
    """A function for mapInArrow whose worker gives freed memory back when a task ends.

    Workers are used again by later stages; what a stage has freed would else stay theirs.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def release_memory() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def driver_file(path: str) -> bytes:
    """A small local file, such as a public vocabulary, read on the driver."""
    with open(os.path.expanduser(path), "rb") as f:
        return f.read()
