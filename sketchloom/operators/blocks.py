"""All pairs of samples by blocks: a block of samples is one packed row, and each pair of blocks is met in a task.

Blocks are written once. If a side's blocks are small (``SMALL`` bytes, as their sizes tell when they are written) they are broadcast, each once, and nothing is shuffled; larger ones
are dealt by pairs of blocks, so a block is copied as often as the other side has blocks. Pairs of samples are made where they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.session import bounded_batches, lean, measured

#: Bytes of a side's blocks up to which they are broadcast, and tasks that pairs of blocks are dealt over at most.
SMALL, TASKS = 64 << 20, 4096


@dataclass(frozen=True)
class Blocks:
    """``rows`` has block and the columns of a packed block; ``n`` is the number of blocks, of which some may have no row."""

    rows: DataFrame
    n: int
    size: int


def dealt(entries: DataFrame, n: int, sample: str, pack: Callable[[pa.Table], pa.Table], kind: str) -> Blocks:
    """Samples dealt into ``n`` blocks; ``pack`` makes the one row of a block's entries, with the columns ``kind`` says."""
    spark = entries.sparkSession
    bounded_batches(spark)
    names = [c.split()[0] for c in kind.split(", ")]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        made = pack(table.drop_columns(["block"]))
        return made.add_column(0, "block", pa.array([key[0].as_py()], pa.int64()))

    marked = entries.withColumn("block", F.pmod(F.xxhash64(sample), F.lit(n)).cast("long"))
    made = marked.groupBy("block").applyInArrow(run, f"block long, {kind}")
    size = lambda c, t: F.octet_length(c) if t == "binary" else F.octet_length(F.concat_ws("", c)) if t == "array<string>" else F.size(c) * 8
    total = sum((F.coalesce(size(c, t).cast("long"), F.lit(0)) for c, t in made.select(*names).dtypes), F.lit(0))
    rows, seen = measured(made, "blocks", bytes=F.sum(total))
    return Blocks(rows, n, seen["bytes"] or 0)


def _cells(spark, n: int, m: int, alone: bool) -> DataFrame:
    """All pairs of blocks (i, j); of a side with itself those with i >= j."""
    total = n * (n + 1) // 2 if alone else n * m
    ids = spark.range(0, total, 1, max(1, min(total, TASKS)))
    if not alone:
        return ids.select(F.expr(f"id div {m}").alias("i"), (F.col("id") % m).alias("j"))
    i = F.floor((F.sqrt(8 * F.col("id") + 1) - 1) / 2).cast("long")
    return ids.select(i.alias("i"), (F.col("id") - i * (i + 1) / 2).cast("long").alias("j"))


def met(left: Blocks, right: Blocks | None, meet: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``meet`` makes of each pair of blocks, given whether both are the same and the two blocks' columns; without ``right`` each pair of a side's blocks once."""
    spark, alone = left.rows.sparkSession, right is None
    other = left if alone else right
    columns = [c for c in left.rows.columns if c != "block"]
    named = lambda b, key, p: b.rows.select(F.col("block").alias(key), F.struct(*columns).alias(p))
    ls, rs = named(left, "i", "l"), named(other, "j", "r")
    if max(left.size, other.size) <= SMALL:
        pairs = _cells(spark, left.n, other.n, alone).join(F.broadcast(ls), "i").join(F.broadcast(rs), "j")
    else:
        # the plan would take copies for as small as blocks, and broadcast them
        every = lambda low, high, name: F.explode(F.sequence(low, high)).alias(name)
        zero = F.lit(0).cast("long")
        last = lambda b: F.lit(b.n - 1).cast("long")
        ls = ls.select("*", every(zero, F.col("i") if alone else last(other), "j"))
        rs = rs.select("*", every(F.col("j") if alone else zero, last(left), "i"))
        pairs = ls.hint("merge").join(rs.hint("merge"), ["i", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                sides = [dict(zip(columns, (f.field(k) for k in range(len(columns))), strict=True)) for f in (batch.column(c).slice(at, 1) for c in (1, 2))]
                yield from meet(batch.column(0)[at].as_py(), *sides)

    same: Column = (F.col("i") == F.col("j")) if alone else F.lit(False)
    return pairs.select(same.alias("same"), "l", "r").mapInArrow(lean(run), schema)
