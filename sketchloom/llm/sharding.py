"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly.

The unit that is placed is a group of equal texts; all its rows go to one shard. A
group goes where the dot product of its vector with the shard's residual capacity is
highest, both as shares of the totals.

Rows are first summed up to groups, so a group is one narrow row, however many rows it has. Groups that hold more
than a 64th of a shard in any dimension are few, at most 3 * 64 * shards whatever the data are; the driver places them first.
A group with more bytes than a whole shard can't be placed whole and is split evenly into parts of a 16th of a shard: only
bytes decide that, as the law is theirs and equal texts else stay together. All other
groups are dealt by a hash of their text into buckets of about ``BUCKET_GROUPS`` groups. Each
bucket places its own, largest first, against its own share of what room the large
groups leave, and ends with its smallest texts, so every bucket is nearly even and so is
their sum. Rows then take their group's shard; those of large groups by a broadcast, so they stay where they are. Each task counts
its own rows in each shard, and prefix sums over the tasks' counts make the slots, so no shard is
collected anywhere. Only ids, sizes and hashes are shuffled, never texts.

Defined results: a null text has no bytes and counts as one group with other nulls, apart
from empty texts; sizes are bytes plus 1, so no row weighs nothing; repeated rows are
members of one group; ties between shards go to the lowest number, between groups to the
smaller hash; null ids stay null; an empty table gives an empty result; other columns of the
input are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.llm.words import word_count
from sketchloom.session import fresh, lean, materialize, quoted, small

SHARDS, BUCKET_GROUPS, LARGE = 8, 4096, 64
#: Into how many parts a shard's worth of a group is split that no shard can hold.
PARTS = 16
DIMENSIONS = ("size", "tokens", "n")
#: Bytes lead, as the law says; tokens and rows follow.
WEIGHTS = np.array([4.0, 1.0, 1.0])


def place(vectors: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The shard of each vector, in the given order; ``room`` (shards x dimensions) is used up."""
    out = np.empty(len(vectors), dtype=np.int32)
    for i, v in enumerate(vectors):
        out[i] = s = int(np.argmax(room @ (v * WEIGHTS)))
        room[s] -= v
    return out


def _place_large(groups: list, totals: np.ndarray, shards: int) -> tuple[list[tuple[bytes, list[int]]], np.ndarray]:
    """Shards of the large groups' parts and the room that all shards have left, as shares of the totals."""
    parts = []
    for g in groups:
        v = np.array([g[d] for d in DIMENSIONS], dtype=float) / totals
        whole = round(float(v[0]) * shards, 9)  # only bytes must fit: the law is theirs
        n = ceil(whole * PARTS) if whole > 1 else 1
        parts += [(v / n, bytes(g["key"]), k) for k in range(n)]
    parts.sort(key=lambda p: (-p[0].max(), p[1], p[2]))
    room = np.full((shards, len(DIMENSIONS)), 1.0 / shards)
    where = place(np.array([p[0] for p in parts]).reshape(-1, len(DIMENSIONS)), room)
    found: dict[bytes, list[int]] = {}
    for (_, key, _), s in zip(parts, where, strict=True):
        found.setdefault(key, []).append(int(s))
    return sorted(found.items()), np.maximum(room, 0)


def _key(text: Column) -> Column:
    """The same for equal texts."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def _bucket_shards(share: np.ndarray):
    """A function for applyInArrow that places a bucket's groups against its share of the room."""

    def fill(t: pa.Table) -> pa.Table:
        vectors = np.stack([t[d].to_numpy() for d in DIMENSIONS], axis=1).astype(float)
        vectors /= np.maximum(vectors.sum(axis=0), 1)
        keys = t["key"].to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (-vectors[i].max(), keys[i]))
        shard = np.zeros(len(t), dtype=np.int32)
        shard[order] = place(vectors[order], share.copy())
        return pa.table({"key": t["key"], "shard": shard})

    return fill


def plan(rows: DataFrame, shards: int, bucket_groups: int) -> tuple[DataFrame, DataFrame]:
    """Shards of the large groups' parts (key, parts) and of all other groups (key, shard), of written rows with key, size and tokens."""
    sums = (F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    groups = materialize(rows.groupBy("key").agg(*sums), "shard-groups")
    total = groups.agg(*(F.sum(d) for d in DIMENSIONS), F.count("*")).first()
    totals = np.array([max(1, x or 0) for x in total[:3]], dtype=float)
    limit = [float(t) / (shards * LARGE) for t in totals]
    is_large = F.expr(" OR ".join(f"{d} > {x!r}D" for d, x in zip(DIMENSIONS, limit, strict=True)))
    placed, room = _place_large(groups.where(is_large).collect(), totals, shards)  # at most 3 * LARGE * shards rows
    large = rows.sparkSession.createDataFrame(placed, "key binary, parts array<int>")
    buckets = max(1, ceil((total[3] or 1) / bucket_groups))
    share = room / np.maximum(room.sum(axis=0), 1e-300)
    dealt = groups.where(~is_large).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return large, dealt.groupBy("bucket").applyInArrow(_bucket_shards(share), "key binary, shard int")


def assign(docs: DataFrame, shards: int = SHARDS, bucket_groups: int = BUCKET_GROUPS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; slots are gapless in a shard."""
    text = F.col("text")
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            word_count(text).alias("tokens"),
            F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
            _key(text).alias("key"),
        ),
        "shard-rows",
    )
    large, others = plan(rows, shards, bucket_groups)
    marked = rows.join(F.broadcast(large), "key", "left").select("doc_id", "size", "text_crc32", "key", "parts")
    whole = marked.where("parts IS NULL").join(others, "key").select("doc_id", "size", "text_crc32", "key", F.array("shard").alias("parts"))
    dealt = marked.where("parts IS NOT NULL").unionByName(whole)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, used = TaskContext.get().partitionId(), np.zeros(shards, dtype=np.int64)
        seen: dict[bytes, int] = {}  # rows of split groups, which take their parts in turn
        for batch in batches:
            parts, keys = batch.column(4).to_pylist(), batch.column(3).to_pylist()
            shard = np.empty(batch.num_rows, dtype=np.int32)
            for i, own in enumerate(parts):
                turn = 0
                if len(own) > 1:
                    turn = seen.get(keys[i], task)
                    seen[keys[i]] = turn + 1
                shard[i] = own[turn % len(own)]
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            at = np.empty(batch.num_rows, dtype=np.int64)
            at[order] = np.arange(batch.num_rows) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(shard), pa.array(np.full(batch.num_rows, task, dtype=np.int32)), pa.array(at + used[shard])], names=["doc_id", "size", "text_crc32", "shard", "task", "at"])
            used += counts

    # a row's place is written with the task that gave it, so a lost task can't number rows in two ways
    out = materialize(dealt.mapInArrow(lean(number), "doc_id long, size long, text_crc32 long, shard int, task int, at long"), "shard-placed")
    counts = out.groupBy("shard", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return out.join(small(first), ["shard", "task"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write all rows of ``docs`` with their columns and their shard, one folder a shard.

    Every row is written once; a shard's files are as many as its tasks.
    """
    text = F.col("text")
    rows = materialize(docs.select(_key(text).alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), word_count(text).alias("tokens")), "shard-rows")
    large, others = plan(rows, shards, BUCKET_GROUPS)
    every = large.unionByName(others.select("key", F.array("shard").alias("parts")))
    key, parts, shard = fresh(docs.columns, "key", "parts", "shard")
    every = small(every.select(F.col("key").alias(key), F.col("parts").alias(parts)))
    both = docs.select("*", _key(text).alias(key)).join(every, key)
    turn = F.pmod(F.monotonically_increasing_id(), F.size(parts)).cast("int")
    both.select(*(quoted(c) for c in docs.columns), F.get(parts, turn).alias(shard)).write.partitionBy(shard).parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    got = assign(docs)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
