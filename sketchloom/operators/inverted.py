"""The older sketches: keys of permuted sub-contexts, k-mers back from keys, and an inverted store of keys.

A k-mer of ``2 * half`` bases is the smaller of itself and its reverse complement. Its ``2 * sub`` bases in the middle are the sub-context, which a
permutation of all sub-contexts gives a place; k-mers whose place is below 16**(sub - level) are kept, a share of 16**-level. A key holds the
outer bases and the place, so the permutation's inverse gives the k-mer back.

The inverted store has, for each key, the samples that hold it: posting lists of sorted ids, as differences in the smallest whole numbers that hold them. A list is
cut by ``CHUNK`` ids of samples, so no list grows with the number of samples, and a key of many samples is many rows. Samples are appended
in runs, and :func:`merged` makes one run of all. Two stores meet by key; what a sample meets there is dealt by the sample and counted by partner.

Defined results: repeated (sample, key) rows count once; rows without a sample or a key take no part; negative ids are allowed; an empty store
gives no pairs; a sample's entries that come in several runs are joined when runs are merged and count once before that, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.operators import meets
from sketchloom.operators.meets import unpacked
from sketchloom.operators.tokenize import CHUNK as LETTERS
from sketchloom.operators.tokenize import _CODE
from sketchloom.session import bounded_batches, lean, measured, small

#: Ids of samples that share a posting list, and met pairs that a task holds at a time.
CHUNK, PAIRS = 1 << 16, 2_000_000


@dataclass(frozen=True)
class SubcontextLayout:
    """K-mers of ``2 * half`` bases whose middle ``2 * sub`` are permuted; one in 16**level is kept."""

    half: int = 8
    sub: int = 5
    level: int = 2

    def __post_init__(self):
        if not 1 <= self.level < self.sub <= self.half <= 15:
            raise ValueError("1 <= level < sub <= half <= 15")

    @property
    def kept(self) -> int:
        return 1 << 4 * (self.sub - self.level)

    @property
    def outer(self) -> int:
        """Outer bases on one side."""
        return self.half - self.sub


def checked_places(places: np.ndarray, layout: SubcontextLayout) -> np.ndarray:
    if len(places) != 1 << 4 * layout.sub or not (np.bincount(places, minlength=len(places)) == 1).all():
        raise ValueError("not a permutation of the layout's sub-contexts")
    return places


def keyed(records: DataFrame, layout: SubcontextLayout, places: np.ndarray) -> DataFrame:
    """sample_id and key of every kept k-mer of records (sample_id, seq), a row for each occurrence.

    ``places`` is the permutation, the place of each sub-context; it is broadcast, with 16**sub entries.
    """
    shared, k = records.sparkSession.sparkContext.broadcast(checked_places(places, layout)), 2 * layout.half
    one, low = np.uint64(1), np.uint64(2 * layout.outer)
    inner = (one << np.uint64(4 * layout.sub)) - one
    right = (one << low) - one

    def keys(seq: bytes, places: np.ndarray) -> np.ndarray:
        code = _CODE[np.frombuffer(seq, dtype=np.uint8)]
        n = len(code) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        bad = np.cumsum(np.r_[0, code == 4])
        wide, forward, backward = (code & 3).astype(np.uint64), np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        for j in range(k):
            forward = (forward << np.uint64(2)) | wide[j : j + n]
            backward |= (np.uint64(3) - wide[j : j + n]) << np.uint64(2 * j)
        whole = np.minimum(forward, backward)[bad[k:] == bad[:-k]]
        at = places[((whole >> low) & inner).astype(np.int64)]
        whole, at = whole[at < layout.kept], at[at < layout.kept]
        left = whole >> (low + np.uint64(4 * layout.sub))
        return (((left << low) | (whole & right)) * np.uint64(layout.kept) + at.astype(np.uint64)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sample, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (seq or "").encode() if isinstance(seq, str) else bytes(seq or b"")
                for at in range(0, max(1, len(raw) - k + 1), LETTERS):
                    found = keys(raw[at : at + LETTERS + k - 1], shared.value)
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), sample)), pa.array(found)], ["sample_id", "key"])

    return records.select(F.col("sample_id").cast("long"), "seq").mapInArrow(lean(run), "sample_id long, key long")


def bases(number: Column, n: int) -> Column:
    """A number's last ``n`` digits in base four as bases."""
    return F.translate(F.lpad(F.conv(number, 10, 4), n, "0"), "0123", "ACGT") if n else F.lit("")


def reversed_kmers(keys: DataFrame, layout: SubcontextLayout, places: DataFrame) -> DataFrame:
    """``keys`` with ``kmer``; ``places`` has inner and place, a row for each sub-context (or for each kept one). A key whose place has none is an error in the permutation and has null."""
    kept = places.where(F.col("place") < layout.kept).select(F.col("place").cast("long").alias("_place"), F.col("inner").cast("long").alias("_inner"))
    outside = F.expr(f"key div {layout.kept}")
    met = keys.withColumn("_place", F.pmod("key", F.lit(layout.kept))).join(small(kept, layout.kept), "_place", "left")
    side = 1 << 2 * layout.outer
    kmer = F.concat(bases(F.floor(outside / side).cast("long"), layout.outer), bases(F.col("_inner"), 2 * layout.sub), bases(outside % side, layout.outer))
    return met.withColumn("kmer", kmer).drop("_place", "_inner")


# --- posting lists ----------------------------------------------------------------------------


def encoded_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of ``counts`` ascending offsets below ``CHUNK``, each as a byte that says how wide its differences are, and these."""
    first = np.r_[0, np.cumsum(counts)]
    steps = np.diff(ids, prepend=0)
    some = counts > 0
    steps[first[:-1][some]] = ids[first[:-1][some]]
    width = np.ones(len(counts), dtype=np.int64)
    if len(ids):
        width[some] += np.maximum.reduceat(steps, first[:-1][some]) > 255
    offsets = np.r_[0, np.cumsum(1 + counts * width)]
    raw = np.empty(offsets[-1], dtype=np.uint8)
    raw[offsets[:-1]] = width
    wide = np.repeat(width, counts)
    at = np.repeat(offsets[:-1] + 1 - first[:-1] * width, counts) + np.arange(len(ids)) * wide
    raw[at] = steps & 255
    raw[at[wide == 2] + 1] = steps[wide == 2] >> 8
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def decoded_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets of all lists of a column, and how many each has."""
    raw, size = unpacked(column, np.uint8)
    first = np.cumsum(size) - size
    width = raw[first].astype(np.int64)
    counts = (size - 1) // np.maximum(width, 1)
    start, wide = np.cumsum(counts) - counts, np.repeat(width, counts)
    at = np.repeat(first + 1 - start * width, counts) + np.arange(counts.sum()) * wide
    steps = raw[at].astype(np.int64)
    steps[wide == 2] += raw[at[wide == 2] + 1].astype(np.int64) << 8
    upto = np.r_[0, np.cumsum(steps)]
    return upto[1:] - np.repeat(upto[start], counts), counts


def encoded(ids: np.ndarray) -> bytes:
    return encoded_lists(np.asarray(ids, dtype=np.int64), np.array([len(ids)]))[0].as_py()


def decoded(raw: bytes) -> np.ndarray:
    return decoded_lists(pa.array([raw], pa.binary()))[0]


def postings(keys: DataFrame) -> DataFrame:
    """key, chunk, number of samples and their list, of rows sample_id and key."""
    chunk = F.expr(f"sample_id div {CHUNK} - CASE WHEN sample_id < 0 AND sample_id % {CHUNK} <> 0 THEN 1 ELSE 0 END")
    rows = keys.where("sample_id IS NOT NULL AND key IS NOT NULL").select("key", chunk.cast("long").alias("chunk"), F.pmod("sample_id", F.lit(CHUNK)).cast("int").alias("at"))
    lists = rows.groupBy("key", "chunk").agg(F.sort_array(F.collect_set("at")).alias("ids"))  # at most CHUNK of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.asarray(batch.column(2).value_lengths()).astype(np.int64)
            made = encoded_lists(np.asarray(batch.column(2).flatten()).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts.astype(np.int32)), made], ["key", "chunk", "n", "list"])

    return lists.mapInArrow(run, POSTING)


POSTING = "key long, chunk long, n int, list binary"


def append(path: str, keys: DataFrame, run: int) -> None:
    """Add samples as run ``run`` of a store; a repeated run overwrites itself, so a repeated batch counts once."""
    postings(keys).sortWithinPartitions("key", "chunk").write.mode("overwrite").parquet(f"{path}/run={run}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The posting lists of all runs."""
    return spark.read.option("basePath", path).parquet(f"{path}/run=*").select("key", "chunk", "n", "list")


def _joined(lists: DataFrame) -> DataFrame:
    """One list for each key and chunk: those that several runs have are united."""
    shift = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = decoded_lists(batch.column(2).flatten())
            of = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column(2).value_lengths()))
            row, ids = np.divmod(np.unique(np.repeat(of, counts) * shift + ids), shift)
            n = np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int32)), encoded_lists(ids, n)], ["key", "chunk", "n", "list"])

    return lists.groupBy("key", "chunk").agg(F.collect_list("list").alias("lists")).mapInArrow(run, POSTING)  # one of each run


def merged(spark: SparkSession, path: str, into: str) -> DataFrame:
    """All runs of a store as one run of another."""
    _joined(read(spark, path)).sortWithinPartitions("key", "chunk").write.mode("errorifexists").parquet(f"{into}/run=0")
    return read(spark, into)


def _samples(lists: pa.Array, chunks: pa.Array, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """The samples of lists, and how many each has."""
    ids, counts = decoded_lists(lists)
    return ids + np.repeat(np.asarray(chunks) * chunk, counts), counts


def listed(lists: DataFrame) -> DataFrame:
    """sample_id and key again."""
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = _samples(batch.column("list"), batch.column("chunk"), chunk)
            keys = np.repeat(np.asarray(batch.column("key")), counts)
            for at in range(0, len(ids), meets.SENT):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + meets.SENT]), pa.array(keys[at : at + meets.SENT])], ["sample_id", "key"])

    return lists.mapInArrow(run, "sample_id long, key long").distinct()


def _of_keys(column: pa.Array, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and sample of a column of keys' lists, in this order and each once."""
    flat = column.flatten()
    ids, counts = _samples(flat.field(1), flat.field(0), chunk)
    row = np.repeat(np.repeat(np.arange(len(column)), np.asarray(column.value_lengths())), counts)
    order = np.lexsort((ids, row))
    row, ids = row[order], ids[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])] if len(row) else np.empty(0, dtype=bool)
    return row[new], ids[new]


def _partners(batch: pa.RecordBatch, alone: bool, low: int, width: np.dtype, chunk: int, pairs: int) -> Iterator[pa.RecordBatch]:
    """A row for each sample of a key: its partners there, of the same samples those before it."""
    row, q = _of_keys(batch.column(0), chunk)
    rows, r = (row, q) if alone else _of_keys(batch.column(1), chunk)
    start = np.searchsorted(rows, row)
    n = (np.arange(len(row)) if alone else np.searchsorted(rows, row, side="right")) - start
    q, start, n = q[n > 0], start[n > 0], n[n > 0]
    upto = np.r_[0, np.cumsum(n)]
    packs = (r.view(np.uint64) - np.uint64(low % (1 << 64))).astype(width)
    g = 0
    while g < len(q):
        h = max(g + 1, int(np.searchsorted(upto, upto[g] + pairs, side="right")) - 1)
        right = np.arange(upto[h] - upto[g]) + np.repeat(start[g:h] - upto[g:h] + upto[g], n[g:h])
        yield pa.RecordBatch.from_arrays([pa.array(q[g:h]), meets.packed(packs[right], n[g:h])], names=["q", "partners"])
        g = h


def shared_counts(qry: DataFrame, ref: DataFrame | None = None) -> DataFrame:
    """q, r and the number of keys they share, from posting lists; without ``ref`` each pair once, with q > r.

    A key's lists come to a task as one row. What a sample meets there goes on as one row of packed numbers, dealt by the sample, and is counted by partner. Keys that very many
    samples hold are met by blocks of samples (:mod:`meets`).
    """
    alone = ref is None
    bounded_batches(qry.sparkSession)
    chunk, pairs = CHUNK, PAIRS
    size = lambda lists, name: lists.groupBy("key").agg(F.sum("n").alias(name))
    sizes = size(qry, "n").withColumn("m", F.col("n")) if alone else size(qry, "n").join(size(ref, "m"), "key")
    busy, told = measured(sizes.where(F.sqrt(F.col("n").cast("double") * F.col("m")) > meets.BUSY).select("key"), "busy", rows=F.count("*"))
    span = (qry if alone else ref).agg(F.min("chunk"), F.max("chunk")).first()
    low, high = (span[0] or 0) * chunk, ((span[1] or 0) + 1) * chunk - 1
    width = meets.narrow(low, high)
    some = (lambda lists, how: lists.join(small(busy, told["rows"]), "key", how)) if told["rows"] else (lambda lists, how: lists)

    def gathered(lists: DataFrame, name: str) -> DataFrame:
        made = some(lists, "left_anti").groupBy("key").agg(F.sum("n").alias("n"), F.collect_list(F.struct("chunk", "list")).alias(name))
        return (made.where("n > 1") if alone else made).drop("n")  # a key that one sample holds makes no pair

    met = gathered(qry, "qs") if alone else gathered(qry, "qs").join(gathered(ref, "rs"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _partners(batch, alone, low, width, chunk, pairs)

    dealt = met.select("qs", *([] if alone else ["rs"])).mapInArrow(lean(run), "q long, partners binary").repartition("q").sortWithinPartitions("q")
    counted = dealt.mapInArrow(lean(lambda batches: meets.by_partner(batches, low, width, pairs, ["q", "r", "shared"])), "q long, r long, shared long")
    if not told["rows"]:
        return counted
    entries = lambda lists: listed(some(lists, "left_semi")).select("sample_id", F.col("key").alias("ctx"), F.lit(0).cast("long").alias("obj"))
    blocks = meets.by_blocks(entries(qry), None if alone else entries(ref)).select("q", "r", F.col("xny").alias("shared"))
    return counted.unionByName(blocks).groupBy("q", "r").agg(F.sum("shared").alias("shared"))


def key_of(columns: tuple[str, ...] = ("ctx", "obj")) -> Column:
    """A key of several columns; different ones share it with a chance of 2**-64."""
    return F.xxhash64(*columns)

