"""Mixing sources to target weights, in blocks of words.

A source's documents, in a fixed order, are one long sequence of words that is cut into
blocks of ``block`` words. A source takes as many slots as its target needs. For each output
shard the number of slots of each source is a multinomial draw over what the sources
still have to give: all slots are halved again and again down to single shards, each half's counts drawn
from its part's, so shards are random mixtures and the totals are exact. Each task makes the shards of its own range and draws
only the halves above them. Slot i of a
source stands for a block: full epochs take every block once, and within an epoch a
permutation (a Feistel network with cycle walking, keyed by source, epoch and seed) gives
the block. Slots and pieces of documents are then joined by block number. The last slot of
a source is cut to the words that its target still lacks.

:func:`blocks` gives the mixture itself, a row for each slot with its shard, position and text;
:func:`mixed_documents` gives it as documents; :func:`digest` counts words and shards of each document.

A hot source is dealt over as many chunks as all rows need; running sums are taken in a
chunk, then over the chunks. The driver holds one row for each source. That grows with the number of
sources, not with their documents.

Defined results: a null text has no words; documents without words are taken 0 times; a
null source is a source of its own, the last; repeated rows and null ids count each for
itself, and rows that differ in any column keep their own; an empty table gives an empty result; columns that aren't named here are carried
only by :func:`mixed_documents`, which needs doc_id, text and source among them, and may be called anything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sketchloom.llm.words import word_count
from sketchloom.session import bounded_batches, fresh, lean, materialize, plainly_named, quoted, small

WEIGHTS, SHARE, CAP = (5, 2, 1), Fraction(3, 2), 2
BLOCK, SHARD_SLOTS, CHUNK_ROWS, SEED = 128, 4096, 512, 20240501
#: Shards that a task draws at a time, and tasks that they are dealt over.
TASK_SHARDS, MOST_TASKS = 16, 10_000
_MASK = (1 << 64) - 1


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, cap: int = CAP) -> list[Fraction]:
    """Words for each source: ``share`` of all by weight, at most ``cap`` times its size; the excess is shared again."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > cap * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = Fraction(cap * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def permute(at: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 takes ``at``, or with ``back`` what it takes there; all elementwise."""
    n, key = np.asarray(n, dtype=np.int64), np.asarray(key, dtype=np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 2) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = np.asarray(at, dtype=np.uint64).copy()
    todo = np.ones(len(x), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x[todo] >> half[todo], x[todo] & mask[todo]
            for r in range(3, -1, -1) if back else range(4):
                if back:
                    left, right = right, left
                left, right = right, left ^ (_mix(right + key[todo] * np.uint64(2 * r + 3) + np.uint64(r)) & mask[todo])
                if back:
                    left, right = right, left
            x[todo] = (left << half[todo]) | right
            todo &= x >= n.astype(np.uint64)
    return x.astype(np.int64)


def epoch_key(seed: int, source: int, epoch: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.asarray(epoch, dtype=np.uint64) + np.uint64((seed * 1_000_003 + source * 4099) & _MASK))


@dataclass(frozen=True)
class Quota:
    """What one source gives: ``slots`` blocks, the last of them without its last ``cut`` words."""

    size: int
    blocks: int
    slots: int
    cut: int


def quota(size: int, target: Fraction, source: int, block: int = BLOCK, seed: int = SEED) -> Quota:
    if not size:
        return Quota(0, 0, 0, 0)
    blocks = ceil(size / block)
    words = round(target)
    full, rest = divmod(words, size)
    if not rest:
        return Quota(size, blocks, full * blocks, 0)
    missing = blocks * block - size  # what the last block is short of
    at = int(permute(np.array([blocks - 1]), np.array([blocks]), epoch_key(seed, source, np.array([full])), back=True)[0])
    m = ceil(rest / block)
    if at < m:  # the short block is among the slots, so one more may be needed
        m = ceil((rest + missing) / block)
    words_in = m * block - (missing if at < m else 0)
    return Quota(size, blocks, full * blocks + m, words_in - rest)


def halves(left: np.ndarray, want: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of ``want`` slots among sources that have ``left``; what a source lacks is drawn again."""
    left, out = left.copy(), np.zeros_like(left)
    while want:
        got = np.minimum(rng.multinomial(want, left / left.sum()), left)
        out += got
        left -= got
        want -= int(got.sum())
    return out


def shards_of(slots: np.ndarray, low: int, high: int, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shards ``low`` to ``high`` (exclusive): number, first slot of each source and slots of each source.

    Every part's draw is seeded by its bounds, so whoever draws it gets the same; parts outside the range aren't drawn on.
    """
    total = int(slots.sum())
    todo = [(0, shard_count(total, shard_slots), np.zeros_like(slots), slots)]
    while todo:
        a, b, first, own = todo.pop()
        if b <= low or a >= high:
            continue
        if b - a == 1:
            yield a, first, own
            continue
        middle = (a + b) // 2
        want = min(total, middle * shard_slots) - a * shard_slots
        half = halves(own, want, np.random.Generator(np.random.PCG64([seed, a, b])))
        todo += [(middle, b, first + half, own - half), (a, middle, first, half)]


def shard_count(slots: int, shard_slots: int = SHARD_SLOTS) -> int:
    return ceil(slots / shard_slots)


def identity(columns: list[tuple[str, str]]) -> Column:
    """A hash of all columns of a row; with the text's own hash it tells rows apart."""
    return F.xxhash64(*(F.col(quoted(c)).cast("string") if "map" in kind or kind == "variant" else F.col(quoted(c)) for c, kind in columns))


@dataclass
class Mix:
    """``pieces``: what each slot takes of each document; ``docs``: every row with its place; ``sources``: sizes and targets."""

    docs: DataFrame
    pieces: DataFrame
    sources: DataFrame


_SLOT = "shard int, src int, slot long, position int, epoch int, block long, cut int"
_ARROW = pa.schema([("shard", pa.int32()), ("src", pa.int32()), ("slot", pa.int64()), ("position", pa.int32()), ("epoch", pa.int32()), ("block", pa.int64()), ("cut", pa.int32())])


def slots_of(spark, quotas: list[Quota], seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """A row for each slot: its shard and position, source, number, epoch and block, and the words it lacks at its end."""
    slots = np.array([q.slots for q in quotas], dtype=np.int64)
    shared = spark.sparkContext.broadcast((slots, np.array([q.blocks for q in quotas], dtype=np.int64), np.array([q.cut for q in quotas], dtype=np.int64)))
    shards = shard_count(int(slots.sum()), shard_slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, blocks, cuts = shared.value
        for batch in batches:
            for low in batch.column(0).to_pylist():
                for shard, first, own in shards_of(slots, low, low + TASK_SHARDS, seed, shard_slots):
                    src = np.repeat(np.arange(len(own)), own)
                    n = len(src)
                    slot = np.arange(n) - np.repeat(np.cumsum(own) - own, own) + first[src]
                    epoch = slot // blocks[src]
                    keys = np.concatenate([epoch_key(seed, i, epoch[src == i]) for i in np.flatnonzero(own).tolist()]) if n else np.empty(0, dtype=np.uint64)
                    block = permute(slot % blocks[src], blocks[src], keys)
                    # the slots of a shard stand in an order of their own, not source by source
                    place = permute(np.arange(n), np.full(n, n), epoch_key(seed, -1, np.full(n, shard)))
                    cut = np.where(slot == slots[src] - 1, cuts[src], 0)
                    columns = (np.full(n, shard), src, slot, place, epoch, block, cut)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    tasks = ceil(shards / TASK_SHARDS)
    return spark.range(0, max(1, shards), TASK_SHARDS, max(1, min(tasks, MOST_TASKS))).mapInArrow(lean(run), _SLOT)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, cap: int = CAP, block: int = BLOCK, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> Mix:
    spark = docs.sparkSession
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"), identity(docs.dtypes).alias("key")), "mix-rows")
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row for each source
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes, n_rows = [r["size"] for r in found], sum(r["n"] for r in found)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, cap)
    quotas = [quota(s, t, i, block, seed) for i, (s, t) in enumerate(zip(sizes, goal, strict=True))]
    sources = spark.createDataFrame([(i, r["source"], r["size"], float(t)) for i, (r, t) in enumerate(zip(found, goal, strict=True))], "src int, source string, source_size long, target double")

    chunks = max(1, ceil(n_rows / CHUNK_ROWS))
    s = small(sources.select("src", F.col("source").alias("_source")), len(found), 100_000)
    rows = rows.join(s, rows["source"].eqNullSafe(s["_source"])).select("src", "doc_id", "size", "hash", "key", F.pmod(F.xxhash64("doc_id", "hash", "key"), F.lit(chunks)).alias("chunk"))
    within = Window.partitionBy("src", "chunk").orderBy("doc_id", "hash", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("src", "chunk").agg(F.sum("size").alias("n"))
    firsts = sums.select("src", "chunk", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("first"))
    placed = rows.withColumn("upto", F.sum("size").over(within)).join(small(firsts, chunks * len(found)), ["src", "chunk"])
    placed = materialize(placed.select("src", "doc_id", "size", "hash", "key", (F.col("first") + F.col("upto") - F.col("size")).alias("start")), "mix-placed")

    slots = slots_of(spark, quotas, seed, shard_slots)
    end = F.col("start") + F.col("size")
    parts = placed.where("size > 0").select("*", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    parts = parts.select("*", F.greatest("start", F.col("block") * block).alias("a"), F.least(end, (F.col("block") + 1) * block).alias("b"))
    parts = parts.join(small(sources.select("src", "source_size"), len(found), 100_000), "src")
    # Spark can't know how many slots there are, and would broadcast them
    joined = parts.join(slots.hint("merge"), ["src", "block"], "left")
    stop = F.least("b", F.least((F.col("block") + 1) * block, F.col("source_size")) - F.col("cut"))
    pieces = joined.select(
        "src", "doc_id", "hash", "key", "size", "start", "shard", "position", "epoch", (F.col("a") - F.col("start")).alias("from_word"),
        F.when(F.col("slot").isNotNull(), F.greatest(stop, F.col("a"))).otherwise(F.col("a")).alias("_to"),
    ).withColumn("to_word", F.col("_to") - F.col("start")).drop("_to")
    return Mix(placed, pieces, sources)


def digest(docs: DataFrame, **how) -> DataFrame:
    """How many words the mixture takes of each document, with its source's size and target, and in how many shards."""
    got = mix(docs.select("doc_id", "source", "text"), **how)
    words = F.col("to_word") - F.col("from_word")
    taken = got.pieces.groupBy("src", "start", "doc_id", "size", F.when(words > 0, F.col("shard")).alias("shard")).agg(F.sum(words).alias("taken"))
    taken = taken.groupBy("src", "start", "doc_id", "size").agg(F.sum("taken").alias("taken"), F.count("shard").alias("n_shards"), F.min("shard").alias("first_shard"))
    none = got.docs.where("size = 0").select("src", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("n_shards"), F.lit(None).cast("int").alias("first_shard"))
    named = got.sources.select("src", "source_size", "target")
    return taken.unionByName(none).join(small(named, limit=100_000), "src").select("doc_id", "size", "source_size", "target", "taken", "n_shards", "first_shard")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text of some word ranges, its own white space kept within a range."""
    found = [m.span() for m in _WORD.finditer(text)]
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and merged[-1][1] == a:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    if merged == [[0, len(found)]]:
        return text
    return "\n".join(text[found[a][0] : found[b - 1][1]] for a, b in merged)


def _taken(docs: DataFrame, spans: DataFrame, made: list[str]) -> DataFrame:
    """``docs`` joined with ``spans`` (key, hash, words and the columns ``made``), texts cut to the words; all its columns, then ``made``.

    Texts are dealt once, by the two hashes: for the distinct rows and for the join. Rows of the same hashes are
    the same in all columns, and each has its own spans.
    """
    bounded_batches(docs.sparkSession)
    key, hashed, words, *renamed = fresh(docs.columns, "key", "hash", "words", *made)
    names = [quoted(c) for c in docs.columns]
    keyed = docs.select(*names, identity(docs.dtypes).alias(key), F.xxhash64("text").alias(hashed)).dropDuplicates([key, hashed])
    spans = spans.select(F.col("key").alias(key), F.col("hash").alias(hashed), F.col("words").alias(words), *(F.col(c).alias(r) for c, r in zip(made, renamed, strict=True)))
    both = keyed.join(spans, [key, hashed]).select(*names, *renamed, words)
    place = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, spans = batch.columns
            columns[place] = pa.array([cut_words(t.as_py(), [(s["from_word"], s["to_word"]) for s in own.as_py()]) for t, own in zip(columns[place], spans, strict=True)], batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return both.mapInArrow(lean(cut), StructType(both.schema.fields[:-1]))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixture as documents: a row for each document and epoch that takes words of it, with just those words.

    All columns of ``docs`` are kept, each row's own; ``text`` holds the words taken and ``n_chars``, where there
    is one, their length. A document taken twice has two rows.
    """
    return plainly_named(docs, lambda named: _mixed(named, **how))


def _mixed(docs: DataFrame, **how) -> DataFrame:
    got = mix(docs, **how)
    spans = got.pieces.where("to_word > from_word").groupBy("src", "start", "key", "hash", "epoch").agg(F.collect_list(F.struct("from_word", "to_word")).alias("words"))
    out = _taken(docs, spans, [])
    chars = [c for c in docs.columns if c.lower() == "n_chars"]
    return out.withColumns({c: F.length("text").cast(docs.schema[c].dataType) for c in chars}) if chars else out


def blocks(docs: DataFrame, **how) -> DataFrame:
    """The mixture in its shards: shard, position, source and text of each slot, a block's documents on lines of their own."""
    got = mix(docs.select("doc_id", "source", "text"), **how)
    spans = got.pieces.where("to_word > from_word").select("key", "hash", "shard", "position", "start", F.array(F.struct("from_word", "to_word")).alias("words"))
    cut = _taken(docs.select("doc_id", "source", "text"), spans, ["shard", "position", "start"])
    # a block has at most as many pieces as words
    lines = cut.groupBy("shard", "position").agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
    return lines.select("shard", "position", "source", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def write(mixture: DataFrame, path: str) -> None:
    """Blocks as Parquet, one folder a shard, in the order of their positions."""
    mixture.repartition("shard").sortWithinPartitions("shard", "position").write.partitionBy("shard").parquet(path)
