"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

1. Each text becomes its set of distinct 5-word shingles, 64-bit hashes of whole texts.
   128 minima give 25 band keys of 5 minima each and a signature of their low 4 bits.
2. Texts with one shingle set are one class; one class member stands for all.
3. Classes that share a band key are compared by their signatures: equal nibbles, counted
   in 64-bit words and corrected for chance, estimate the similarity. Pairs that are
   estimated not far below the threshold (six standard errors) join two classes to one
   candidate cluster. A bucket gives at most a spanning forest of such pairs, not all pairs.
4. Within a candidate cluster all links are confirmed on the full sets, by an inverted index,
   and again only a spanning forest is given out. Components of these links are the result.

Buckets and clusters of more than ``LIMIT`` members (or ``LIMIT_SHINGLES``) are dealt into blocks, differently
for each band, and each block is compared within itself. That joins nearly all of a large group of copies. What
isn't in a group's largest component then is compared with all of the group, block against block, each pair of blocks by
itself; two members of that component need no comparison. So no group is
collected whole, no link between components is left out, and a group of copies costs its size, not its square. At similarity 0.85 two classes share no band key with
probability 4e-7 (5e-5 at 0.8), and fall below six standard errors with less.

Defined results: null and empty texts, and texts of white space only, have no shingles and are linked
with nothing; fewer than five words are one shingle; very long texts are hashed in segments, whole;
rows with a null id take part, a component's id is the smallest non-null one and null if it has none;
rows that repeat both an id and a text have one ``kept`` in :func:`digest`, and :func:`deduplicated` leaves one of them; an
empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.operators.graph import components, contracted
from sketchloom.session import BROADCAST_ROWS, bounded_batches, fresh, lean, materialize, quoted, small

WORDS, PERCENT = 5, 85
MINIMA, ROWS, BANDS, BITS = 128, 5, 25, 4
LIMIT, LIMIT_SHINGLES = 2048, 2_000_000
SEGMENT = 1 << 20

_rng = np.random.Generator(np.random.PCG64(9176))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of some texts, and the word number at which each text starts.

    ``data`` holds the texts' bytes one after another, ``docs`` where each starts.
    """
    space = _SPACE[data]
    fresh = np.empty(len(data), dtype=bool)
    if len(data):
        fresh[0] = True
        fresh[1:] = space[:-1]
        fresh[docs[docs < len(data)]] = True
    starts = np.flatnonzero(fresh & ~space)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(docs), dtype=np.int64)
    inside = np.flatnonzero(~space)
    first = np.searchsorted(inside, starts)
    lengths = np.diff(np.r_[first, len(inside)])
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    values = _BYTE[data[inside]] * _powers(int(lengths.max()))[place]
    return _mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _STEP), np.searchsorted(starts, docs)


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, in segments that end between words."""
    out, at = [], 0
    while at < len(data):
        stop = min(at + SEGMENT, len(data))
        while stop < len(data) and not _SPACE[data[stop]]:
            more = np.flatnonzero(_SPACE[data[stop : stop + SEGMENT]])
            stop = stop + int(more[0]) if len(more) else min(stop + SEGMENT, len(data))
        out.append(word_hashes(data[at:stop], np.zeros(1, dtype=np.int64))[0])
        at = stop
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's words."""
    n = len(words)
    if n < WORDS:
        return _mix(np.sum(words * _PLACE[:n], dtype=np.uint64, keepdims=True) + np.uint64(n)) if n else words
    total = words[: n - WORDS + 1] * _PLACE[0]
    for j in range(1, WORDS):
        total += words[j : n - WORDS + 1 + j] * _PLACE[j]
    return np.unique(_mix(total))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text of an Arrow string column, in order."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    null = np.asarray(texts.is_null())
    at = 0
    with np.errstate(over="ignore"):
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT, side="right")) - 1)
            end = min(end, len(texts))
            own = data[offsets[at] : offsets[end]]
            if end == at + 1 and len(own) > SEGMENT:
                words, first = _long_words(own), np.array([0])
            else:
                words, first = word_hashes(own, offsets[at:end] - offsets[at])
            bounds = np.r_[first, len(words)]
            for k in range(end - at):
                yield _shingles(words[:0] if null[at + k] else words[bounds[k] : bounds[k + 1]])
            at = end


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over a set."""
    best = None
    for a in range(0, len(shingles), 2048):
        got = (shingles[a : a + 2048, None] * _A + _B).min(axis=0)
        best = got if best is None else np.minimum(best, got)
    return best >> np.uint64(32)


def signature(low: np.ndarray) -> bytes:
    """The low bits of the minima, packed."""
    nibbles = (low & np.uint64(15)).astype(np.uint8)
    return (nibbles[0::2] | (nibbles[1::2] << 4)).tobytes()


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS) * _PLACE[:ROWS]
    return _mix(rows.sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP).view(np.int64)


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of a set, the same for equal sets only (but for chance)."""
    return np.array([_mix(shingles + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(shingles)), np.bitwise_xor.reduce(_mix(shingles * _STEP))], dtype=np.uint64).tobytes()


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, fp, sig and bands of every document; the last three null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 2000):
                part = batch.slice(at, 2000)
                sizes, fps, sigs, bands = [], [], [], []
                with np.errstate(over="ignore"):
                    for s in shingle_sets(part.column(1)):
                        sizes.append(len(s))
                        if len(s):
                            low = minima(s)
                            fps.append(fingerprint(s))
                            sigs.append(signature(low))
                            bands.append(band_keys(low))
                        else:
                            for x in (fps, sigs, bands):
                                x.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=_SIGNED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(lean(run), "doc_id long, text_hash long, n_shingles long, fp binary, sig binary, bands array<long>")


def least_equal(percent: int = PERCENT, errors: float = 6.0) -> int:
    """Equal nibbles that a pair at the threshold has, less ``errors`` standard errors."""
    chance = 2.0**-BITS
    p = percent / 100 * (1 - chance) + chance  # collisions by chance add to those by similarity
    return int(MINIMA * p - errors * (MINIMA * p * (1 - p)) ** 0.5)


def similarity(equal: np.ndarray) -> np.ndarray:
    """Collision-corrected estimate of the similarity from counts of equal nibbles."""
    chance = 2.0**-BITS
    return (np.asarray(equal) / MINIMA - chance) / (1 - chance)


def equal_nibbles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal nibbles of packed signatures (64-bit words on the last axis), by bit counts."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    x &= np.uint64(0x1111111111111111)
    return MINIMA - np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


class Forest:
    """Spanning edges of what has been joined."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, a: int, others: np.ndarray) -> None:
        """Join ``a`` with all of ``others``."""
        labels = self.label[others]
        other, at = np.unique(labels, return_index=True)
        own = self.label[a]
        new = other != own
        if new.any():
            self.edges += [(a, int(others[k])) for k in at[new]]
            self.label[np.isin(self.label, other[new])] = own


Grouped = Callable[[np.ndarray, dict[str, list]], list[tuple[int, int]]]


def by_group(keys: list[str], values: list[str], work: Grouped):
    """A function for mapInArrow over rows sorted by ``keys``: ``work`` gets each group's sides and values
    and gives pairs of row numbers; out come the pairs' ``fp``. Only one group is held at a time."""

    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in ("fp", "side", *values)}
        now, out_a, out_b = None, [], []

        def close() -> None:
            if len(held["fp"]) > 1:
                for x, y in work(np.asarray(held["side"]), held):
                    out_a.append(held["fp"][x])
                    out_b.append(held["fp"][y])
            for x in held.values():
                x.clear()

        def batch_out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], schema=schema)
            out_a.clear()
            out_b.clear()
            return made

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in held}
            ids = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            at = 0
            while at < len(ids):
                if ids[at] != now:
                    close()
                    now = ids[at]
                end = at + 1
                while end < len(ids) and ids[end] == now:
                    end += 1
                for c, x in held.items():
                    x.extend(columns[c][at:end])
                at = end
            if len(out_a) > 10_000:
                yield batch_out()
        close()
        yield batch_out()

    return run


def _known(n: int, rows: dict[str, list]) -> Forest:
    """A forest in which members of one component are joined from the start, where ``rows`` says so."""
    forest = Forest(n)
    if "label" in rows:
        forest.label = np.unique(np.asarray(rows["label"], dtype=object), return_inverse=True)[1]
    return forest


def estimated(least: int, percent: int) -> Grouped:
    """Spanning pairs of a bucket's members whose signatures are near enough."""

    def work(side: np.ndarray, rows: dict[str, list]) -> list[tuple[int, int]]:
        sig = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint64).reshape(len(side), -1)
        n = np.asarray(rows["n"], dtype=np.int64)
        forest = _known(len(side), rows)
        left = np.flatnonzero(side != 2)
        for a in left.tolist():
            others = np.flatnonzero(side == 2) if side[a] == 1 else np.arange(a + 1, len(side))
            others = others[(forest.label[others] != forest.label[a]) & (100 * np.minimum(n[others], n[a]) >= percent * np.maximum(n[others], n[a]))]
            if len(others):
                others = others[equal_nibbles(sig[others], sig[a]) >= least]
                if len(others):
                    forest.join(a, others)
        return forest.edges

    return work


def linked(percent: int) -> Grouped:
    """Spanning links among a candidate cluster's full sets, by an inverted index."""

    def work(side: np.ndarray, rows: dict[str, list]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["shingles"]]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        forest = _known(len(sets), rows)
        if len(sets) == 2 and "label" not in rows:
            inter = int(n.sum()) - len(np.union1d(*sets))
            return [(0, 1)] if 100 * inter >= percent * (int(n.sum()) - inter) else []
        held = np.flatnonzero(side != 1)  # the indexed ones
        if not len(held) or (side == 2).all():  # the other block of the pair is empty
            return []
        owner = np.repeat(held, n[held])
        values = np.concatenate([sets[k] for k in held])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        for a in np.flatnonzero(side != 2).tolist():
            near = held[(100 * np.minimum(n[held], n[a]) >= percent * np.maximum(n[held], n[a])) & (forest.label[held] != forest.label[a])]
            if not len(near):
                continue
            first, last = np.searchsorted(values, sets[a], "left"), np.searchsorted(values, sets[a], "right")
            count = last - first
            total = int(count.sum())
            if not total:
                continue
            at = np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)
            inter = np.bincount(owner[at], minlength=len(sets))[near]
            near = near[100 * inter >= percent * (n[a] + n[near] - inter)]
            if len(near):
                forest.join(a, near)
        return forest.edges

    return work


def within(members: DataFrame, key: str, deals: int = 1) -> DataFrame:
    """Members of groups of ``blocks`` blocks in their own block ``i``; those of several blocks in ``deals`` ways of dealing."""
    ways = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(deals - 1)))
    dealt = members.select("*", F.explode(ways).alias("j"))
    return dealt.withColumns({"i": F.pmod(F.xxhash64("fp", key, "j"), F.col("blocks")).cast("int"), "side": F.lit(0)}).drop("blocks")


def across(members: DataFrame, key: str, joined: DataFrame, weigh: Column) -> DataFrame | None:
    """What is left to compare in groups of several blocks, once ``joined`` (id, comp) is known; None if nothing is.

    Everything outside a group's largest component is on side 1, everything on side 2. ``label`` names components;
    ``weigh`` gives the blocks that some members need.
    """
    large = members.where("blocks > 1")
    joined = joined.select(F.col("id").alias("fp"), F.col("comp").alias("label"))
    labelled = materialize(large.join(small(joined), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "minhash-labelled")
    sizes = labelled.groupBy(key, "label").agg(F.count("*").alias("_n"))
    giants = sizes.groupBy(key).agg(F.max_by("label", F.struct("_n", "label")).alias("giant"))
    rest = labelled.join(small(giants), key).where("label <> giant")
    left = materialize(rest.groupBy(key).agg(weigh.cast("int").alias("rest_blocks"), F.first("giant").alias("giant")), "minhash-rest")
    if left.isEmpty():
        return None
    spread = labelled.join(small(left), key)
    own, block = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("rest_blocks")).cast("int"), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    one = spread.where("label <> giant").select("*", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("j"), F.lit(1).alias("side"))
    two = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("i"), block.alias("j"), F.lit(2).alias("side"))
    return one.unionByName(two).drop("blocks", "giant", "rest_blocks")


def compared(met: DataFrame, key: str, values: list[str], work: Grouped) -> DataFrame:
    """Pairs that ``work`` finds in each block of ``met``, contracted in the same worker."""
    met, run = met.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "fp"), by_group([key, "i", "j"], values, work)
    return met.mapInArrow(lean(lambda batches: contracted(run(batches))), "a binary, b binary")


def joined(members: DataFrame, sizes: DataFrame, key: str, values: list[str], work: Grouped, weigh: Column, deals: int, load: Callable[..., DataFrame] = lambda met, rows=None: met) -> DataFrame:
    """Components (id, comp) of what ``work`` finds among each group's members.

    ``members`` has fp, the group's ``key`` and number of ``blocks`` (which the written ``sizes`` has, too), and what ``weigh`` counts;
    ``load`` adds the values that are compared.
    """
    first = components(compared(load(within(members, key, deals)), key, values, work), contract=False)
    if sizes.where("blocks > 1").isEmpty():
        return first
    more = across(members, key, first, weigh)
    if more is None:
        return first
    pairs = compared(load(more, None), key, [*values, "label"], work)
    return components(pairs.unionByName(first.select(F.col("id").alias("a"), F.col("comp").alias("b"))), contract=False)


def named(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, fp and comp of every row; comp names the component, null without shingles."""
    bounded_batches(docs.sparkSession)
    rows = materialize(signed(docs), "minhash-signed")
    full = rows.where("n_shingles > 0")
    classes = materialize(full.groupBy("fp").agg(F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.min(F.struct("doc_id", "text_hash")).alias("row")), "minhash-classes")

    banded = classes.select("fp", "n", "sig", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = materialize(buckets.select("key", F.ceil(F.col("members") / LIMIT).alias("blocks")), "minhash-buckets")
    # a large bucket is dealt in another way than the same members' buckets in other bands
    cluster = joined(banded.join(small(buckets), "key"), buckets, "key", ["n", "sig"], estimated(least_equal(percent), percent), F.ceil(F.count("*") / LIMIT), 1)
    cluster = materialize(cluster.unionByName(cluster.select(F.col("comp").alias("id"), "comp").distinct()), "minhash-clusters")

    found = confirm(docs, classes, cluster, percent)
    comps = small(found.select(F.col("id").alias("fp"), "comp"))
    return rows.join(comps, "fp", "left").select("doc_id", "text_hash", "n_shingles", "fp", F.coalesce("comp", "fp").alias("comp"))


def duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept and fp of every row."""
    rows = named(docs, percent)
    least = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    out = rows.join(small(materialize(least, "minhash-least")), "comp", "left")
    alone = F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", alone.alias("component_id"), F.col("doc_id").eqNullSafe(alone).alias("kept"), "fp")


def confirm(docs: DataFrame, classes: DataFrame, cluster: DataFrame, percent: int) -> DataFrame:
    """Components of confirmed links within candidate clusters."""
    sized = cluster.select(F.col("id").alias("fp"), F.col("comp").alias("cluster")).join(classes.select("fp", "n", "row"), "fp")
    cut = F.greatest(F.ceil(F.count("*") / LIMIT), F.ceil(F.sum("n") / LIMIT_SHINGLES))
    blocks = sized.groupBy("cluster").agg(cut.alias("blocks"))
    members = materialize(sized.join(small(blocks), "cluster"), "minhash-members")
    count = members.count()
    # one row of each class, found by its id and text, is read again
    ids = members.select(F.col("row.doc_id").alias("id"), F.col("row.text_hash").alias("hash"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = texts.join(small(ids, count), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_semi")
    members = members.drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a task gives a set once, however often its row is repeated
        for batch in batches:
            fps, sets, size = [], [], 0
            for s in shingle_sets(batch.column(0)):
                if not len(s):
                    continue
                with np.errstate(over="ignore"):
                    fp = fingerprint(s)
                if fp in seen:
                    continue
                seen.add(fp)
                fps.append(fp)
                sets.append(s.tobytes())
                size += len(sets[-1])
                if size > 8 * LIMIT_SHINGLES:
                    yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], names=["fp", "shingles"])
                    fps, sets, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], names=["fp", "shingles"])

    sets = texts.select("text").mapInArrow(lean(run), "fp binary, shingles binary")
    # a large cluster is dealt in three ways, which join its blocks
    return joined(members, members, "cluster", ["shingles"], linked(percent), cut, 3, lambda met, rows=3 * count: sets.join(small(met, rows), "fp"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    One row of each component stays: the one with the smallest id (null ids last), of these the one with the smallest
    hash of its text. Of rows that repeat that id and text any one stays. Rows without shingles all stay.
    """
    rows = named(docs, percent).where("comp IS NOT NULL").select("comp", "doc_id", "text_hash")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    best = rows.groupBy("comp").agg(F.min(place).alias("best"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    judged = rows.join(small(materialize(best, "minhash-best")), "comp").withColumn("stays", place == F.col("best"))
    known, hashed = fresh(docs.columns, "id", "hash")
    judged = judged.groupBy(F.col("doc_id").alias(known), F.col("text_hash").alias(hashed)).agg(F.first("stays").alias("stays"), F.count("*").alias("n"))
    judged = materialize(judged.where("NOT stays OR n > 1"), "minhash-judged")  # a row's id and text tell its component
    gone, again = judged.where("NOT stays").select(known, hashed), judged.where("stays").select(known, hashed)
    n, repeated = (x.limit(BROADCAST_ROWS + 1).count() for x in (gone, again))
    same = (F.xxhash64("text") == F.col(hashed)) & F.col("doc_id").cast("long").eqNullSafe(F.col(known))
    out = docs.join(small(gone, n), same, "left_anti")
    if not repeated:
        return out
    # texts are dealt only of rows that are there more than once
    one = out.join(small(again, repeated), same).dropDuplicates([known, hashed]).select(*(quoted(c) for c in docs.columns))
    return out.join(small(again, repeated), same, "left_anti").unionByName(one)


def digest(docs: DataFrame) -> DataFrame:
    return duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def sql(percent: int = PERCENT) -> str:
    """DuckDB SQL for :func:`digest` over ``documents``."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, words, len(words) AS n FROM w),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN n = 0 THEN []::VARCHAR[] WHEN n < 5 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, n - 3), lambda i : array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM l),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * inter >= {percent} * (ca.n + cb.n - inter)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, seen) AS (SELECT doc_id, doc_id FROM l UNION SELECT d.b, r.seen FROM r JOIN d ON d.a = r.id),
m AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT l.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, m.component_id, l.doc_id = m.component_id AS kept
FROM l LEFT JOIN c USING (doc_id) JOIN m ON m.id = l.doc_id"""
