"""Composition profiles and abundance vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.operators import blocks
from sketchloom.session import measured, small

#: Fewest shared keys of a profile row, and more than which an abundance vector has. Fixed values.
LEAST_SHARED = 6
TAIL = (0.98, 0.99)
#: Samples of a block, queries of it that are compared at a time, and the share of pairs that dimensions must make for blocks to meet.
BLOCK, PART, DENSE = 2048, 128, 0.125


def composition(qry: DataFrame, markers: DataFrame) -> DataFrame:
    """For each query and reference: shared keys, mean count, mean of the upper tail, median and largest count.

    ``qry`` has counts, ``markers`` a reference's keys. The tail's divisor is its number of slots plus one.
    """
    q = qry.select(F.col("sample_id").alias("q"), "ctx", "obj", F.col("cnt").alias("c"))
    r = markers.select(F.col("sample_id").alias("r"), "ctx", "obj")
    pair = Window.partitionBy("q", "r")
    met = q.join(r, ["ctx", "obj"]).select("q", "r", "c", (F.row_number().over(pair.orderBy("c")) - 1).alias("i"), F.count("*").over(pair).alias("n"))
    met = met.where(F.col("n") >= LEAST_SHARED)
    first, stop = F.floor(F.col("n") * F.lit(TAIL[0])), F.col("n") * F.lit(TAIL[1])
    got = met.groupBy("q", "r", "n").agg(
        F.avg("c").alias("mean"),
        F.sum(F.when((F.col("i") >= first) & (F.col("i") < stop), F.col("c")).otherwise(0)).alias("_tail"),
        F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("c"))).alias("median"),
        F.max("c").alias("max"),
    )
    return got.select("q", "r", "n", "mean", (F.col("_tail") / (F.floor(F.col("n") * F.lit(TAIL[1])) - first + 1)).alias("tail_mean"), "median", "max")


def abundance_vectors(profile: DataFrame) -> DataFrame:
    """Sparse vectors in percent from profile rows with a median above 1 and more than seven keys."""
    kept = profile.where((F.col("median") > 1) & (F.col("n") > LEAST_SHARED + 1))
    whole = Window.partitionBy("q")
    share = (F.col("tail_mean") - 1) * 100 / (F.sum("tail_mean").over(whole) - F.count("*").over(whole))
    return kept.select(F.col("q").alias("sample"), F.col("r").alias("ref_idx"), share.alias("pct"))


def vector_norms(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("sample").agg(F.sqrt(F.sum(F.col("pct") * F.col("pct"))).alias("norm"))


def _layers(sample: np.ndarray, value: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A dimension's rows as parts that have each sample once."""
    out = []
    while len(sample):
        _, first = np.unique(sample, return_index=True)
        out.append((sample[first], value[first]))
        rest = np.delete(np.arange(len(sample)), first)
        sample, value = sample[rest], value[rest]
    return out


def _pack(table: pa.Table) -> pa.Table:
    """A block's samples and dimensions, and of each row the places of both and the value, by dimension."""
    samples, dims = (table[c].combine_chunks().dictionary_encode() for c in ("sample", "ref_idx"))
    samples, dims = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (samples, dims))
    at, dim = np.asarray(samples.indices), np.asarray(dims.indices)
    order = np.lexsort((at, dim))
    one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
    told = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.table([one(samples.dictionary), one(dims.dictionary), told(at[order].astype(np.int32)), told(dim[order].astype(np.int32)), told(table["pct"].to_numpy()[order])], names=["samples", "dims", "at", "dim", "pct"])


def _unpacked(block: dict) -> tuple[pa.Array, dict, np.ndarray]:
    """A block's samples, each dimension's rows as layers, and the samples' norms."""
    samples, dims = block["samples"][0].values, block["dims"][0].values
    at, dim, pct = (np.frombuffer(block[c][0].as_buffer(), dtype=t) for c, t in (("at", np.int32), ("dim", np.int32), ("pct", np.float64)))
    cuts = np.searchsorted(dim, np.arange(len(dims) + 1))
    names = dims.to_numpy(zero_copy_only=False)
    rows = {names[k]: _layers(at[x:y], pct[x:y]) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))}
    return samples, rows, np.sqrt(np.bincount(at, weights=pct * pct, minlength=len(samples)))


def _blocks_met(left: dict, right: dict, measure: str, part: int) -> Iterator[pa.RecordBatch]:
    """q, s and value of the samples of two blocks that share a dimension, some queries at a time."""
    (qs, of_q, q_norm), (ss, of_s, s_norm) = _unpacked(left), _unpacked(right)
    shared = sorted(of_q.keys() & of_s.keys())
    for at in range(0, len(qs), part):
        n = min(part, len(qs) - at)
        sums, met = np.zeros((n, len(ss))), np.zeros((n, len(ss)), dtype=bool)
        for d in shared:
            for place, x in of_q[d]:
                own = slice(*np.searchsorted(place, [at, at + n]))
                a, u = place[own] - at, x[own]
                if not len(a):
                    continue
                for b, v in of_s[d]:
                    u1, v1 = u[:, None], v[None, :]
                    more = u1 * v1 if measure == "cosine" else np.abs(u1 - v1) - u1 - v1 if measure == "l1" else (u1 - v1) ** 2
                    if len(a) == n and len(b) == len(ss):
                        sums += more
                        met[:] = True
                    else:
                        where = np.ix_(a, b)
                        sums[where] += more
                        met[where] = True
        if measure == "cosine":
            with np.errstate(divide="ignore", invalid="ignore"):
                sums /= q_norm[at : at + n, None] * s_norm[None, :]
        else:
            sums = sums + 200 if measure == "l1" else np.sqrt(sums)
        if met.all():
            i, j, told = np.repeat(np.arange(n), len(ss)), np.tile(np.arange(len(ss)), n), sums.ravel()
        else:
            i, j = np.nonzero(met)
            told = sums[i, j]
        if len(i):
            yield pa.RecordBatch.from_arrays([qs.take(pa.array(i + at)), ss.take(pa.array(j)), pa.array(told)], names=["q", "s", "value"])


def _by_blocks(qry: DataFrame, n_q: int, index: DataFrame, n_s: int, measure: str) -> DataFrame:
    """q, s and value by pairs of blocks of samples; no pair is shuffled."""
    part, kinds = PART, [dict(df.dtypes) for df in (qry, index)]

    def side(df: DataFrame, n: int, kind: dict) -> blocks.Blocks:
        rows = df.select("sample", "ref_idx", F.col("pct").cast("double").alias("pct"))
        return blocks.dealt(rows, max(1, -(-n // BLOCK)), "sample", _pack, f"samples array<{kind['sample']}>, dims array<{kind['ref_idx']}>, at binary, dim binary, pct binary")

    left = side(qry, n_q, kinds[0])
    right = left if index is qry else side(index, n_s, kinds[1])
    return blocks.met(left, right, lambda _, a, b: _blocks_met(a, b, measure, part), f"q {kinds[0]['sample']}, s {kinds[1]['sample']}, value double")


def _in_blocks(qry: DataFrame, index: DataFrame, measure: str) -> DataFrame | None:
    """The values by blocks, if many pairs share dimensions; None if few do, or if something is null, not finite or a norm is 0."""
    sizes = []
    for df in [qry] if qry is index else [qry, index]:
        odd = F.col("sample").isNull() | F.col("ref_idx").isNull() | F.col("pct").isNull() | ~(F.abs("pct") < float("inf"))
        rows, seen = measured(df.select("sample", "ref_idx", "pct"), "vectors", odd=F.count_if(odd))
        zero = vector_norms(rows).agg(F.count("*").alias("n"), F.count_if(F.col("norm") == 0).alias("zero")).first()
        if seen["odd"] or (zero["zero"] and measure == "cosine"):
            return None
        sizes.append((rows, zero["n"]))
    (q, n_q), (s, n_s) = sizes[0], sizes[-1]
    count = lambda df, name: df.groupBy("ref_idx").agg(F.count("*").cast("double").alias(name))
    shared = count(q, "_n").join(count(s, "_m"), "ref_idx").agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0.0
    return _by_blocks(q, n_q, s, n_s, measure) if shared > DENSE * n_q * n_s else None


def vector_search(qry: DataFrame, index: DataFrame, measure: str = "cosine") -> DataFrame:
    """Samples that share a dimension with a query, by cosine (falling), L1 or L2 (rising).

    L1 adds the mass that isn't shared, with vectors scaled to 100; L2 is over shared dimensions. Where many pairs share a dimension, blocks of samples meet, and no
    pair is shuffled but for its rank.
    """
    if measure not in ("cosine", "l1", "l2"):
        raise ValueError("measure is cosine, l1 or l2")
    order = F.desc("value") if measure == "cosine" else F.asc("value")
    out = _in_blocks(qry, index, measure)
    if out is None:
        out = _joined(qry, index, measure)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(order, F.asc("s"))))


def _joined(qry: DataFrame, index: DataFrame, measure: str) -> DataFrame:
    """The values by dimension."""
    x = qry.select(F.col("sample").alias("q"), "ref_idx", F.col("pct").alias("x"))
    y = index.select(F.col("sample").alias("s"), "ref_idx", F.col("pct").alias("y"))
    met = x.join(y, "ref_idx")
    if measure == "cosine":
        dots = met.groupBy("q", "s").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
        qn = vector_norms(qry).select(F.col("sample").alias("q"), F.col("norm").alias("_q"))
        sn = vector_norms(index).select(F.col("sample").alias("s"), F.col("norm").alias("_s"))
        return dots.join(small(qn), "q").join(small(sn), "s").select("q", "s", (F.col("dot") / (F.col("_q") * F.col("_s"))).alias("value"))
    if measure == "l1":
        return met.groupBy("q", "s").agg((F.sum(F.abs(F.col("x") - F.col("y"))) + 200 - F.sum("x") - F.sum("y")).alias("value"))
    return met.groupBy("q", "s").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), 2))).alias("value"))
