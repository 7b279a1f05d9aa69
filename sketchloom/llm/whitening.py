"""Whitening of embeddings by an exact integer scatter matrix.

Each entry c of a vector becomes the whole number x = floor(256 * c). The fit list is each different x vector once. Its cross-products are counted
bit by bit: a dimension's x less its least value is a row of bit planes, the planes of many rows are packed into 64-bit words, and
the cross-product of two dimensions is the sum, over pairs of their planes, of the one bits of the words' AND, times the planes'
weights. A task hands on a count for each two dimensions and each weight, the counts are summed by Spark, and everything until the division
is whole numbers without a bound: n * sum(x y) - sum(x) * sum(y) is the covariance times n squared, exactly. Only that is turned into
doubles, for the eigenvectors.

The driver holds a matrix of the dimensions, nothing that grows with the rows. Cost is rows / 64 * (dimensions * planes)**2 / 2 words; planes are the bits
of a dimension's range.

Defined results: vectors that are null or hold nulls, infinities or NaN take no part, nor do those of another length than most (the longer of
equally frequent ones), as they have no place in the matrix; zero vectors and rows without an id take part; repeated rows repeat in the
result and count once in the fit; entries whose x is beyond a 64-bit integer become the nearest one; ``deviation`` is null if it is beyond a 64-bit
integer; a component without variance (below ``FLAT`` of the trace) has null ``whitened`` and isn't in ``identity_error``, which is null if there is none; ``explained`` is null
if nothing varies; an empty table, or vectors of no entries, give no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.session import bounded_batches, lean, materialize

SCALE, COMPONENTS = 256, 4
#: Rows whose bit planes are packed at a time, a multiple of 64.
PACKED = 4096
#: Share of the trace below which a variance can't be told from none in doubles.
FLAT = 1e-12


def integers(df: DataFrame) -> DataFrame:
    """vec_id and x of the rows that take part."""
    finite = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & finite)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (sizes["d"] if sizes else 0)).where(F.size("embedding") > 0).select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(float(SCALE)) * c)).alias("x"))


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Rows by dimensions of a batch's array column."""
    held = batch.column(batch.schema.get_field_index(column))
    return held.flatten().to_numpy().reshape(len(held), -1)


def ranges(fit: DataFrame, width: int) -> tuple[list[int], list[int]]:
    """Least and greatest x of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, "x")
                low, high = (x.min(0), x.max(0)) if low is None else (np.minimum(low, x.min(0)), np.maximum(high, x.max(0)))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(low), pa.array(high)], ["i", "low", "high"])

    rows = {r["i"]: r for r in fit.mapInArrow(run, "i long, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    return [rows[i]["low"] for i in range(width)], [rows[i]["high"] for i in range(width)]


def planes(x: np.ndarray, low: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bit planes (planes by words) of x less its least values, and each plane's dimension and place.

    The shifted values are taken modulo 2**64, in which they fit.
    """
    shifted = x.astype(np.uint64) - low.astype(np.uint64)
    packed, owner, place = [], [], []
    rows = -(-len(x) // 64) * 64
    for i, n in enumerate(bits):
        for p in range(n):
            ones = np.zeros(rows, dtype=np.uint8)
            ones[: len(x)] = (shifted[:, i] >> np.uint64(p)) & np.uint64(1)
            packed.append(np.packbits(ones).view(np.uint64))
            owner.append(i)
            place.append(p)
    return np.array(packed, dtype=np.uint64).reshape(len(owner), rows // 64), np.array(owner, dtype=np.int64), np.array(place, dtype=np.int64)


def scatter(fit: DataFrame, low: list[int], high: list[int]) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors, sums and cross-products of x, exact, by counts of one bits for two dimensions and a weight.

    A plane's own count is kept as its product with a dimension beyond the last, that of ones.
    """
    width, bits = len(low), [(b - a).bit_length() for a, b in zip(low, high, strict=True)]
    shared = fit.sparkSession.sparkContext.broadcast((np.array(low, dtype=np.int64), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, bits = shared.value
        weights = max(2 * max(bits) - 1, 1)
        held, rows = np.zeros(((width + 1) * (width + 1), weights), dtype=np.int64), 0
        for batch in batches:
            whole = matrix(batch, "x") if batch.num_rows else np.empty((0, width), dtype=np.int64)
            rows += len(whole)
            for at in range(0, len(whole), PACKED):
                packed, owner, place = planes(whole[at : at + PACKED], low, bits)
                alone = np.bitwise_count(packed).sum(1, dtype=np.int64)
                np.add.at(held, (owner * (width + 1) + width, place), alone)
                for k in range(len(packed)):  # plane k with itself and all later ones
                    both = np.bitwise_count(packed[k:] & packed[k]).sum(1, dtype=np.int64)
                    both[1:] <<= owner[k + 1 :] == owner[k]  # two planes of one dimension meet twice in its square
                    np.add.at(held, (owner[k] * (width + 1) + owner[k:], place[k] + place[k:]), both)
        held[width * (width + 1) + width, 0] = rows
        cell, weight = np.nonzero(held)
        for at in range(0, len(cell), 10_000):
            c, w = cell[at : at + 10_000], weight[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(c // (width + 1)), pa.array(c % (width + 1)), pa.array(w), pa.array(held[c, w])], ["i", "j", "weight", "ones"])

    counted = fit.mapInArrow(lean(run), "i long, j long, weight long, ones long").groupBy("i", "j", "weight").agg(F.sum("ones").alias("ones"))
    cells = counted.groupBy("i", "j").agg(F.collect_list(F.struct("weight", "ones")).alias("parts")).collect()  # a row for each two dimensions
    total = {(r["i"], r["j"]): sum(ones << weight for weight, ones in r["parts"]) for r in cells}
    n = total.get((width, width), 0)
    over = [total.get((i, width), 0) for i in range(width)]  # sums of what is above the least values

    def product(i: int, j: int) -> int:
        return total.get((min(i, j), max(i, j)), 0) + low[i] * over[j] + low[j] * over[i] + n * low[i] * low[j]

    return n, [over[i] + n * low[i] for i in range(width)], [[product(i, j) for j in range(width)] for i in range(width)]


def components(n: int, sums: list[int], products: list[list[int]], count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (as columns) and eigenvalues of the covariance by falling eigenvalue, and its trace."""
    width = len(sums)
    centred = [[n * products[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    covariance = np.array([[c / (n * n) for c in row] for row in centred])  # a quotient of whole numbers is correctly rounded
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:count]
    vectors = vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    fine = []
    for v in vectors.T:  # v' V v / v' v in whole numbers: a small eigenvalue is as exact as a large one
        w = [round(float(c) * 2.0**60) for c in v]
        moved = [sum(c * x for c, x in zip(row, w, strict=True)) for row in centred]
        fine.append(max(0, sum(a * b for a, b in zip(w, moved, strict=True))) / (n * n * sum(c * c for c in w)))
    return vectors, np.array(fine), sum(centred[i][i] for i in range(width)) / (n * n)


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """x - S / n in doubles, and the exact sum over dimensions of (n x - S)**2, None where it is beyond 64 bits."""
    most = max(n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))), 0) + max(map(abs, sums))
    if most * most * len(sums) < 2**63:
        off = n * x - np.array(sums, dtype=np.int64)
        return off / n, (off * off).sum(1).tolist()
    off = n * x.astype(object) - np.array(sums, dtype=object)
    far = [int(v) for v in (off * off).sum(1)]
    return (off / n).astype(float), [v if v < 2**63 else None for v in far]


def whitened(rows: DataFrame, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, trace: float) -> DataFrame:
    """vec_id, component, deviation and whitened of every row of :func:`integers`."""
    flat = values <= FLAT * trace
    scale = np.where(flat, 0.0, 1 / np.sqrt(np.where(flat, 1.0, values)))
    shared = rows.sparkSession.sparkContext.broadcast((n, sums, vectors * scale, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, turn, flat = shared.value
        many = turn.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            off, far = centred(matrix(batch, "x"), n, sums)
            made = off @ turn
            at = pa.array(np.repeat(np.arange(batch.num_rows), many))
            none = np.tile(flat, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), batch.num_rows)), pa.array(far, pa.int64()).take(at), pa.array(np.where(none, 0.0, made.ravel()), mask=none)],
                ["vec_id", "component", "deviation", "whitened"],
            )

    return rows.mapInArrow(lean(run), "vec_id long, component int, deviation long, whitened double")


def identity_error(fit: DataFrame, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, trace: float) -> float | None:
    """Largest absolute entry of the covariance of the fit list's whitened values, measured on them, less the identity."""
    flat = values <= FLAT * trace
    if flat.all():
        return None
    shared = fit.sparkSession.sparkContext.broadcast((n, sums, vectors[:, ~flat] / np.sqrt(values[~flat])))
    many = int((~flat).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, turn = shared.value
        total = np.zeros((many + 1, many + 1))
        for batch in batches:
            if batch.num_rows:
                made = np.column_stack([centred(matrix(batch, "x"), n, sums)[0] @ turn, np.ones(batch.num_rows)])
                total += made.T @ made
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    sums_of = np.zeros((many + 1, many + 1))
    for r in fit.mapInArrow(lean(run), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums_of[r["i"], r["j"]] = r["v"]
    mean = sums_of[:many, many] / n
    return float(np.abs(sums_of[:many, :many] / n - np.outer(mean, mean) - np.eye(many)).max())


def digest(df: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """The contract's columns for every row that takes part and its first components."""
    bounded_batches(df.sparkSession)
    rows = integers(df)
    fit = materialize(rows.select("x").distinct(), "fit")
    first = fit.select(F.size("x").alias("d")).first()
    if first is None:
        return rows.selectExpr("vec_id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error").where("false")
    low, high = ranges(fit, first["d"])
    n, sums, products = scatter(fit, low, high)
    vectors, values, trace = components(n, sums, products, count)
    error = identity_error(fit, n, sums, vectors, values, trace)
    share = F.element_at(F.array(*(F.lit(float(v / trace) if trace else None).cast("double") for v in values)), F.col("component"))
    found = whitened(rows, n, sums, vectors, values, trace)
    return found.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
