"""Pair features of entries by context, in NumPy inside Spark's tasks.

A context's entries come to a task as one row. What a sample meets there, its partners and the least difference of their objects, goes on as one row
of packed numbers, dealt by the sample, so no row is shuffled for each pair and context. Partners are numbers above the least sample, in as many bytes as all samples need. All that a sample meets is then summed by partner in one task,
which holds a sum for each partner and a bounded number of met pairs.

Contexts that very many entries have (``BUSY``) would be met by nearly every pair; their samples are dealt into blocks, and pairs of blocks meet in all such contexts at once,
as bits of objects or matrices of samples and objects (:mod:`blocks`). A task holds two packed blocks and sums of a part of one with the other. If all contexts are few they are all met so,
and no pair is shuffled; else the pairs of blocks and of lists are added up by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.operators import blocks
from sketchloom.session import bounded_batches, lean, materialize, measured, small

#: Entries of a context, as the root of both sides' product, beyond which it is met by blocks; least and most samples of a block, about how many blocks there are between, and samples of a part of a block that are compared at a time.
BUSY, LEAST, MOST, BLOCKS, PART = 2048, 256, 2048, 16, 128
#: Met pairs that are held at a time, and rows that are handed on at a time.
HELD, SENT = 1 << 21, 1 << 17
#: Distinct objects of a context up to which blocks are compared by matrix products, and contexts up to which all are met by blocks if any is.
OBJECTS, FEW = 512, 1024
_ODD = np.uint64(0x5555555555555555)
_FEATURES = "q long, r long, xny long, n_diff long, n_section long, n_mut2 long"
_NAMES = ["q", "r", "xny", "n_diff", "n_section", "n_mut2"]


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sections in which objects differ."""
    z = (x ^ y).view(np.uint64)
    return np.bitwise_count((z | (z >> np.uint64(1))) & _ODD).astype(np.uint8)


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of ``counts`` values as binaries."""
    offsets = np.r_[0, np.cumsum(counts * values.itemsize)].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of binaries, and how many each has."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, dtype=np.uint8)
    return np.frombuffer(raw.tobytes(), dtype=dtype), np.diff(at) // np.dtype(dtype).itemsize


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, sample and object of a column of lists of these, by row and sample."""
    flat = column.flatten()
    sample, obj = (np.asarray(flat.field(i)) for i in (0, 1))
    row = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths()))
    order = np.lexsort((sample, row))
    return row[order], sample[order], obj[order]


def narrow(low: int, high: int) -> np.dtype:
    """The type of numbers from 0 to the samples' span."""
    return next(np.dtype(x) for x in (np.uint8, np.uint16, np.uint32, np.uint64) if high - low <= np.iinfo(x).max)


def _met(batch: pa.RecordBatch, alone: bool, low: int, width: np.dtype) -> Iterator[pa.RecordBatch]:
    """A row for each query of a context: its partners there and the least difference to each."""
    row, q, q_obj = _lists(batch.column(0))
    if not len(row):
        return
    rows, r, r_obj = (row, q, q_obj) if alone else _lists(batch.column(1))
    group = np.cumsum(np.r_[True, (row[1:] != row[:-1]) | (q[1:] != q[:-1])]) - 1
    firsts = np.searchsorted(group, np.arange(group[-1] + 2))
    start = np.searchsorted(rows, row)
    stop = firsts[group] if alone else np.searchsorted(rows, row, side="right")  # of the same samples, only those before
    many = np.r_[False, (rows[1:] == rows[:-1]) & (r[1:] == r[:-1])]  # an object beyond the first
    several = many | np.r_[many[1:], False]
    upto = np.cumsum(np.r_[0, stop - start])
    ends = upto[firsts]
    g = 0
    while g < len(firsts) - 1:
        h = max(g + 1, int(np.searchsorted(ends, ends[g] + HELD, side="right")) - 1)
        own = np.arange(firsts[g], firsts[h])
        n = (stop - start)[own]
        left = np.repeat(own, n)
        right = np.arange(len(left)) - np.repeat(upto[own] - upto[own[0]] - start[own], n)
        lone = np.diff(firsts)[g:h].max() == 1 and not (several[right].any() if len(right) else False)
        by, partner, d = group[left], r[right], differing(q_obj[left], r_obj[right])
        if not lone:  # the least over objects
            order = np.lexsort((partner, by))
            by, partner, d = by[order], partner[order], d[order]
            new = np.flatnonzero(np.r_[True, (by[1:] != by[:-1]) | (partner[1:] != partner[:-1])]) if len(by) else np.empty(0, dtype=int)
            by, partner, d = by[new], partner[new], np.minimum.reduceat(d, new) if len(new) else d
        counts = np.bincount(by - g, minlength=h - g)
        kept = counts > 0
        if kept.any():
            yield pa.RecordBatch.from_arrays([pa.array(q[firsts[g:h]][kept]), packed((partner.view(np.uint64) - np.uint64(low % (1 << 64))).astype(width), counts[kept]), packed(d, counts[kept])], names=["q", "partners", "least"])
        g = h


def _summed(partner: np.ndarray, d: np.ndarray | None) -> list[np.ndarray]:
    low = partner.min()
    width = int(partner.max()) - int(low) + 1
    if width <= 4 * len(partner) + 1024:
        at = partner - low
        xny = np.bincount(at, minlength=width)
        found = np.flatnonzero(xny)
        names = found + low
    else:
        names, at = np.unique(partner, return_inverse=True)
        xny, width, found = np.bincount(at), len(names), np.arange(len(names))
    if d is None:
        return [names, xny[found]]
    less = lambda keep: np.bincount(at[keep], minlength=width)[found]
    section = np.bincount(at, weights=d, minlength=width)[found].astype(np.int64)
    return [names, xny[found], less(d > 0), section, less(d > 1)]


def _merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sums by partner of several parts as those of one."""
    if len(parts) == 1:
        return parts[0]
    names, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = []
    for k in range(1, len(parts[0])):
        total = np.zeros(len(names), dtype=np.int64)
        np.add.at(total, at, np.concatenate([p[k] for p in parts]))
        sums.append(total)
    return [names, *sums]


def by_partner(batches: Iterator[pa.RecordBatch], low: int, width: np.dtype, held: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Sums of each query's pairs; rows come by query. Without differences pairs are counted only. ``held`` met pairs are held at a time, and a sum for each partner."""
    now, met, size, sums = None, [], 0, []

    def add_up() -> None:
        nonlocal met, size, sums
        if met:
            sums.append(_summed(np.concatenate([p for p, _ in met]), None if met[0][1] is None else np.concatenate([d for _, d in met])))
        if len(sums) > 8:
            sums = [_merged(sums)]
        met, size = [], 0

    def done() -> Iterator[pa.RecordBatch]:
        nonlocal sums
        add_up()
        made = _merged(sums)
        sums = []
        for at in range(0, len(made[0]), SENT):
            some = [c[at : at + SENT] for c in made]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some[0]), now)), pa.array(some[0] + low), *(pa.array(c.astype(np.int64)) for c in some[1:])], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        q = np.asarray(batch.column(0))
        partner, counts = unpacked(batch.column(1), width)
        d = unpacked(batch.column(2), np.uint8)[0] if batch.num_columns > 2 else None
        upto = np.r_[0, np.cumsum(counts)]
        cuts = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1, len(q)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if (met or sums) and q[a] != now:
                yield from done()
            now = q[a]
            for x in range(upto[a], upto[b], held):
                some = slice(x, min(upto[b], x + held))
                met.append((partner[some].astype(np.int64), None if d is None else d[some].copy()))
                size += len(met[-1][0])
                if size >= held:
                    add_up()
    if met or sums:
        yield from done()


def by_lists(qry: DataFrame, ref: DataFrame | None, low: int, high: int) -> DataFrame:
    """Features of all pairs, by contexts' lists of entries; partners are samples from ``low`` to ``high``. Rows come by query, each query's in one task and without others between."""
    width, held = narrow(low, high), HELD
    alone = ref is None
    listed = lambda e, name: e.groupBy("ctx").agg(F.collect_list(F.struct("sample_id", "obj")).alias(name))
    rows = listed(qry, "qs") if alone else listed(qry, "qs").withColumn("rs", F.col("qs")) if ref is qry else listed(qry, "qs").join(listed(ref, "rs"), "ctx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                yield from _met(batch.slice(at, 4096), alone, low, width)

    met = rows.select("qs", *([] if alone else ["rs"])).mapInArrow(lean(run), "q long, partners binary, least binary")
    return met.repartition("q").sortWithinPartitions("q").mapInArrow(lean(lambda batches: by_partner(batches, low, width, held, _NAMES)), _FEATURES)


def _pack(table: pa.Table) -> pa.Table:
    """A block's samples, its distinct contexts and objects in order, and which samples have each: as bits, or as places of runs where that is shorter."""
    samples, place = np.unique(table["sample_id"].to_numpy(), return_inverse=True)
    ctx, obj = table["ctx"].to_numpy(), table["obj"].to_numpy()
    order = np.lexsort((place, obj, ctx))
    place, ctx, obj = place[order], ctx[order], obj[order]
    new = np.r_[True, (ctx[1:] != ctx[:-1]) | (obj[1:] != obj[:-1])]
    keep = new | np.r_[True, place[1:] != place[:-1]]
    place, new = place[keep], new[keep]
    key = np.cumsum(new) - 1
    firsts = np.flatnonzero(new)
    counts = np.diff(np.r_[firsts, len(place)])
    width = -(-len(samples) // 8)
    if len(counts) * width <= 4 * len(place):
        bits = np.zeros((len(counts), len(samples)), dtype=bool)
        bits[key, place] = True
        held, counts = np.packbits(bits, axis=1).tobytes(), counts[:0]
    else:
        held = place.astype(np.uint32).tobytes()
    one = lambda x: pa.array([x.astype(np.int64)], pa.list_(pa.int64()))
    return pa.table([one(samples), one(ctx[keep][firsts]), one(obj[keep][firsts]), one(counts), pa.array([held], pa.binary())], names=["samples", "ctx", "obj", "counts", "held"])


_PACKED = "samples array<long>, ctx array<long>, obj array<long>, counts array<long>, held binary"


def _unpacked(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's samples, its contexts and objects, and of each entry the number of these and the sample's place, in order of both."""
    samples, ctx, obj, counts = (np.asarray(block[c][0].values) for c in ("samples", "ctx", "obj", "counts"))
    held = block["held"][0].as_buffer()
    if len(counts):
        return samples, ctx, obj, np.repeat(np.arange(len(ctx)), counts), np.frombuffer(held, dtype=np.uint32).astype(np.int64)
    bits = np.unpackbits(np.frombuffer(held, dtype=np.uint8).reshape(len(ctx), -1), axis=1, count=len(samples))
    return samples, ctx, obj, *np.nonzero(bits)


def _least(a: np.ndarray, a_obj: np.ndarray, b: np.ndarray, b_obj: np.ndarray) -> np.ndarray:
    """The least differences (places of ``a`` x places of ``b``) of entries in one context; places are 0, 1, ... and sorted."""
    n, m = a[-1] + 1, b[-1] + 1
    values, at = np.unique(np.r_[a_obj, b_obj], return_inverse=True)
    if len(values) > OBJECTS:
        first, second = np.searchsorted(a, np.arange(n)), np.searchsorted(b, np.arange(m))
        out = np.empty((n, m), dtype=np.uint8)
        for i in range(n):
            own = a_obj[first[i] : first[i + 1] if i + 1 < n else None]
            d = differing(b_obj, np.full(len(b_obj), own[0]))
            for x in own[1:]:
                d = np.minimum(d, differing(b_obj, np.full(len(b_obj), x)))
            out[i] = np.minimum.reduceat(d, second)
        return out
    far = differing(np.repeat(values, len(values)), np.tile(values, len(values))).reshape(len(values), -1)
    has_a, has_b = np.zeros((n, len(values)), dtype=np.float32), np.zeros((m, len(values)), dtype=np.float32)
    has_a[a, at[: len(a)]] = 1
    has_b[b, at[len(a) :]] = 1
    out = np.zeros((n, m), dtype=np.uint8)
    for t in range(int(far.max())):
        near = (has_a @ (far <= t).astype(np.float32) > 0).astype(np.float32)
        missed = near @ has_b.T == 0
        if not missed.any():
            break
        out += missed
    return out


def _near(far: np.ndarray, t: int, has: np.ndarray, dtype: type) -> np.ndarray:
    """Of each row of ``has`` (samples x objects) the bits of the other side's objects that differ in ``t`` sections at most from one of it."""
    bits = np.where(far <= t, np.left_shift(dtype(1), np.arange(far.shape[1], dtype=dtype))[None, :], dtype(0))
    masks = np.bitwise_or.reduce(bits, axis=1)
    return np.bitwise_or.reduce(np.where(has, masks[None, :], dtype(0)), axis=1)


def _part_met(sums: np.ndarray, a: np.ndarray, a_obj: np.ndarray, b: np.ndarray, b_obj: np.ndarray, a_values: np.ndarray, b_values: np.ndarray) -> None:
    """Adds a context's sections, differences and multiple ones to ``sums`` (3 x places of a part x places of a block) by bits of objects; ``a_obj`` and ``b_obj`` are numbers of values."""
    _, n, m = sums.shape
    dtype = np.uint32 if len(b_values) < 32 else np.uint64
    absent = dtype(1) << dtype(len(b_values))  # a bit of all rows that a missing partner has, so that what is missing differs in nothing
    far = differing(np.repeat(a_values, len(b_values)), np.tile(b_values, len(a_values))).reshape(len(a_values), -1)
    has = np.zeros((n, len(a_values)), dtype=bool)
    has[a, a_obj] = True
    missing = ~has.any(axis=1)
    other = np.zeros(m, dtype=dtype)
    np.bitwise_or.at(other, b, np.left_shift(dtype(1), b_obj.astype(dtype)))
    other[other == 0] = absent
    full = ~dtype(0)
    for t in range(int(far.max())):
        near = _near(far, t, has, dtype) | absent
        near[missing] = full
        missed = ((near[:, None] & other[None, :]) == 0).view(np.uint8)
        if not missed.any():
            break
        sums[0] += missed
        if t < 2:
            sums[1 + t] += missed


def _blocks_met(same: bool, left: dict, right: dict, alone: bool, part: int) -> Iterator[pa.RecordBatch]:
    qs, q_ctx, q_obj, q_key, q = _unpacked(left)
    rs, r_ctx, r_obj, r_key, r = _unpacked(right)
    shared = np.intersect1d(q_ctx, r_ctx)
    if not len(shared):
        return
    i, j = ([np.searchsorted(ctx, shared, side=s) for s in ("left", "right")] for ctx in (q_ctx, r_ctx))  # numbers of a context's objects, from and to
    most = len(shared) * int(np.bitwise_count(np.bitwise_or.reduce(np.r_[q_obj, r_obj]) ^ np.bitwise_and.reduce(np.r_[q_obj, r_obj])))  # sections are no more than differing bits
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
    right_of = [slice(*np.searchsorted(r_key, [j[0][c], j[1][c]])) for c in range(len(shared))]
    held = np.zeros((len(shared), len(rs)), dtype=np.float32)
    for c, s in enumerate(right_of):
        held[c, r[s]] = 1
    for at in range(0, len(qs), part):
        n = min(part, len(qs) - at)
        own = (q >= at) & (q < at + n)
        p, p_key = q[own] - at, q_key[own]
        sums = np.zeros((3, n, len(rs)), dtype=kind)
        has = np.zeros((n, len(shared)), dtype=np.float32)
        for c, s in enumerate(right_of):
            mine = slice(*np.searchsorted(p_key, [i[0][c], i[1][c]]))
            a, a_obj = p[mine], p_key[mine] - i[0][c]
            if not len(a):
                continue
            has[a, c] = 1
            b, b_obj = r[s], r_key[s] - j[0][c]
            a_values, b_values = q_obj[i[0][c] : i[1][c]], r_obj[j[0][c] : j[1][c]]
            if len(b_values) < 64 and len(a) * len(b) * 4 > n * len(rs):
                _part_met(sums, a, a_obj, b, b_obj, a_values, b_values)
                continue
            by = lambda place, obj: (lambda o: (place[o], obj[o]))(np.argsort(place, kind="stable"))
            (a, a_obj), (b, b_obj) = by(a, a_values[a_obj]), by(b, b_values[b_obj])
            (x, a_at), (y, b_at) = (np.unique(v, return_inverse=True) for v in (a, b))
            d = _least(a_at, a_obj, b_at, b_obj)
            where = np.ix_(x, y)
            for k, v in enumerate((d, d > 0, d > 1)):
                sums[k][where] += v
        xny = has @ held
        met = xny > 0
        if same:
            met &= rs[None, :] < qs[at : at + n, None]
        if met.all():
            first, second = np.repeat(qs[at : at + n], len(rs)), np.tile(rs, n)
            told = [xny.ravel(), *(sums[k].ravel() for k in (1, 0, 2))]
        else:
            x, y = np.nonzero(met)
            first, second = qs[at + x], rs[y]
            told = [xny[x, y], *(sums[k][x, y] for k in (1, 0, 2))]
        if len(first):
            if alone:
                first, second = np.maximum(first, second), np.minimum(first, second)
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), *(pa.array(c.astype(np.int64)) for c in told)], names=_NAMES)


def by_blocks(qry: DataFrame, ref: DataFrame | None) -> DataFrame:
    """Features of all pairs, by blocks of samples; a pair's row is made once, whole, and isn't shuffled."""
    alone, part = ref is None, PART

    def side(e: DataFrame) -> blocks.Blocks:
        n = e.select("sample_id").distinct().count()
        return blocks.dealt(e.select("sample_id", "ctx", "obj"), max(1, -(-n // min(MOST, max(LEAST, n // BLOCKS)))), "sample_id", _pack, _PACKED)

    return blocks.met(side(qry), None if alone else side(ref), lambda same, left, right: _blocks_met(same, left, right, alone, part), _FEATURES)


def features(qry: DataFrame, ref: DataFrame | None) -> DataFrame | None:
    """Features of all pairs that share a context; with ``ref`` None each pair of ``qry`` once, q > r, and with ``ref`` the same frame in both directions and with itself. ``by_query`` of
    what is made tells if a query's rows follow one another in one task. None where objects are null, or samples, contexts or objects aren't whole numbers."""
    whole_numbers = ("tinyint", "smallint", "int", "bigint")
    types = [{c: dict(e.dtypes)[c] for c in ("sample_id", "ctx", "obj")} for e in ([qry] if ref is None else [qry, ref])]
    if any(t not in whole_numbers for side in types for t in side.values()):
        return None
    bounded_batches(qry.sparkSession)
    whole = lambda e: e.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("ctx").cast("long").alias("ctx"), F.col("obj").cast("long").alias("obj")).where("sample_id IS NOT NULL AND ctx IS NOT NULL").distinct()
    told = {"odd": F.count_if(F.col("obj").isNull()), "low": F.min("sample_id"), "high": F.max("sample_id")}
    q, seen = measured(whole(qry), "entries", **told)
    r, other = (q, seen) if ref is None or ref is qry else measured(whole(ref), "entries", **told)
    if seen["odd"] or other["odd"]:
        return None
    span, own = ((x["low"] or 0, x["high"] or 0) for x in (other, seen))
    count = lambda e, name: e.groupBy("ctx").agg(F.count("*").alias(name))
    sizes = count(q, "n").withColumn("m", F.col("n")) if ref is None or ref is qry else count(q, "n").join(count(r, "m"), "ctx")
    hot = F.sqrt(F.col("n").cast("double") * F.col("m")) > BUSY
    told = sizes.agg(F.count_if(hot).alias("busy"), F.count("*").alias("all")).first()
    turned = ref is not None and narrow(*own).itemsize < narrow(*span).itemsize  # differences have no direction, so few samples' numbers are the partners
    listed = lambda x, y: by_lists(y, x, *own).select(F.col("r").alias("q"), F.col("q").alias("r"), *_NAMES[2:]) if turned else by_lists(x, y, *span)
    if not told["busy"]:
        made = listed(q, None if ref is None else r)
    elif told["all"] <= max(FEW, told["busy"]):
        made = by_blocks(q, None if ref is None else r)
    else:
        few = small(materialize(sizes.where(hot).select("ctx"), "busy"), told["busy"])
        inside = lambda e, how: e.join(few, "ctx", how)
        dense = by_blocks(inside(q, "left_semi"), None if ref is None else inside(r, "left_semi"))
        lists = listed(inside(q, "left_anti"), None if ref is None else inside(r, "left_anti"))
        made = dense.unionByName(lists).groupBy("q", "r").agg(*(F.sum(c).alias(c) for c in _NAMES[2:]))
    back = {n: F.col(n).cast(types[i]["sample_id"]) for n, i in (("q", 0), ("r", -1)) if types[i]["sample_id"] != "bigint"}
    made = made.withColumns(back) if back else made
    made.by_query = not told["busy"] and not turned
    return made
