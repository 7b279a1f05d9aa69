"""Nearest neighbours by additive quantisation.

A vector is approximated by a sum of one entry from each of ``BOOKS`` codebooks, each of full
dimension. The codebooks start as residual k-means on a bounded sample (``SAMPLE`` vectors, chosen by a hash
of their ids) and are refined by least squares between beam-search encodings. Every row
is encoded by beam search and written with its codes, the norm of its approximation, its
vector and the coarse cell it lies in; that is the index. Cells are k-means of the same sample.

A query looks into every cell that can hold one of its neighbours: its tenth distance to others of the sample's rows bounds the tenth of all rows, and a cell whose
centre is farther than that and the cell's radius holds none. Few cells are left where vectors lie in clusters, all of them where they don't. Index and queries meet by cell. A cell's
rows are dealt into chunks and its queries into blocks of bounded size, so no cell is collected whole; queries are rows, never
collected, and the plan is the same however many there are. In each chunk a
query is scored against all codes by table lookup, |q|^2 - 2 <q, x'> + |x'|^2, and the best ``RERANK`` distinct vectors are measured exactly, in double
precision. So is any other whose distance to the query, by its code's distance and the length of what the code leaves out (written with it), may be
below the tenth of these. So codes leave out only what is no neighbour, however the rows lie, and nothing rests on how well they fit the rows. Chunks keep ten rows for each query; a ranking by query merges them.
Codes and bounds are of vectors shifted and scaled by the sample. Queries are a stated set, here the rows whose id is divisible by 100.

Defined results: vectors that are null, zero, hold nulls, infinities or NaN, or have another length than most
(the longer of equally frequent ones) take no part, nor do rows without an id; equal vectors are one vector in
a chunk with up to eleven of its smallest ids, as more can't be among ten; equal distances go
to the smaller id; rows with the query's own id are no candidates; a repeated
row counts once; an empty table, or one without valid rows, gives no rows; vectors of doubles are kept and measured as such; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sketchloom.session import lean, materialize

BOOKS, ENTRIES, BEAM, SAMPLE, ROUNDS, NEAREST = 8, 256, 8, 10_000, 2, 10
#: The best of a chunk that are measured before others are left out.
RERANK = 128
#: Sample vectors for each cell, and how many of them bound a query's tenth distance.
CELL_ROWS, KNOWN = 64, 4096
#: By how much bounds are widened for rounding, as a part of what they are made of.
SLACK = 1e-9
#: Rows of a cell, and queries in a cell, that are held at a time.
CHUNK, BLOCK = 16_384, 4096
SEED = 7


def valid(df: DataFrame) -> DataFrame:
    """vec_id and embedding (floats, or doubles if they are no floats) of the rows that take part."""
    kind = "array<float>" if df.schema["embedding"].dataType == ArrayType(FloatType(), df.schema["embedding"].dataType.containsNull) else "array<double>"
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    finite = F.forall("embedding", lambda x: F.coalesce((x == x) & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(finite & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (sizes["d"] if sizes else 0))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)
        n = np.bincount(near, minlength=k)
        full, first = n > 0, np.cumsum(n) - n
        centres[full] = np.add.reduceat(x[np.argsort(near, kind="stable")], first[full]) / n[full, None]
        if not full.all():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM, rows: int = 256) -> np.ndarray:
    """Codes (rows x books) by beam search."""
    m, k, d = books.shape
    norms = (books**2).sum(2)
    out = np.empty((len(x), m), dtype=np.uint8)
    for at in range(0, len(x), rows):
        part = x[at : at + rows]
        n = len(part)
        rest, codes = part[:, None, :], np.empty((n, 1, 0), dtype=np.uint8)
        for b in range(m):
            width = rest.shape[1]
            error = (rest**2).sum(2)[:, :, None] + norms[b] - 2 * (rest.reshape(-1, d) @ books[b].T).reshape(n, width, k)
            flat = error.reshape(n, -1)
            keep = min(beam if b < m - 1 else 1, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            came, entry = best // k, best % k
            rest = np.take_along_axis(rest, came[:, :, None], 1) - books[b][entry]
            codes = np.concatenate([np.take_along_axis(codes, came[:, :, None], 1), entry[:, :, None].astype(np.uint8)], axis=2)
        out[at : at + rows] = codes[:, 0]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[b][codes[:, b]] for b in range(len(books)))


def fit(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Codebooks (books x entries x dimensions) for a sample of vectors."""
    rng = np.random.Generator(np.random.PCG64(seed))
    k = min(entries, len(x))
    rest, made = x.copy(), []
    for _ in range(books):
        c = kmeans(rest, k, rng)
        rest = rest - c[np.argmin((c**2).sum(1) - 2 * (rest @ c.T), axis=1)]
        made.append(c)
    out = np.stack(made).astype(np.float32)
    for _ in range(rounds):  # least squares for all entries at once, given the codes
        codes = encode(x, out)
        codes = codes.astype(np.int64)
        gram, moment = np.zeros((books * k, books * k)), np.zeros((books * k, x.shape[1]))
        for b in range(books):
            used, first = np.unique(np.sort(codes[:, b]), return_index=True)
            moment[b * k + used] = np.add.reduceat(x[np.argsort(codes[:, b], kind="stable")].astype(float), first)
            for c in range(books):
                gram[b * k : (b + 1) * k, c * k : (c + 1) * k] = np.bincount(codes[:, b] * k + codes[:, c], minlength=k * k).reshape(k, k)
        gram[np.diag_indices_from(gram)] += 0.1
        moment += 0.1 * out.reshape(books * k, -1)  # unused entries stay as they are
        out = np.linalg.solve(gram, moment).reshape(out.shape).astype(np.float32)
    return out


def nearest_cells(x: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each vector, nearest first."""
    far = (cells**2).sum(1) - 2 * (x @ cells.T)
    near = np.argpartition(far, n - 1, axis=1)[:, :n]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)


@dataclass(frozen=True)
class Quantiser:
    """What the index was made with: codebooks and cells of shifted and scaled vectors, some rows of the sample (``known``), and the vectors' type."""

    books: np.ndarray
    cells: np.ndarray
    centre: np.ndarray
    scale: float
    known_ids: np.ndarray
    known: np.ndarray
    dtype: str

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) - self.centre) / self.scale


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of one to each of the other; a squared one is wrong by ``SLACK`` of both squared lengths at most."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * (x @ y.T) + (y**2).sum(1), 0))


def reach(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how much a distance of :func:`distances` may be wrong."""
    return np.sqrt(SLACK * ((x**2).sum(1)[:, None] + (y**2).sum(1)))


def tenth_bounds(ids: np.ndarray, x: np.ndarray, how: Quantiser, keep: int) -> np.ndarray:
    """For each scaled query, no less than its ``keep``-th distance to rows of other ids."""
    far = distances(x, how.known) + reach(x, how.known)
    far[ids[:, None] == how.known_ids] = np.inf
    return np.partition(far, keep - 1, axis=1)[:, keep - 1] if far.shape[1] >= keep else np.full(len(x), np.inf)


def matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """A list column of one length, without nulls, as a matrix."""
    return np.asarray(column.flatten(), dtype=dtype).reshape(len(column), -1)


def build(df: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, Quantiser] | None:
    """The index (vec_id, codes, error, vector, cell, away) of all valid rows, written, and its quantiser; None without valid rows."""
    rows = valid(df)
    dtype = "float32" if rows.schema["embedding"].dataType.elementType == FloatType() else "float64"
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # bounded by ``sample``
    if not chosen:
        return None
    x = np.array([r[1] for r in chosen], dtype=np.float64)
    centre = x.mean(0)
    scale = float(np.abs(x - centre).max()) or 1.0
    x = (x - centre) / scale
    ids = np.array([r[0] for r in chosen])
    _, once = np.unique(np.c_[ids.astype(np.float64), x], axis=0, return_index=True)  # a repeated row is one candidate
    once = np.sort(once)[:KNOWN]
    rng = np.random.Generator(np.random.PCG64(SEED))
    cells = kmeans(x, max(1, len(x) // CELL_ROWS), rng)
    made = Quantiser(fit(x.astype(np.float32)), cells, centre, scale, ids[once], x[once], dtype)
    shared = df.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), how.dtype)
            z = how.scaled(x)
            codes = encode(z.astype(np.float32), how.books)
            error = np.sqrt(((z - decode(codes, how.books.astype(np.float64))) ** 2).sum(1))
            cell = nearest_cells(z, how.cells, 1)[:, 0].astype(np.int32)
            away = np.sqrt(((z - how.cells[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(cell), pa.array(away)], names=["vec_id", "codes", "error", "vector", "cell", "away"])

    return materialize(rows.mapInArrow(lean(run), "vec_id long, codes binary, error double, vector binary, cell int, away double"), "ann-index"), made


def scan(ids: np.ndarray, codes: np.ndarray, error: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, how: Quantiser, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, ids and distances of the ``keep`` nearest rows of one chunk of the index to each query."""
    order = np.argsort(ids, kind="stable")
    ids, codes, error, x = ids[order], codes[order], error[order], x[order]
    _, first, which = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_index=True, return_inverse=True)
    by_vector = np.argsort(which, kind="stable")
    starts = np.searchsorted(which[by_vector], np.arange(len(first)))
    held = np.minimum(np.r_[starts[1:], len(ids)] - starts, keep + 1)  # of equal vectors no more than so many can be among the nearest
    codes, error, exact = codes[first], error[first], x[first].astype(np.float64)
    books = how.books.astype(np.float64)
    norm = (decode(codes, books) ** 2).sum(1)
    n, d = exact.shape
    few = min(n, RERANK)
    several = min(64, max(1, (1 << 21) // max(few * d, n)))  # queries at a time
    piece = max(1, (1 << 21) // d)
    out = []
    for at in range(0, len(queries), several):
        part = queries[at : at + several].astype(np.float64)
        z = how.scaled(part)
        table = np.einsum("qd,mkd->mqk", z, books)
        whole = (z**2).sum(1)[:, None] + norm
        near = whole.copy()
        for m in range(len(books)):
            near -= 2 * table[m][:, codes[:, m]]
        tops = np.argpartition(near, few - 1, axis=1)[:, :few]
        score = np.sqrt(((exact[tops] - part[:, None, :]) ** 2).sum(2))
        # one of these may be the query itself, so it is the next that bounds
        bound = np.partition(score, keep, axis=1)[:, keep] / how.scale * (1 + SLACK) if few > keep else np.full(len(part), np.inf)
        q, v = np.nonzero(~(np.sqrt(np.maximum(near, 0)) - error - np.sqrt(SLACK * whole) > bound[:, None]))
        far = np.concatenate([np.sqrt(((exact[v[i : i + piece]] - part[q[i : i + piece]]) ** 2).sum(1)) for i in range(0, len(q), piece)])
        copies = held[v]
        q, far = np.repeat(q, copies), np.repeat(far, copies)
        rows = by_vector[np.repeat(starts[v] - np.cumsum(copies) + copies, copies) + np.arange(len(q))]
        found = ids[rows]
        other = found != query_ids[at + q]
        q, far, found = q[other], far[other], found[other]
        order = np.lexsort((found, far, q))
        q, far, found = q[order], far[order], found[order]
        fresh = np.ones(len(q), dtype=bool)  # a repeated row counts once
        fresh[1:] = (q[1:] != q[:-1]) | (far[1:] != far[:-1]) | (found[1:] != found[:-1])
        q, far, found = q[fresh], far[fresh], found[fresh]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        out.append((at + q[place < keep], found[place < keep], far[place < keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search(index: DataFrame, how: Quantiser, every: int = 100, nearest: int = NEAREST, probes: int | None = None, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows to each whose id is divisible by ``every``.

    ``probes`` is how many cells each query looks into, by default all that can hold one of its nearest.
    """
    radii = np.full(len(how.cells), -np.inf)
    for r in index.groupBy("cell").agg(F.max("away").alias("radius")).collect():  # a row for each cell, of which the sample's size says how many
        radii[r.cell] = r.radius
    shared = index.sparkSession.sparkContext.broadcast((how, radii))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, radii = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                x = how.scaled(np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=how.dtype).reshape(part.num_rows, -1))
                if probes is None:
                    least = distances(x, how.cells) - reach(x, how.cells) - radii * (1 + SLACK)
                    at, cells = np.nonzero(~(least > tenth_bounds(np.asarray(part.column(0)), x, how, nearest)[:, None]))
                else:
                    cells = nearest_cells(x, how.cells, min(probes, len(how.cells)))
                    at, cells = np.repeat(np.arange(part.num_rows), cells.shape[1]), cells.ravel()
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(cells.astype(np.int32))], names=["query_id", "query", "cell"])

    asked = index.where(F.col("vec_id") % every == 0).select("vec_id", "vector").distinct().mapInArrow(lean(ask), "query_id long, query binary, cell int")
    # rows, chunks and blocks of each cell; there are as many cells as the sample asks for
    chunks = index.groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = F.broadcast(materialize(chunks.join(blocks, "cell"), "ann-cells"))
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("vec_id", "vector"), F.col("chunks")).cast("int").alias("chunk"), every_one("blocks").alias("block"), "vec_id", "codes", "error", "vector")
    queries = asked.join(sizes, "cell").select("cell", every_one("chunks").alias("chunk"), F.pmod(F.xxhash64("query_id", "query"), F.col("blocks")).cast("int").alias("block"), "query_id", "query")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        how, _ = shared.value
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        numbers = lambda t, c, dtype: np.frombuffer(b"".join(t[c].to_pylist()), dtype=dtype).reshape(t.num_rows, -1)
        query_ids = right["query_id"].to_numpy()
        at, found, far = scan(left["vec_id"].to_numpy(), numbers(left, "codes", np.uint8), left["error"].to_numpy(), numbers(left, "vector", how.dtype), query_ids, numbers(right, "query", how.dtype), how, nearest)
        return pa.table([pa.array(query_ids[at]), pa.array(found), pa.array(far)], names=names)

    keys = ["cell", "chunk", "block"]
    found = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def digest(df: DataFrame) -> DataFrame:
    made = build(df)
    if made is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(*made)
