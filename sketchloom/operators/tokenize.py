"""From sequences to sketch entries: k-mers, canonical contexts, sampling.

A k-mer is packed two bits a base (A 0, C 1, G 2, T 3, case ignored; any other letter breaks the window). A layout
names which bases are context and which object. Of a k-mer and its reverse complement the one
with the smaller masked context is taken, the reverse one on ties. A context is kept if the low half of its hash
is at most 2**32 / 2**fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sketchloom.functions.bits import mix64
from sketchloom.functions.distances import Layout

_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _i


@dataclass(frozen=True)
class KmerLayout:
    """``pattern`` has a C for each context base and an O for each object base, first base first."""

    pattern: str
    fold: int = 8

    def __post_init__(self):
        if not 1 <= len(self.pattern) <= 32 or set(self.pattern) - set("CO"):
            raise ValueError("a layout has 1 to 32 bases, each C or O")
        if not 0 <= self.fold <= 24:
            raise ValueError("a fold of more than 24 keeps next to nothing")

    @classmethod
    def coden(cls, codens: int = 11, fold: int = 8) -> KmerLayout:
        """Two context bases and an object base, repeated, without the last object base."""
        return cls("CCO" * (codens - 1) + "CC", fold)

    @classmethod
    def manual(cls, hclen: int, holen: int, iolen: int, fold: int = 8) -> KmerLayout:
        """Outer objects, contexts, inner object, contexts, outer objects."""
        return cls("O" * holen + "C" * hclen + "O" * iolen + "C" * hclen + "O" * holen, fold)

    @property
    def k(self) -> int:
        return len(self.pattern)

    @property
    def ctx_bits(self) -> int:
        return 2 * self.pattern.count("C")

    @property
    def obj_bits(self) -> int:
        return 2 * self.pattern.count("O")

    @property
    def mask(self) -> int:
        """Context bits of a packed k-mer."""
        return sum(3 << 2 * (self.k - 1 - i) for i, c in enumerate(self.pattern) if c == "C")

    @property
    def threshold(self) -> int:
        return 0xFFFFFFFF >> self.fold

    def distances(self) -> Layout:
        return Layout(self.ctx_bits, self.obj_bits, 11 if self.k == 32 else 9, self.fold)


def gather(kmers: np.ndarray, pattern: str, kind: str) -> np.ndarray:
    """The bases of one kind, packed together, first base highest."""
    out = np.zeros(len(kmers), dtype=np.uint64)
    for i, c in enumerate(pattern):
        if c == kind:
            out = (out << np.uint64(2)) | ((kmers >> np.uint64(2 * (len(pattern) - 1 - i))) & np.uint64(3))
    return out


def spread(ctx: np.ndarray, obj: np.ndarray, pattern: str) -> np.ndarray:
    """The k-mers of contexts and objects: :func:`gather` backwards."""
    out = np.zeros(len(ctx), dtype=np.uint64)
    left = {"C": pattern.count("C"), "O": pattern.count("O")}
    for c in pattern:
        left[c] -= 1
        source = ctx if c == "C" else obj
        out = (out << np.uint64(2)) | ((source >> np.uint64(2 * left[c])) & np.uint64(3))
    return out


def reverse_complement(kmers: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(kmers), dtype=np.uint64)
    for i in range(k):
        out = (out << np.uint64(2)) | (np.uint64(3) - ((kmers >> np.uint64(2 * i)) & np.uint64(3)))
    return out


def letters(kmers: np.ndarray, k: int) -> list[str]:
    """K-mers as text."""
    bases = np.stack([(kmers >> np.uint64(2 * (k - 1 - i))) & np.uint64(3) for i in range(k)], axis=1).astype(np.uint8)
    return [b.tobytes().decode() for b in np.frombuffer(b"ACGT", dtype=np.uint8)[bases]]


def tokens(seq: bytes, layout: KmerLayout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, objects and start positions of the sampled k-mers of one sequence."""
    code = _CODE[np.frombuffer(seq, dtype=np.uint8)]
    k, n = layout.k, len(code) - layout.k + 1
    none = np.empty(0, dtype=np.uint64)
    if n <= 0:
        return none, none, np.empty(0, dtype=np.int64)
    bad = np.cumsum(np.r_[0, code == 4])
    start = np.flatnonzero(bad[k:] == bad[:-k])
    forward = np.zeros(n, dtype=np.uint64)
    backward = np.zeros(n, dtype=np.uint64)
    wide = (code & 3).astype(np.uint64)
    for j in range(k):
        base = wide[j : j + n]
        forward = (forward << np.uint64(2)) | base
        backward |= (np.uint64(3) - base) << np.uint64(2 * j)
    forward, backward = forward[start], backward[start]
    mask = np.uint64(layout.mask)
    own = (forward & mask) < (backward & mask)
    chosen = np.where(own, forward, backward)
    keep = (mix64(chosen & mask) & np.uint64(0xFFFFFFFF)) <= np.uint64(layout.threshold)
    chosen, start = chosen[keep], start[keep]
    return gather(chosen, layout.pattern, "C"), gather(chosen, layout.pattern, "O"), start


_RAW = pa.schema([("sample_id", pa.int64()), ("ctx", pa.int64()), ("obj", pa.int64()), ("pos", pa.int64())])
#: Letters of a sequence that are worked on at once.
CHUNK = 4_000_000


def tokenized(records: DataFrame, layout: KmerLayout = KmerLayout.coden()) -> DataFrame:
    """Raw entries (sample_id, ctx, obj, pos) of records (sample_id, seq, offset); one row for each occurrence.

    Sampling happens before anything leaves the task. Contexts and objects of up to 62 bits fit a long; wider ones keep their bits, as signed numbers.
    """
    k = layout.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sample, seq, offset in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (seq or "").encode() if isinstance(seq, str) else bytes(seq or b"")
                for at in range(0, max(1, len(raw) - k + 1), CHUNK):
                    ctx, obj, pos = tokens(raw[at : at + CHUNK + k - 1], layout)
                    if len(ctx):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ctx), sample)), pa.array(ctx.view(np.int64)), pa.array(obj.view(np.int64)), pa.array(pos + (offset or 0) + at)], schema=_RAW)

    offset = "offset" if "offset" in records.columns else "0L AS offset"
    return records.selectExpr("CAST(sample_id AS BIGINT) AS sample_id", "seq", offset).mapInArrow(run, "sample_id long, ctx long, obj long, pos long")


def recovered(entries: DataFrame, layout: KmerLayout = KmerLayout.coden()) -> DataFrame:
    """sample_id, kmer and reverse complement of each entry, as text."""
    schema = pa.schema([("sample_id", pa.int64()), ("kmer", pa.string()), ("reverse_complement", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ctx, obj = (np.asarray(batch.column(i)).astype(np.int64).view(np.uint64) for i in (1, 2))
            kmers = spread(ctx, obj, layout.pattern)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(letters(kmers, layout.k)), pa.array(letters(reverse_complement(kmers, layout.k), layout.k))], schema=schema)

    return entries.select("sample_id", "ctx", "obj").mapInArrow(run, "sample_id long, kmer string, reverse_complement string")


def shuffled_subcontexts(half_bases: int, level: int, seed: int) -> np.ndarray:
    """A seeded permutation of all sub-contexts of ``2 * half_bases`` bases, of which the first 16**-level share is kept by older sketches."""
    return np.random.Generator(np.random.PCG64([seed, level])).permutation(1 << (4 * half_bases))


def layout_id(layout: KmerLayout) -> int:
    """A 32-bit fingerprint of a layout and its sampling, to refuse unlike sketches."""
    seed = np.array([int.from_bytes(layout.pattern.encode().ljust(32, b".")[i : i + 8], "big") for i in range(0, 32, 8)] + [layout.threshold], dtype=np.uint64)
    return int(np.bitwise_xor.reduce(mix64(seed + np.arange(len(seed), dtype=np.uint64))) & np.uint64(0xFFFFFFFF))
