"""Token ids packed into fixed-length rows by best-fit decreasing.

Each task reads its documents as a stream, encodes them and packs ``shard_tokens`` at a
time: documents longer than a row are split into full rows and a rest, all pieces are
sorted by length, and each goes to the fullest row that still has room, found in a
segment tree over the room that rows have left. No document is shuffled, memory is bound
by ``shard_tokens``, and a lost task is done again from its input alone. ``shard`` is the number of the
input's partition, so which documents share a row depends on how the input is laid out.

A packed row holds ``ids`` (unsigned little-endian, ``width`` bytes each, the row of the id
matrix), ``n_tokens``, ``cu_seqlens`` (cumulative segment lengths, from 0), ``position_resets`` (where
position ids start again at 0), and for each segment ``doc_ids`` and ``doc_starts``, the segment's first
token in its document; :func:`unpack` gives every document's ids back.

Defined results: every document ends with the end token, so an empty or null text is one
token long and no document is lost; null ids stay null; repeated rows are packed each for
itself; very long texts are split without loss; an empty table gives no rows; other columns
are not used.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sketchloom.session import bounded_batches, driver_file, lean

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer that belongs to the vocabulary. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROW, SHARD_TOKENS, CACHE = 2048, 2_000_000, 150_000

PACKED = "shard int, row long, width int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>"
_ARROW = pa.schema([("shard", pa.int32()), ("row", pa.int64()), ("width", pa.int32()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64()))])


class Encoder:
    """A byte-pair vocabulary with a cache of space-led units.

    The pre-tokenizer always breaks before a space that stands before a non-space, so units
    between such spaces can be encoded alone. A text with other runs is encoded whole.
    """

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bpe = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.end = len(table)
        self.code = "H" if self.end < 65536 else "I"
        self.width = array(self.code).itemsize
        self.last = array(self.code, [self.end]).tobytes()
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.bpe.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """The text's ids and the end token, as bytes."""
        first, *units = text.split(" ")
        got = list(map(self.known.get, units))
        if None in got:
            if len(self.known) > CACHE:
                self.known.clear()
            for i, ids in enumerate(got):
                if ids is None:
                    unit = units[i]
                    if not unit or unit[0].isspace():
                        return self._whole(text) + self.last
                    got[i] = self.known[unit] = self._whole(" " + unit)
        return self._whole(first) + b"".join(got) + self.last


_kept: tuple[bytes, str, Encoder] | None = None


def encoder(ranks: bytes, pattern: str) -> Encoder:
    """Built once in each Python worker; its cache starts empty in each task."""
    global _kept
    if _kept is None or _kept[:2] != (ranks, pattern):
        _kept = ranks, pattern, Encoder(ranks, pattern)
    _kept[2].known.clear()
    return _kept[2]


class Room:
    """A segment tree over room 0..size: how many rows have just that much left."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least room of at least ``least``, and that room."""
        tree, at = self.tree, least + self.leaves
        while not tree[at]:
            while at & 1:  # a right child: its parent's right neighbour comes next
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            tree[at] -= 1
            at >>= 1
        return self.rows[room].pop(), room


def best_fit(lengths: Iterable[int], size: int) -> list[list[int]]:
    """Rows of piece numbers; pieces in falling length, ties by number, into the fullest row with room."""
    room, rows = Room(size), []
    order = sorted(enumerate(lengths), key=lambda x: (-x[1], x[0]))
    for piece, n in order:
        if n > size:
            raise ValueError("a piece is longer than a row")
        found = room.take(n)
        if found is None:
            rows.append([piece])
            found = len(rows) - 1, size
        else:
            rows[found[0]].append(piece)
        room.put(found[1] - n, found[0])
    return rows


def pack_shard(docs: list[tuple[int | None, bytes]], size: int, width: int) -> Iterator[dict]:
    """Packed rows of some documents' encoded ids."""
    pieces = [(doc, at // width, ids[at : at + size * width]) for doc, ids in docs for at in range(0, len(ids), size * width)]
    for row in best_fit([len(ids) // width for _, _, ids in pieces], size):
        own = [pieces[i] for i in row]
        ends = np.cumsum([0, *(len(ids) // width for _, _, ids in own)]).tolist()
        yield {"n_tokens": ends[-1], "ids": b"".join(ids for _, _, ids in own), "cu_seqlens": ends, "position_resets": ends[:-1], "doc_ids": [d for d, _, _ in own], "doc_starts": [s for _, s, _ in own]}


def pack(docs: DataFrame, size: int = ROW, vocabulary: str = VOCABULARY, pattern: str = PATTERN, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Packed rows of all documents (columns doc_id and text)."""
    bounded_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(driver_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        shard = TaskContext.get().partitionId()
        held, tokens, row = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal row
            out = []
            for x in pack_shard(held, size, enc.width):
                out.append(x | {"shard": shard, "row": row, "width": enc.width})
                row += 1
                if len(out) == 1024:
                    yield pa.RecordBatch.from_pylist(out, _ARROW)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _ARROW)
            held.clear()

        for batch in batches:
            texts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids = enc.encode(texts[i].as_py() or "")
                held.append((doc, ids))
                tokens += len(ids) // enc.width
                if tokens >= shard_tokens:
                    yield from flush()
                    tokens = 0
        yield from flush()
        enc.known.clear()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(lean(run), PACKED)


def write(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet: the id matrix in ``ids``, with lengths and resets beside it."""
    packed.write.mode("errorifexists").parquet(path)


def id_matrix(rows: list, size: int, pad: int = 0) -> np.ndarray:
    """A matrix of collected packed rows, short rows filled with ``pad``."""
    out = np.full((len(rows), size), pad, dtype=np.int64)
    for i, r in enumerate(rows):
        ids = np.frombuffer(r["ids"], dtype=f"<u{r['width']}")
        out[i, : len(ids)] = ids
    return out


def position_ids(row) -> np.ndarray:
    """Positions that start again at 0 where ``position_resets`` says."""
    starts = np.asarray(row["position_resets"], dtype=np.int64)
    lengths = np.diff(np.asarray(row["cu_seqlens"], dtype=np.int64))
    return np.arange(row["n_tokens"]) - np.repeat(starts, lengths)


def unpack(rows: Iterable) -> dict[int | None, list[int]]:
    """Every document's ids, end token included, from collected packed rows (ids unique)."""
    parts: dict[int | None, list[tuple[int, list[int]]]] = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype=f"<u{r['width']}").tolist()
        for doc, start, a, b in zip(r["doc_ids"], r["doc_starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            parts.setdefault(doc, []).append((start, ids[a:b]))
    return {doc: [x for _, ids in sorted(own) for x in ids] for doc, own in parts.items()}
