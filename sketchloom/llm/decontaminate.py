"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased with runs of white space as one space. An item of n
characters may differ from a passage by k = floor(n * rate) edits. Cut into k + 1 pieces, one
piece of it must stand in the passage unchanged. Documents are scanned for the first
characters of all pieces at once (a rolling hash in a bit table, then a sorted list); a hit
whose whole piece is there gives a window of the document, in which Myers' bit-parallel
algorithm finds the least edit distance of the item to any passage.

A passage also matches if it is the item with one word dropped or replaced by any other, however
many edits that is: a word of at most a fifth of the item, in items that may differ at all. Such an item has three pieces at least, and the word touches not all of
them, so here too a piece stands unchanged; the words before and after it are compared from there.

Hits of one item that lie closer than a window are verified together, so a text
that repeats one piece costs its own length, not a window for each hit. The pieces are
made on the driver from the benchmark and sent to all tasks: their size is the
benchmark's, which doesn't grow with the documents, and is checked against ``MAX_CHARS``; a larger
benchmark is gone through in parts, one pass each, of which the driver and a worker hold one at a time: what
:func:`clean` keeps is written before the next part is looked for. Pieces of fewer than eight bytes, which only short items have, are found by an automaton.

Defined results: null or empty documents and items match nothing; an item too short for a single edit must
occur unchanged; whole texts are scanned, however long; each row of documents is judged for itself, so repeated rows
repeat; repeated items count once, and of an item with several texts the best passage of any of them is given; items without an id are one item; of equal
distances the earliest end is given; null ids stay null; empty tables give
empty results; other columns, of any name, are carried only by :func:`clean`.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.session import bounded_batches, discard, lean, materialize, plainly_named

RATE, MAX_CHARS = 0.05, 20_000_000
#: A word of at most this part of an item may be dropped or replaced.
WORD_PART = 5
#: Bytes that are scanned at once; a longer text is scanned whole.
SEGMENT = 1 << 20
#: Bits of the table that a position's hash is looked up in first.
TABLE = 22
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(text: str, rate: float = RATE) -> list[tuple[int, str]]:
    """Where each of the error budget plus one pieces starts, and the piece; three at least if there is a budget."""
    parts = int(len(text) * rate) + 1
    parts = max(parts, 3) if parts > 1 else parts
    cuts = [len(text) * i // parts for i in range(parts + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any passage of ``text``, and the end of the first such passage."""
    m = len(pattern)
    ones, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    vp, vn, score = ones, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | (ones & ~(d0 | vp))
        hn = d0 & vp
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp = (hp << 1) & ones  # a passage may start anywhere, so nothing is carried in
        hn = (hn << 1) & ones
        vp = hn | (ones & ~(d0 | hp))
        vn = d0 & hp
        if score < best:
            best, end = score, j + 1
    return best, end


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each word of a normal text."""
    out, at = [], 0
    for word in text.split(" "):
        out.append((at, at + len(word)))
        at += len(word) + 1
    return out


def one_word(pattern: str, words: list[tuple[int, int]], text: str, start: int) -> bool:
    """Whether a passage is ``pattern`` but for one of its words, of at most a fifth of it.

    ``start`` is where the passage starts or, but for that word's length, ends. Where more than two words fit
    from one side, the word is the last of them or the one before, so only these are looked at.
    """
    n = len(pattern)
    fits = (lambda k: k == 0 or text.startswith(pattern[: words[k][0] - 1], start)) if start >= 0 else (lambda k: k == 0)
    last = bisect_left(range(len(words)), True, key=lambda k: not fits(k)) - 1
    for a, b in words[max(1, last - 1) : last + 1]:
        # what stands before the word is in place, and after any word or none comes the rest
        if (b - a) * WORD_PART > n:
            continue
        if b == n:
            return True
        at = start + a
        if text.startswith(" ", at - 1):
            stop = text.find(" ", at)
            if text.startswith(pattern[b + 1 :], at) or stop >= 0 and text.startswith(pattern[b:], stop):
                return True
    follows = lambda k: words[k][1] == n or start + words[k][1] + 1 >= 0 and text.startswith(pattern[words[k][1] + 1 :], start + words[k][1] + 1)
    first = bisect_left(range(len(words)), True, key=follows)
    for a, b in words[first : min(first + 2, len(words) - 1)]:
        # the rest is in place, and before any word or none stands what is before the word
        if (b - a) * WORD_PART > n:
            continue
        if a == 0:
            return True
        at = start + b
        if at >= 0 and text.startswith(" ", at):
            if text.endswith(pattern[: a - 1], 0, at) or text.endswith(pattern[:a], 0, text.rfind(" ", 0, at) + 1):
                return True
    return False


def least(found: list[tuple[int | None, int, int]]) -> list[tuple[int | None, int, int]]:
    """The best passage of each item: the least distance, and the first end of equal ones."""
    best: dict[int | None, tuple[int, int]] = {}
    for item, *passage in found:
        best[item] = min(best.get(item, tuple(passage)), tuple(passage))
    return [(item, *passage) for item, passage in best.items()]


class Scanner:
    """All pieces of some items, ready to be found in a text."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        self.items = [(item, normal(text)) for item, text in items]
        self.items = [(item, text) for item, text in self.items if text]
        self.budget = [int(len(text) * rate) for _, text in self.items]
        self.words = [word_spans(text) if k else [] for (_, text), k in zip(self.items, self.budget, strict=True)]
        probes: dict[bytes, list[tuple[int, int, str]]] = defaultdict(list)
        self.short: list[tuple[int, int, str]] = []
        for k, (_, text) in enumerate(self.items):
            for at, piece in pieces(text, rate):
                raw = piece.encode()
                if len(raw) >= 8:
                    probes[raw[:16] if len(raw) >= 16 else raw[:8]].append((k, at, piece))
                else:
                    self.short.append((k, at, piece))
        self.automaton = None
        if self.short:
            import ahocorasick

            self.automaton, named = ahocorasick.Automaton(), defaultdict(list)
            for own in self.short:
                named[own[2]].append(own)
            for piece, own in named.items():
                self.automaton.add_word(piece, own)
            self.automaton.make_automaton()
        self.by_width = []
        for width in (8, 16):
            own = {p: v for p, v in probes.items() if len(p) == width}
            if own:
                hashes = self._hash(np.frombuffer(b"".join(own), dtype=np.uint8), width)[::width]
                table = np.zeros(1 << TABLE, dtype=bool)
                table[hashes >> np.uint64(64 - TABLE)] = True
                by_hash: dict[int, list] = defaultdict(list)
                for h, found in zip(hashes.tolist(), own.values(), strict=True):
                    by_hash[h] += found
                self.by_width.append((width, table, dict(by_hash)))

    @staticmethod
    def _hash(data: np.ndarray, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each place on."""
        words = np.lib.stride_tricks.as_strided(data[: len(data) - 7].view(), shape=(len(data) - 7, 8), strides=(1, 1)) if len(data) >= 8 else np.empty((0, 8), np.uint8)
        eight = np.ascontiguousarray(words).view("<u8").ravel()
        with np.errstate(over="ignore"):
            h = eight[: len(data) - width + 1] * _C1
            if width == 16:
                h = (h ^ (h >> np.uint64(29))) + eight[8:] * _C2
            return (h ^ (h >> np.uint64(32))) * _C1

    def probe(self, data: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, str]]]]:
        """Places of ``data`` at which pieces may start."""
        for width, table, by_hash in self.by_width:
            if len(data) < width:
                continue
            h = self._hash(data, width)
            for at in np.flatnonzero(table[h >> np.uint64(64 - TABLE)]).tolist():
                found = by_hash.get(int(h[at]))
                if found:
                    yield at, found

    def verify(self, text: str, hits: dict[int, list[int]]) -> list[tuple[int | None, int, int]]:
        """Item, distance and end for items with a passage within the budget or with one word of another; ``hits``: item number to alignments."""
        out = []
        for k, starts in sorted(hits.items()):
            item, pattern = self.items[k]
            budget, best = self.budget[k], None
            starts.sort()
            i = 0
            while i < len(starts):
                first = i
                a = max(0, starts[i] - budget)
                b = starts[i] + len(pattern) + budget
                while i + 1 < len(starts) and starts[i + 1] - budget <= b:
                    i += 1
                    b = starts[i] + len(pattern) + budget
                i += 1
                distance, end = myers(pattern, text[a:b])
                near = distance <= budget
                if not near and self.words[k] and any(one_word(pattern, self.words[k], text, s) for s in starts[first:i]):
                    a, near = max(0, a - len(pattern)), True  # the other word may be long
                    distance, end = myers(pattern, text[a : b + len(pattern)])
                if near and (best is None or distance < best[0]):
                    best = distance, a + end
            if best:
                out.append((item, *best))
        return least(out)

    def find(self, text: str, data: np.ndarray, found: list[tuple[int, list]]) -> list[tuple[int | None, int, int]]:
        """Matches in a normalised text; ``data`` its bytes, ``found`` what :meth:`probe` gave."""
        place = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte's character
        hits: dict[int, set[int]] = defaultdict(set)
        for at, own in found:
            c = int(place[at])
            for k, offset, piece in own:
                if text.startswith(piece, c):
                    hits[k].add(c - offset)
        for last, own in self.automaton.iter(text) if self.automaton else ():
            for k, offset, piece in own:
                hits[k].add(last + 1 - len(piece) - offset)
        return self.verify(text, {k: list(v) for k, v in hits.items()})

    def matches(self, texts: list[str | None]) -> list[list[tuple[int | None, int, int]]]:
        """For each text, the items found: id, distance and where the passage ends."""
        out: list[list] = [[] for _ in texts]
        clean = [normal(t) for t in texts]
        raw = [t.encode() for t in clean]
        at = 0
        while at < len(raw):  # a segment at a time; a line feed, which no normal text holds, stands between texts
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) < SEGMENT):
                size += len(raw[end]) + 1
                end += 1
            data = np.frombuffer(b"\n".join(raw[at:end]), dtype=np.uint8)
            starts = np.cumsum([0, *(len(r) + 1 for r in raw[at:end])])
            by_text: dict[int, list] = defaultdict(list)
            for place, own in self.probe(data):
                k = int(np.searchsorted(starts, place, side="right")) - 1
                by_text[k].append((place - int(starts[k]), own))
            for k in range(end - at) if self.short else sorted(by_text):
                out[at + k] = self.find(clean[at + k], data[starts[k] : starts[k] + len(raw[at + k])], by_text.get(k, []))
            at = end
        return out


_last: tuple[list, float, Scanner] | None = None


def _scanner(shared, rate: float) -> Scanner:
    """Built once in each Python worker for each part of the benchmark; only the last part's is kept."""
    global _last
    items = shared.value
    if _last is None or _last[0] is not items or _last[1] != rate:
        _last = None
        _last = items, rate, Scanner(items, rate)
    return _last[2]


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items in parts of about ``MAX_CHARS`` characters, one held at a time; at least one part.

    All texts of an item are in one part.
    """
    part, size, any_part, last = [], 0, False, None
    rows = benchmark.where(F.length(F.trim("text")) > 0).select("item_id", "text").distinct()
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if size + len(r["text"]) > MAX_CHARS and part and r["item_id"] != last:
            yield part
            part, size, any_part = [], 0, True
        part.append((r["item_id"], r["text"]))
        size, last = size + len(r["text"]), r["item_id"]
    if part or not any_part:
        yield part


_LEAK = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("passage_end", pa.int64())])


def _groups(texts: pa.Array, size: int = SEGMENT) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a batch by a few megabytes, and where each group starts."""
    held, start, total = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text.as_py())
        total += len(held[-1] or "")
        if total >= size:
            yield start, held
            held, start, total = [], i + 1, 0
    yield start, held


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance and passage_end (in the normalised text) of the best passage of each item in each document."""
    bounded_batches(docs.sparkSession)
    rows, found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for part in _parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scan = _scanner(shared, rate)
            for batch in batches:
                out: list[list] = [[], [], [], []]
                for start, texts in _groups(batch.column(1)):
                    for i, own in enumerate(scan.matches(texts)):
                        for item, distance, end in own:
                            for column, value in zip(out, (batch.column(0)[start + i].as_py(), item, distance, end), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _LEAK, strict=True)], schema=_LEAK)

        one = rows.mapInArrow(lean(run), "doc_id long, item_id long, distance int, passage_end long")
        found = one if found is None else found.unionByName(one)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` that hold nothing of the benchmark, with all their columns."""
    bounded_batches(docs.sparkSession)
    return plainly_named(docs, lambda named: _cleaned(named, benchmark, rate))


def _cleaned(docs: DataFrame, benchmark: DataFrame, rate: float) -> DataFrame:
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    out, before, written = docs, None, None
    for part in _parts(benchmark):
        if before is not None:  # what the parts so far have left is written, so one part is held at a time
            out, read = materialize(out, "clean"), written
            before.destroy()
            if read is not None:
                discard(read)
            written = out
        before = shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scan = _scanner(shared, rate)
            for batch in batches:
                keep = [not own for _, texts in _groups(batch.column(at)) for own in scan.matches(texts)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(lean(run), docs.schema)
    return out
