"""FASTA and FASTQ sources: file lists, records, samples.

Files are read by Spark as lines, so any store works, gzip is a stream, and what can be split is read in splits by many tasks. A task finds
the first record that starts in its split: in FASTA by its mark, in FASTQ by a mark whose next line but one is a plus line, which
no quality line is followed by. What stands before it, and the last record, which may go on in the next split, are *ends*, a row for each split. Ends are
put together in the order of splits and parsed like a file. So the text is read twice, once for ends and counts and once for records,
and only ends are shuffled; a record's number and place in its file are those in its split after the sums of the splits before.

A file whose splits don't look like this (sequences or qualities on several lines, blank lines, another format than its suffix says) is
parsed from its first line to its last by one task, which gets the lines sorted and holds a record at a time.

With ``least_quality`` bases of a lower quality (Phred, 33 stands for 0) become N, so that no k-mer with such a base is a token.
"""

from __future__ import annotations

import bz2
import gzip
import re
import subprocess
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, groupby
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sketchloom.session import bounded_batches, lean, materialize, numbered, small

FASTA = ("fasta", "fna", "fas", "fa")
FASTQ = ("fq", "fastq")
SKETCHES = ("co", "mco")
_SUFFIX = re.compile(rf"\.({'|'.join(FASTA + FASTQ + SKETCHES)})(\.gz|\.bz2)?$", re.I)


def kind_of(path: str) -> str | None:
    """fasta, fastq or sketch by a path's suffix; None if it isn't accepted."""
    m = _SUFFIX.search(path)
    return None if not m else "fasta" if m[1].lower() in FASTA else "fastq" if m[1].lower() in FASTQ else "sketch"


def checked(paths: Sequence[str]) -> list[str]:
    wrong = [p for p in paths if kind_of(p) is None]
    if wrong:
        raise ValueError(f"not an accepted sequence file: {wrong[0]}")
    return list(paths)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Paths from a list file, one a line; empty lines are skipped."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("path"))
    return [r["path"] for r in rows.collect()]  # a list of files, as on a command line


def as_samples(spark: SparkSession, paths: Sequence[str], as_one: bool = False, name: str | None = None) -> DataFrame:
    """sample_id, name, path and the path's place in its sample: a sample for each path, or all paths as one."""
    rows = [(0 if as_one else i, (name or paths[0]) if as_one else p, p, i if as_one else 0) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "sample_id long, name string, path string, file_no long")


def parse(raw: bytes) -> Iterator[tuple[str, str, bytes]]:
    """Name, comment and sequence of each record of a text."""
    for name, comment, seq, _ in parsed(raw.splitlines()):
        yield name, comment, seq


def titled(head: bytes) -> tuple[str, str]:
    name, _, comment = head[1:].decode("utf-8", "replace").partition(" ")
    return name, comment


def parsed(lines: Iterable[bytes]) -> Iterator[tuple[str, str, bytes, bytes]]:
    """Name, comment, sequence and qualities (empty in FASTA) of each record; lines may be wrapped."""
    lines = iter(lines)
    head = next((x for x in lines if x[:1] in (b">", b"@")), None)
    while head is not None:
        seq, following = [], None
        for line in lines:
            if line[:1] in (b">", b"@", b"+"):
                following = line
                break
            seq.append(line.strip())
        whole, quality = b"".join(seq), []
        if following is not None and following[:1] == b"+":
            left = len(whole)
            while left > 0:
                line = next(lines, None)
                if line is None:
                    break
                quality.append(line.strip())
                left -= len(quality[-1])
            following = next((x for x in lines if x[:1] in (b">", b"@")), None)
        yield *titled(head), whole, b"".join(quality)
        head = following


def masked(seq: bytes, quality: bytes, least: int) -> bytes:
    """A sequence with N for each base whose quality is below ``least``; bases without a quality stay."""
    if least <= 0 or not quality:
        return seq
    bases = np.frombuffer(seq, dtype=np.uint8).copy()
    n = min(len(seq), len(quality))
    bases[:n][np.frombuffer(quality, dtype=np.uint8)[:n] < 33 + least] = ord("N")
    return bases.tobytes()


_RECORD = pa.schema([("path", pa.string()), ("rec_no", pa.int64()), ("name", pa.string()), ("comment", pa.string()), ("seq", pa.binary()), ("length", pa.int64()), ("offset", pa.int64()), ("fmt", pa.string())])
RECORD = "path string, rec_no long, name string, comment string, seq binary, length long, offset long, fmt string"
#: Letters of the records of an Arrow batch.
BATCH = 8_000_000


def _batched(rows: Iterable[dict], schema: pa.Schema, letters: str = "seq") -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[letters] or b"") + 100
        if size > BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _whole(path: str, lines: Iterable[bytes], least: int = 0) -> Iterator[dict]:
    """The records of a file's lines, one after another."""
    lines = iter(lines)
    held = []
    for line in lines:
        held.append(line)
        if line.strip():
            break
    fmt = "fastq" if held and held[-1].lstrip()[:1] == b"@" else "fasta"
    offset = 0
    for n, (name, comment, seq, quality) in enumerate(parsed(chain(held, lines))):
        yield {"path": path, "rec_no": n, "name": name, "comment": comment, "seq": masked(seq, quality, least), "length": len(seq), "offset": offset, "fmt": fmt}
        offset += len(seq)


def _plain(raw: bytes) -> bytes:
    if raw[:2] == b"\x1f\x8b":
        return gzip.decompress(raw)
    return bz2.decompress(raw) if raw[:3] == b"BZh" else raw


def whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: the records of files that come as path and content, as a stream's files do."""
    yield from _batched((row for batch in batches for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for row in _whole(path, _plain(raw.as_py()).splitlines())), _RECORD)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[list[bytes]]]]:
    """Address and start of each split that a task reads, and its lines by lists; columns are line, address and block."""

    def pieces() -> Iterator[tuple[tuple[str, int], list[bytes]]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            files, block = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
            file = files.indices.to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                yield (files.dictionary[int(file[x])].as_py(), int(block[x])), batch.column(0).slice(x, y - x).to_pylist()

    for key, own in groupby(pieces(), key=lambda p: p[0]):
        yield key, (lines for _, lines in own)


class Split:
    """The records that start and end in one split, and its ends: ``head`` before the first of them, ``tail`` from the start of the last; ``odd`` if it isn't as it should be."""

    def __init__(self, path: str, block: int):
        self.kind, self.block = kind_of(path), block
        self.head: list[bytes] = []
        self.tail: list[bytes] | None = None  # None until a record starts
        self.odd = self.kind not in ("fasta", "fastq")
        self.records = self.letters = 0

    def read(self, pieces: Iterable[list[bytes]], least: int = 0) -> Iterator[tuple[int, int, bytes, bytes]]:
        """Number and offset in the split, head line and sequence of each whole record."""
        for head, seq in (self._fasta(pieces) if self.kind == "fasta" else self._fastq(pieces, least)) if not self.odd else ():
            yield self.records, self.letters, head, seq
            self.records += 1
            self.letters += len(seq)

    def _fasta(self, pieces: Iterable[list[bytes]]) -> Iterator[tuple[bytes, bytes]]:
        for lines in pieces:
            for line in lines:
                mark = line[:1]
                if mark == b">":
                    if self.tail:
                        yield self.tail[0], b"".join(x.strip() for x in self.tail[1:])
                    self.tail = [line]
                elif self.tail is None:
                    self.odd |= self.block == 0 and bool(line.strip())  # what stands before a file's first record
                    self.head.append(line)
                else:
                    self.odd |= mark in (b"@", b"+") and mark != b""
                    self.tail.append(line)

    def _fastq(self, pieces: Iterable[list[bytes]], least: int) -> Iterator[tuple[bytes, bytes]]:
        held: list[bytes] = []
        for lines in pieces:
            held += lines
            if self.tail is None:
                if len(held) < 7:
                    continue
                start = next((i for i in range(4) if held[i][:1] == b"@" and held[i + 2][:1] == b"+"), None)
                if start is None or self.block == 0 and start:
                    self.odd = True
                    return
                self.head, self.tail, held = held[:start], [], held[start:]
            whole = len(held) // 4 * 4
            for i in range(0, whole, 4):
                head, seq, plus, quality = (x.strip() for x in held[i : i + 4])
                if head[:1] != b"@" or plus[:1] != b"+" or len(seq) != len(quality) or not seq:
                    self.odd = True
                    return
                yield head, masked(seq, quality, least)
            held = held[whole:]
        if self.tail is None:
            self.head = held
            if self.block == 0:
                self.odd = next((x.lstrip()[:1] for x in held if x.strip()), b"@") != b"@"
                self.head, self.tail = [], held
        else:
            self.tail = held


_ENDS = pa.schema([("path", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("records", pa.int64()), ("letters", pa.int64()), ("odd", pa.bool_()), ("head", pa.binary()), ("tail", pa.binary())])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for (file, block), pieces in _runs(batches):
            split = Split(unquote(file), block)
            for _ in split.read(pieces):
                pass
            for _ in pieces:  # what an odd split has left
                pass
            ends = (b"\n".join(split.head), None if split.tail is None else b"\n".join(split.tail)) if not split.odd else (None, None)
            yield {"path": unquote(file), "file": file, "block": block, "records": split.records, "letters": split.letters, "odd": split.odd, "head": ends[0], "tail": ends[1]}

    yield from _batched(rows(), _ENDS, "tail")


_PART = pa.schema([("path", pa.string()), ("block", pa.int64()), ("no", pa.int64()), ("at", pa.int64()), *((f.name, f.type) for f in _RECORD if f.name not in ("path", "rec_no", "offset"))])
PART = "path string, block long, no long, at long, name string, comment string, seq binary, length long, fmt string"


def _inside(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for (file, block), pieces in _runs(batches):
                path = unquote(file)
                split = Split(path, block)
                for no, at, head, seq in split.read(pieces, least):
                    name, comment = titled(head)
                    yield {"path": path, "block": block, "no": no, "at": at, "name": name, "comment": comment, "seq": seq, "length": len(seq), "fmt": split.kind}

        yield from _batched(rows(), _PART)

    return run


def _joined(least: int):
    """Records of ends that are put together: path, block, no, at and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    path, block, no, at, text = (batch.column(k)[i].as_py() for k in range(5))
                    for name, comment, seq, quality in parsed((text or b"").splitlines()):
                        yield {"path": path, "block": block, "no": no, "at": at, "name": name, "comment": comment, "seq": masked(seq, quality, least), "length": len(seq), "fmt": kind_of(path)}
                        no, at = no + 1, at + len(seq)

        yield from _batched(rows(), _PART)

    return run


def _in_order(least: int):
    """Records of files whose lines come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            flat = ((unquote(path), line) for batch in batches for line, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for path, own in groupby(flat, key=lambda x: x[0]):
                yield from _whole(path, (line for _, line in own), least)

        yield from _batched(rows(), _RECORD)

    return run


def _lines(spark: SparkSession, paths: Sequence[str], odd: list[str] | None = None, those: bool = False) -> DataFrame:
    """Lines with their file's address and their split's start: of all files, of those that aren't ``odd``, or of those that are; the others aren't read."""
    bounded_batches(spark)
    file = F.col("_metadata.file_path")
    rows = spark.read.text(list(paths))
    if odd:
        rows = rows.where(file.isin(*odd) if those else ~file.isin(*odd))
    return rows.select(F.col("value").cast("binary").alias("line"), file.alias("path"), F.col("_metadata.file_block_start").alias("block"))


def records(spark: SparkSession, paths: Sequence[str], least_quality: int = 0) -> DataFrame:
    """Records of files in any accepted format; ``offset`` is a record's place in its file's joined sequence.

    A quality below ``least_quality`` makes a base N. Files without records have no rows.
    """
    ends = materialize(_lines(spark, paths).mapInArrow(lean(_ends), "path string, file string, block long, records long, letters long, odd boolean, head binary, tail binary"), "sequence-ends")
    odd = sorted(r["file"] for r in ends.where("odd").select("file").distinct().collect())  # files, as on a command line
    good = ends.where(~F.col("file").isin(*odd)) if odd else ends
    along = Window.partitionBy("path").orderBy("block", "part")
    piece = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("head").alias("text")), F.struct(F.lit(1).alias("part"), F.col("tail").alias("text")))).alias("x")
    pieces = good.select("path", "block", "records", "letters", piece).select("path", "block", "records", "letters", "x.part", "x.text").where("text IS NOT NULL")
    runs = pieces.withColumn("run", F.sum("part").over(along))
    first = lambda c: F.min_by(c, F.struct("block", "part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", F.decode("text", "ISO-8859-1").alias("text")))), lambda x: x["text"]), "\n")  # a record's pieces
    runs = runs.groupBy("path", "run").agg(first("block").alias("block"), first("records").alias("no"), first("letters").alias("at"), text.alias("text"))
    joined = materialize(runs.select("path", "block", "no", "at", F.encode("text", "ISO-8859-1").alias("text")).mapInArrow(lean(_joined(least_quality)), PART), "sequence-joined")
    more = joined.groupBy("path", "block").agg(F.count("*").alias("n"), F.sum("length").alias("l"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda a, b: F.coalesce(F.sum(F.col(a) + F.coalesce(b, F.lit(0))).over(before), F.lit(0))
    bases = good.select("path", "block", "records", "letters").join(more, ["path", "block"], "left").select("path", "block", upto("records", "n").alias("n0"), upto("letters", "l").alias("l0"))
    inside = _lines(spark, paths, odd).mapInArrow(lean(_inside(least_quality)), PART)
    found = inside.unionByName(joined).join(small(bases), ["path", "block"])
    found = found.select("path", (F.col("no") + F.col("n0")).alias("rec_no"), "name", "comment", "seq", "length", (F.col("at") + F.col("l0")).alias("offset"), "fmt")
    if odd:
        place = _lines(spark, paths, odd, True).withColumn("n", F.monotonically_increasing_id())  # ascends within a split
        found = found.unionByName(place.repartition(len(odd), "path").sortWithinPartitions("path", "block", "n").select("line", "path").mapInArrow(lean(_in_order(least_quality)), RECORD))
    return found


def piped_records(spark: SparkSession, paths: Sequence[str], command: str, allow: bool = False) -> DataFrame:
    """Records that a shell command prints for each path (``{}`` in it), as a stream. Off unless ``allow``: it runs what it is given."""
    if not allow:
        raise PermissionError("commands are run only with allow=True")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import shlex

        def printed(path: str) -> Iterator[bytes]:
            with subprocess.Popen(command.replace("{}", shlex.quote(path)), shell=True, stdout=subprocess.PIPE) as p:
                yield from (line.rstrip(b"\r\n") for line in p.stdout)
            if p.returncode:
                raise subprocess.CalledProcessError(p.returncode, command)

        yield from _batched((row for batch in batches for path in batch.column(0).to_pylist() for row in _whole(path, printed(path))), _RECORD)

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(1, len(paths))).mapInArrow(run, RECORD)


def sampled_records(records: DataFrame, samples: DataFrame) -> DataFrame:
    """Records with their sample's id; offsets run over all files of a sample in order."""
    short = F.regexp_replace("path", r"^file:/+", "/")
    files = samples.select("sample_id", F.regexp_replace("path", r"^file:/+", "/").alias("_path"), "file_no")
    met = records.withColumn("_path", short).join(F.broadcast(files), "_path")
    order = Window.partitionBy("sample_id").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = met.groupBy("sample_id", "file_no").agg(F.sum("length").alias("_n")).select("sample_id", "file_no", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    out = met.join(F.broadcast(sizes), ["sample_id", "file_no"])
    return out.withColumn("offset", F.col("offset") + F.col("_before")).drop("_path", "_before", "file_no")


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each record a sample of its own: records with sample_id, and samples named after them."""
    named = records.select("path", "rec_no", "name", F.trim(F.concat_ws(" ", "name", "comment")).alias("annotation"))
    samples = numbered(named, ["path", "rec_no"], "sample_id")
    out = records.drop("offset").join(samples.select("path", "rec_no", "sample_id"), ["path", "rec_no"]).withColumn("offset", F.lit(0).cast("long"))
    return out, samples.select("sample_id", "name", "annotation")
