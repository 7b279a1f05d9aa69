"""Queries of sequence files and of the older sketches: nations' sequences are written to files and read again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sketchloom.operators import inverted
from sketchloom.operators.entries import counted
from sketchloom.operators.tokenize import tokenized
from sketchloom.plans import sql as S
from sketchloom.plans import views as V
from sketchloom.plans.registry import query
from sketchloom.session import scratch_path
from sketchloom.sources import fastx
from sketchloom.sources.sinks import write_sequences

#: Quality of a base: (7 * its place + its order's number) modulo 41.
_LEAST = 6


def _written(spark, d, fmt):
    g = V.genomes(spark, d)
    order = (F.col("offset") / 1000).cast("long")
    quality = F.array_join(F.transform(F.sequence(F.lit(0), F.length("seq") - 1), lambda i: F.char(33 + (i * 7 + order) % 41)), "")
    rows = g.select(F.concat(F.lit("r"), order).alias("name"), F.concat(F.lit("nation "), "sample_id").alias("comment"), "seq", quality.alias("quality"))
    path = scratch_path(spark, fmt)
    write_sequences(rows, path, fmt)
    return path


@query("s4_s5_sequence_files", f"WITH {S.GENOMES} SELECT fmt, 'r' || l_orderkey AS name, 'nation ' || sample_id AS comment, CAST(length(seq) AS BIGINT) AS length, md5(seq) AS seq_md5 FROM g, (VALUES ('fasta'), ('fastq')) AS f(fmt)")
def s4_s5(spark, d):
    got = fastx.records(spark, [_written(spark, d, fmt) for fmt in ("fasta", "fastq")])
    return got.select("fmt", "name", "comment", "length", F.md5("seq").alias("seq_md5"))


@query("s8_split_records", f"WITH {S.TOKENS} SELECT 'r' || (pos // 1000) AS name, 'r' || (pos // 1000) || ' nation ' || sample_id AS annotation, ctx, obj, COUNT(*) AS cnt, MIN(pos % 1000) AS pos FROM t GROUP BY sample_id, pos // 1000, ctx, obj")
def s8_split(spark, d):
    """Each record of the files is a sample of its own, with places from its first base."""
    split, samples = fastx.split_records(fastx.records(spark, [_written(spark, d, "fasta")]))
    return counted(tokenized(split.select("sample_id", "seq", "offset"), V.KMERS)).join(samples, "sample_id").select("name", "annotation", "ctx", "obj", "cnt", "pos")


@query("v9_quality_filter", f"WITH {S.tokens(f'len(list_filter(range(i - 1, i + 8), lambda j : (j * 7 + l_orderkey) % 41 < {_LEAST})) = 0')} SELECT sample_id, ctx, obj, COUNT(*) AS cnt, MIN(pos) AS pos FROM t GROUP BY 1, 2, 3")
def v9_quality(spark, d):
    got = fastx.records(spark, [_written(spark, d, "fastq")], _LEAST)
    reads = got.select(F.substr("comment", F.lit(8)).cast("long").alias("sample_id"), "seq", (F.substr("name", F.lit(2)).cast("long") * 1000).alias("offset"))
    return counted(tokenized(reads, V.KMERS))


#: Twelve bases of which the middle six are permuted; a sixteenth is kept. The place of a sub-context follows from a rule, so that SQL has it too.
_OLD = inverted.SubcontextLayout(half=6, sub=3, level=1)
_PLACE = "(inner_ctx * 1597 + 811) % 4096"
_KEYS = f"""{S.GENOMES}, p AS (SELECT sample_id, l_orderkey, substr(seq, i, 12) AS own, reverse(translate(substr(seq, i, 12), 'ACGT', 'TGCA')) AS other FROM (SELECT *, unnest(range(1, length(seq) - 10)) AS i FROM g)),
o AS (SELECT sample_id, l_orderkey, LEAST(own, other) AS kmer FROM p), k AS (SELECT *, CAST({S.packed('substr(kmer, 4, 6)', 6)} AS BIGINT) AS inner_ctx FROM o), kept AS (SELECT *, {_PLACE} AS place FROM k WHERE {_PLACE} < 256)"""


def _old_keys(spark, d, sample):
    return inverted.keyed(V.genomes(spark, d).select(sample.alias("sample_id"), "seq"), _OLD, (np.arange(4096) * 1597 + 811) % 4096)


def _places(spark):
    return spark.range(4096).select(F.col("id").alias("inner"), ((F.col("id") * 1597 + 811) % 4096).alias("place"))


@query("v10_reversed_samples", f"WITH {_KEYS} SELECT DISTINCT sample_id, (CAST({S.packed('substr(kmer, 1, 3) || substr(kmer, 10, 3)', 6)} AS BIGINT)) * 256 + place AS key, kmer FROM kept")
def v10_samples(spark, d):
    return inverted.reversed_kmers(_old_keys(spark, d, F.col("sample_id")).distinct(), _OLD, _places(spark))


@query("v10_reversed_reads", f"WITH {_KEYS} SELECT l_orderkey AS read, kmer, COUNT(*) AS n FROM kept GROUP BY 1, 2")
def v10_reads(spark, d):
    found = inverted.reversed_kmers(_old_keys(spark, d, (F.col("offset") / 1000).cast("long")), _OLD, _places(spark))
    return found.groupBy(F.col("sample_id").alias("read"), "kmer").agg(F.count("*").alias("n"))


@query("v9_inverted_store", f"WITH {S.SUPP} SELECT q.sample_id AS q, r.sample_id AS r, COUNT(*) AS shared FROM supp q JOIN supp r ON q.ctx = r.ctx AND q.obj = r.obj AND r.sample_id < q.sample_id GROUP BY 1, 2")
def v9_inverted(spark, d):
    """Suppliers appended in two runs, one of them twice, and merged."""
    keys, path = V.supp(spark, d).select("sample_id", inverted.key_of().alias("key")), scratch_path(spark, "inverted")
    for run in (0, 1, 1):
        inverted.append(path, keys.where(F.col("sample_id") % 2 == run), run)
    return inverted.shared_counts(inverted.merged(spark, path, path + "-merged"))
