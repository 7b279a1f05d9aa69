"""Whole paths from sequence files to sketches and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.operators import ani, entries, graph, pairs, readqc
from sketchloom.operators.tokenize import KmerLayout, layout_id, tokenized
from sketchloom.session import materialize, small
from sketchloom.sources import fastx


def params(layout: KmerLayout, counts: bool, conflicts: bool) -> dict:
    c = layout.pattern
    return {
        "hash_id": layout_id(layout), "koc": counts, "conflict": conflicts, "coden_len": (c.count("C") // 2) if c.startswith("CCO") else 0, "klen": layout.k,
        "hclen": c.count("C") // 2, "holen": len(c) - len(c.lstrip("O")), "drfold": layout.fold, "ctx_bits": layout.ctx_bits, "obj_bits": layout.obj_bits, "pattern": c,
    }


def sketch(
    spark: SparkSession, paths: Sequence[str], layout: KmerLayout = KmerLayout.coden(), *, least: int = 1, percentile: float | None = None, cap: int | None = None, reads_qc: bool = False,
    conflicts: bool = False, counts: bool = False, positions: bool = False, as_one: bool = False, name: str | None = None, split: bool = False, least_quality: int = 0,
) -> tuple[DataFrame, DataFrame, dict]:
    """Entries, samples and parameters of sequence files: tokenize, count, filter, drop conflicts, describe.

    A k-mer that holds a base of a quality below ``least_quality`` isn't counted.
    """
    got = fastx.records(spark, fastx.checked(paths), least_quality)
    if split:
        got, samples = fastx.split_records(got)
    else:
        samples = fastx.as_samples(spark, list(paths), as_one, name)
        got = fastx.sampled_records(got, samples)
        samples = samples.groupBy("sample_id").agg(F.first("name").alias("name"))
    made = sketch_records(got, layout, least=least, percentile=percentile, cap=cap, reads_qc=reads_qc, conflicts=conflicts)
    keep = ["sample_id", "ctx", "obj", *(["cnt"] if counts else []), *(["pos"] if positions else [])]
    meta = entries.metadata(got, F.lit("fastq" if paths and fastx.kind_of(paths[0]) == "fastq" else "fasta"))
    return made.select(*keep), samples.join(F.broadcast(meta), "sample_id", "left"), params(layout, counts, conflicts)


def sketch_records(got: DataFrame, layout: KmerLayout = KmerLayout.coden(), *, least: int = 1, percentile: float | None = None, cap: int | None = None, reads_qc: bool = False, conflicts: bool = False) -> DataFrame:
    """Finished entries, with counts and positions, of records with sample_id, seq and offset."""
    raw = tokenized(got, layout)
    qc = readqc.inferred_ranges(entries.counted(raw), least) if reads_qc else None
    return entries.finalize(raw, least, percentile, cap, qc, conflicts)


def deduplicated(
    made: DataFrame, samples: DataFrame, layout: KmerLayout = KmerLayout.coden(), *, metric: str = "ctx-moe", cut: float = 0.05, ctxcut: int = 3, max_afcut: float = 0.8,
    full_linkage: bool = False, max_frequency: int = 0, min_votes: int = 0, step: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries and samples of the best sample of each group, and the plan's report.

    Samples closer than ``cut`` are duplicates; groups are greedy in quality order, or cliques. With ``max_frequency``, ``min_votes`` or ``step`` only
    pairs that so many rare contexts nominate are compared.
    """
    made = materialize(made, "dedup-entries")
    nominated = max_frequency or min_votes or step > 1
    candidates = pairs.nominated(made, max(1, min_votes), max_frequency, step) if nominated else None
    edges = ani.edges(made, metric, cut, ctxcut, max_afcut, layout.distances(), candidates)
    kind = F.col("fmt") if "fmt" in samples.columns else F.lit("fasta")
    known = samples.join(entries.entry_counts(made), "sample_id", "left").withColumns({
        "n_entries": F.coalesce("n_entries", F.lit(0)), "fmt": kind, "is_fasta": kind == "fasta", "meta_valid": F.coalesce(F.col("total_length_bp") > 0, F.lit(False)),
    })
    known = materialize(known, "dedup-samples")
    plan = (graph.full_linkage if full_linkage else graph.greedy)(graph.quality_rank(known), edges)
    plan = materialize(plan, "dedup-plan")
    kept = plan.where("action = 'keep'").select("sample_id")
    return made.join(small(kept), "sample_id", "left_semi"), samples.join(small(kept), "sample_id", "left_semi"), graph.plan_report(plan, known)


def compare_files(spark: SparkSession, qry: Sequence[str], ref: Sequence[str] | None = None, options: ani.Options = ani.Options(), layout: KmerLayout = KmerLayout.coden()) -> DataFrame:
    """The comparison report of sequence files, sketched on the way."""
    q, qs, _ = sketch(spark, qry, layout)
    r, rs = (None, None) if ref is None else sketch(spark, ref, layout)[:2]
    return ani.detail_columns(ani.detail(q, r, options, layout.distances()), qs, rs)
