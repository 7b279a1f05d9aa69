"""Operators on one relation of sketch entries: distinct, counts, filters, conflicts, metadata.

``entries`` has sample_id, ctx and obj, and may have cnt and pos.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.session import numbered, small

KEY = ("sample_id", "ctx", "obj")


def distinct_entries(raw: DataFrame) -> DataFrame:
    """One row for each key of each sample."""
    return raw.select(*KEY).distinct()


def counted(raw: DataFrame) -> DataFrame:
    """Distinct entries with occurrences and, if there are positions, the first; partial sums come before the shuffle."""
    n = F.sum("cnt") if "cnt" in raw.columns else F.count("*")
    first = [F.min("pos").alias("pos")] if "pos" in raw.columns else []
    return raw.groupBy(*KEY).agg(n.cast("long").alias("cnt"), *first)


def context_counts(entries: DataFrame, name: str = "n_ctx") -> DataFrame:
    """Distinct contexts of each sample."""
    return entries.groupBy("sample_id").agg(F.countDistinct("ctx").alias(name))


def entry_counts(entries: DataFrame, name: str = "n_entries") -> DataFrame:
    return entries.groupBy("sample_id").agg(F.count("*").alias(name))


# --- count filters --------------------------------------------------------------------------


def percentile_cutoff(entries: DataFrame, p: float, least: int = 1) -> DataFrame:
    """For each sample, the smallest count at which the weighted lower tail reaches ``p``.

    Counts below ``least`` don't take part. The histogram of counts, not the entries, is ranked.
    """
    if not 0.0 <= p <= 1.0:
        raise ValueError("a percentile lies within 0..1")
    bins = entries.where(F.col("cnt") >= least).groupBy("sample_id", "cnt").agg((F.count("*") * F.col("cnt")).alias("mass"))
    upto = Window.partitionBy("sample_id").orderBy("cnt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("sample_id")
    rank = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.sum("mass").over(whole)))
    seen = bins.select("sample_id", "cnt", F.sum("mass").over(upto).alias("upto"), rank.alias("rank"))
    return seen.where("upto >= rank").groupBy("sample_id").agg(F.min("cnt").alias("cutoff"))


def count_filter(entries: DataFrame, least: int = 1, percentile: float | None = None, cap: int | None = None, qc: DataFrame | None = None) -> DataFrame:
    """Entries whose count passes the minimum, the percentile cutoff and a QC range; ``cap`` bounds the cutoff."""
    low = F.lit(least).cast("long")
    out = entries
    if qc is not None:
        ranges = qc.where("valid").select("sample_id", F.col("lower").alias("_lower"), F.col("upper").alias("_upper"))
        out = out.join(small(ranges), "sample_id", "left")
        low = F.greatest(low, F.coalesce("_lower", F.lit(0)))
    if percentile is not None:
        cut = percentile_cutoff(entries, percentile, least).withColumnRenamed("cutoff", "_cutoff")
        out = out.join(small(cut), "sample_id", "left")
        low = F.greatest(low, F.coalesce("_cutoff", F.lit(0)))
    if cap is not None:
        low = F.least(low, F.lit(cap))
    keep = F.col("cnt") >= low
    if qc is not None:
        keep &= F.col("_upper").isNull() | (F.col("cnt") <= F.col("_upper"))
    return out.where(keep).select(*entries.columns)


# --- conflicts ------------------------------------------------------------------------------


def drop_conflicts(entries: DataFrame) -> DataFrame:
    """Entries of contexts that have one object only in their sample; the whole context goes otherwise."""
    same = Window.partitionBy("sample_id", "ctx")
    marked = entries.withColumns({"_low": F.min("obj").over(same), "_high": F.max("obj").over(same)})
    return marked.where("_low = _high").drop("_low", "_high")


def finalize(raw: DataFrame, least: int = 1, percentile: float | None = None, cap: int | None = None, qc: DataFrame | None = None, conflicts: bool = False) -> DataFrame:
    """Count, filter, then drop conflicts; in this order an error object that is filtered out frees its context."""
    out = counted(raw)
    if least > 1 or percentile is not None or qc is not None:
        out = count_filter(out, least, percentile, cap, qc)
    return out if conflicts else drop_conflicts(out)


# --- samples --------------------------------------------------------------------------------


def keep_samples(df: DataFrame, samples: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of the samples whose name is listed (column ``name``)."""
    ids = samples.join(small(names.select("name").distinct()), "name", "left_semi").select("sample_id")
    return df.join(small(ids), "sample_id", "left_semi")


def remove_samples(df: DataFrame, samples: DataFrame, names: DataFrame) -> DataFrame:
    ids = samples.join(small(names.select("name").distinct()), "name", "left_semi").select("sample_id")
    return df.join(small(ids), "sample_id", "left_anti")


def drop_positions(entries: DataFrame) -> DataFrame:
    return entries.drop("pos")


# --- uniqueness -----------------------------------------------------------------------------


def unique_keys(entries: DataFrame) -> DataFrame:
    """Keys that occur once in all samples together."""
    return entries.groupBy("ctx", "obj").agg(F.count("*").alias("n")).where("n = 1").select("ctx", "obj")


def mark_unique(entries: DataFrame) -> DataFrame:
    """Entries with is_unique: their key occurs once in the whole relation."""
    same = Window.partitionBy("ctx", "obj")
    return entries.withColumn("is_unique", F.count("*").over(same) == 1)


def unique_owners(entries: DataFrame) -> DataFrame:
    """Contexts that exactly one sample has, and that sample; objects don't matter."""
    owned = entries.groupBy("ctx").agg(F.min("sample_id").alias("sample_id"), F.max("sample_id").alias("_last"))
    return owned.where(F.col("sample_id") == F.col("_last")).select("ctx", "sample_id")


# --- metadata -------------------------------------------------------------------------------


def metadata(records: DataFrame, fmt: Column | None = None) -> DataFrame:
    """Length statistics of each sample's records (columns sample_id and length)."""
    fmt = F.lit("fasta") if fmt is None else fmt
    got = records.groupBy("sample_id").agg(
        F.sum("length").cast("long").alias("total_length_bp"),
        F.count("*").alias("record_count"),
        F.floor(F.expr("percentile(length, 0.5)")).cast("long").alias("median_length_bp"),
        F.max("length").alias("_max"),
        F.avg("length").alias("_mean"),
        F.stddev_pop("length").alias("_sd"),
    )
    level = F.when(fmt == "fasta", F.when(F.col("total_length_bp") > 0, F.col("_max") / F.col("total_length_bp")).otherwise(-1.0)).when(fmt == "fastq", 0.0).otherwise(-1.0)
    cv = F.when((F.col("record_count") > 1) & (F.col("_mean") > 0), F.col("_sd") / F.col("_mean")).otherwise(0.0)
    return got.select("sample_id", "total_length_bp", "record_count", "median_length_bp", level.alias("asm_level"), cv.alias("length_cv"))


def grouped(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Samples collapsed to taxa: the distinct keys of each taxon; counts are dropped.

    ``groups`` has sample_id, taxid and taxname; taxid 0 is ignored. A taxid with two names is an error.
    """
    wrong = groups.where("taxid <> 0").groupBy("taxid").agg(F.min("taxname").alias("a"), F.max("taxname").alias("b")).where("a <> b").limit(1).collect()
    if wrong:
        raise ValueError(f"taxid {wrong[0]['taxid']} has more than one name")
    named = groups.where("taxid <> 0").select("sample_id", "taxid", F.concat_ws("_", F.col("taxid").cast("string"), "taxname").alias("name"))
    return entries.join(small(named), "sample_id").select(F.col("taxid").alias("sample_id"), "name", "ctx", "obj").distinct()


def read_groups(path: str, samples: DataFrame) -> DataFrame:
    """:func:`from_names` of a table file: a line ``taxid, tab, taxname`` for each sample, in order. Another number of lines is an error."""
    lines = samples.sparkSession.read.text(path).select("value", F.monotonically_increasing_id().alias("_at"))
    rows = numbered(lines, ["_at"], "_row").select("_row", F.split("value", "\t").alias("_parts"))
    rows = rows.select("_row", F.trim(F.col("_parts")[0]).cast("long").alias("taxid"), F.coalesce(F.get("_parts", F.lit(1)), F.lit("")).alias("taxname"))
    order = numbered(samples.select("sample_id"), ["sample_id"], "_row")
    n, have = rows.count(), samples.count()
    if n != have:
        raise ValueError(f"{n} lines for {have} samples")
    return order.join(small(rows, n), "_row").select("sample_id", "taxid", "taxname")


def from_names(samples: DataFrame, lines: Sequence[tuple[int, str]]) -> DataFrame:
    """Grouping rows for samples in order, one (taxid, taxname) each."""
    rows = samples.sparkSession.createDataFrame([(i, int(t), n) for i, (t, n) in enumerate(lines)], "_row long, taxid long, taxname string")
    order = numbered(samples.select("sample_id"), ["sample_id"], "_row")
    return order.join(F.broadcast(rows), "_row").select("sample_id", "taxid", "taxname")
