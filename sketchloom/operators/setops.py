"""Set algebra over sketch entries: unions, markers, intersection, subtraction, append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.operators.entries import unique_keys


def union_pan(entries: DataFrame) -> DataFrame:
    """Distinct keys of all samples."""
    return entries.select("ctx", "obj").distinct()


def union_sketch(entries: DataFrame, sample_id: int = 0) -> DataFrame:
    """The same as a sketch of one sample, presence only."""
    return union_pan(entries).select(F.lit(sample_id).cast("long").alias("sample_id"), "ctx", "obj")


def unique_union(entries: DataFrame) -> DataFrame:
    return unique_keys(entries)


def combined_pan(*pans: DataFrame) -> DataFrame:
    """Several pans as one."""
    first, *rest = pans
    for p in rest:
        first = first.unionByName(p)
    return first.distinct()


def marker_db(entries: DataFrame) -> DataFrame:
    """Per sample, only the keys that no other sample has."""
    return entries.join(unique_keys(entries), ["ctx", "obj"], "left_semi").select(*entries.columns)


def _keys(key: str) -> list[str]:
    if key not in ("full", "ctx"):
        raise ValueError("a set operation's key is 'full' or 'ctx'")
    return ["ctx", "obj"] if key == "full" else ["ctx"]


def intersect(entries: DataFrame, pan: DataFrame, key: str = "full") -> DataFrame:
    """Entries whose key is in ``pan``; all their columns are kept."""
    return entries.join(pan.select(*_keys(key)).distinct(), _keys(key), "left_semi").select(*entries.columns)


def subtract(entries: DataFrame, pan: DataFrame, key: str = "full") -> DataFrame:
    return entries.join(pan.select(*_keys(key)).distinct(), _keys(key), "left_anti").select(*entries.columns)


COMPATIBLE = ("hash_id", "koc", "conflict", "coden_len", "klen", "hclen", "holen", "drfold")


def check_compatible(a: dict, b: dict, fields: tuple[str, ...] = ("hash_id",)) -> None:
    wrong = [f for f in fields if a.get(f) != b.get(f)]
    if wrong:
        raise ValueError(f"incompatible sketches: {', '.join(f'{f} {a.get(f)} and {b.get(f)}' for f in wrong)}")


def append(a: DataFrame, b: DataFrame, a_params: dict | None = None, b_params: dict | None = None) -> DataFrame:
    """``b``'s samples after ``a``'s, with new ids; counts and positions stay only if both have them."""
    if a_params is not None and b_params is not None:
        check_compatible(a_params, b_params, COMPATIBLE)
    last = a.agg(F.max("sample_id")).first()[0]
    offset = 0 if last is None else last + 1
    columns = [c for c in a.columns if c in b.columns]
    return a.select(*columns).unionByName(b.withColumn("sample_id", F.col("sample_id") + offset).select(*columns))


#: A sample's input metadata; the rest of a sample's columns is appended as it is.
METADATA = ("total_length_bp", "record_count", "median_length_bp", "asm_level", "length_cv", "version", "fmt", "create_type", "flags")


def append_samples(parts: Sequence[DataFrame], params: Sequence[dict] = ()) -> DataFrame:
    """Samples of several sketches one after another, with the ids that :func:`append` gives their entries.

    Metadata stay if all parts have them (a column ``total_length_bp``). If only some have, nobody's can be compared, so all become zero (text
    columns empty). QC ranges, annotations and other columns are kept where a part has them and are null elsewhere. Parameters of the parts must
    agree.
    """
    for p in params[1:]:
        check_compatible(params[0], p, COMPATIBLE)
    having = ["total_length_bp" in p.columns for p in parts]
    out, offset = None, 0
    for part in parts:
        last = part.agg(F.max("sample_id")).first()[0]
        moved = part.withColumn("sample_id", F.col("sample_id") + offset)
        offset += 0 if last is None else last + 1
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
    if any(having) and not all(having):
        out = out.withColumns({c: (F.lit("") if t == "string" else F.lit(0).cast(t)) for c, t in out.dtypes if c in METADATA})
    return out
