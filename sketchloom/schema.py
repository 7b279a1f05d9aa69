"""Schemas of the canonical relations."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

ENTRIES = StructType([StructField("sample_id", LongType()), StructField("ctx", LongType()), StructField("obj", LongType()), StructField("cnt", LongType()), StructField("pos", LongType())])

META = StructType(
    [
        StructField("total_length_bp", LongType()),
        StructField("record_count", LongType()),
        StructField("median_length_bp", LongType()),
        StructField("asm_level", FloatType()),
        StructField("length_cv", FloatType()),
        StructField("version", IntegerType()),
        StructField("fmt", StringType()),
        StructField("create_type", StringType()),
        StructField("flags", IntegerType()),
    ]
)

QC = StructType([StructField("valid", BooleanType()), StructField("applied", BooleanType()), StructField("lower", LongType()), StructField("upper", LongType()), StructField("mode", LongType())])

SAMPLES = StructType([StructField("sample_id", LongType()), StructField("name", StringType()), StructField("annotation", StringType()), StructField("meta", META), StructField("qc", QC)])

PARAMS = StructType(
    [StructField(n, LongType()) for n in ("hash_id", "coden_len", "klen", "hclen", "holen", "drfold", "ctx_bits", "obj_bits")] + [StructField("koc", BooleanType()), StructField("conflict", BooleanType())]
)

ABUNDANCE = StructType([StructField("sample", LongType()), StructField("ref_idx", LongType()), StructField("pct", DoubleType())])
