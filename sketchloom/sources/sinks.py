"""Text sinks: tab-separated reports, matrices, lists. Each is written as a folder of parts, never over existing output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.session import numbered


def write_tsv(df: DataFrame, path: str, header: bool = True, digits: int | None = 6, one_file: bool = False) -> None:
    """Doubles with ``digits`` decimals (None: as they are), nulls as NA."""
    shown = []
    for c, t in df.dtypes:
        col = F.col(f"`{c}`")
        text = F.format_string(f"%.{digits}f", col) if digits is not None and t in ("double", "float") else col.cast("string")
        shown.append(F.coalesce(text, F.lit("NA")).alias(c))
    out = df.select(*shown)
    (out.coalesce(1) if one_file else out).write.mode("errorifexists").csv(path, sep="\t", header=header, quote="", emptyValue="")


def write_lines(df: DataFrame, path: str, column: str, order: str | None = None) -> None:
    """One text line a row, in order if one is given."""
    rows = df.orderBy(order) if order else df
    rows.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def keep_and_remove(plan: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names that a deduplication plan keeps, and those it removes."""
    named = plan.join(samples.select("sample_id", "name"), "sample_id")
    return named.where("action = 'keep'").select("sample_id", "name"), named.where("action = 'remove'").select("sample_id", "name")


def genome_list(samples: DataFrame) -> DataFrame:
    """Numbered sample names."""
    return numbered(samples.select("sample_id", "name"), ["sample_id"], "number").select((F.col("number") + 1).alias("number"), "name")


def write_sequences(records: DataFrame, path: str, fmt: str = "fasta", width: int = 80) -> list[str]:
    """Records (name, comment, seq and, for FASTQ, quality) as files of a folder, one for each partition; their paths."""
    title = F.concat(F.lit(">" if fmt == "fasta" else "@"), F.concat_ws(" ", "name", F.nullif("comment", F.lit(""))))
    seq = F.col("seq").cast("string")
    text = F.concat(title, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")) if fmt == "fasta" else F.concat(title, F.lit("\n"), seq, F.lit("\n+\n"), F.col("quality"))
    records.select(text.alias("value")).write.mode("errorifexists").text(path)
    spark = records.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, suffix = folder.getFileSystem(spark._jsc.hadoopConfiguration()), "fa" if fmt == "fasta" else "fq"
    made = []
    for f in fs.listStatus(folder):
        name = f.getPath().getName()
        if name.endswith(".txt"):
            made.append(f"{path}/{name[:-4]}.{suffix}")
            fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(made[-1]))
    return sorted(made)
