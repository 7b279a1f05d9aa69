"""Distance tables: long reports, matrices with a header, square PHYLIP; found out from the first line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def detect(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"an empty distance table: {path}")
    line = first["value"]
    columns = line.split("\t")
    if {"Qry", "Ref", "Distance"} <= set(columns):
        return "ani"
    if line.strip().isdigit():
        return "phylip"
    if len(columns) > 1:
        return "matrix"
    raise ValueError(f"the format of {path} can't be told; state it")


def read(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """query, ref and distance from any of the formats; cells that are no finite numbers are left out."""
    fmt = fmt or detect(spark, path)
    if fmt == "ani":
        rows = spark.read.csv(path, sep="\t", header=True).select(F.col("Qry").alias("query"), F.col("Ref").alias("ref"), F.expr("try_cast(Distance AS DOUBLE)").alias("distance"))
    elif fmt == "matrix":
        wide = spark.read.csv(path, sep="\t", header=True)
        first, *names = wide.columns
        quoted = [f"`{n.replace('`', '``')}`" for n in names]
        cells = F.explode(F.array(*(F.struct(F.lit(n).alias("ref"), F.col(q).alias("v")) for n, q in zip(names, quoted, strict=True))))
        rows = wide.select(F.col(f"`{first}`").alias("query"), cells.alias("c")).select("query", "c.ref", F.expr("try_cast(c.v AS DOUBLE)").alias("distance"))
    elif fmt == "phylip":
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("i"), F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") > 1)
        labels = [r["l"] for r in lines.orderBy("i").select(F.get("f", F.lit(0)).alias("l")).collect()]  # the labels of a square matrix
        cells = lines.select(F.get("f", F.lit(0)).alias("query"), F.posexplode(F.slice("f", 2, len(labels))).alias("j", "v"))
        named = F.element_at(F.array(*map(F.lit, labels)), F.col("j") + 1)
        rows = cells.select("query", named.alias("ref"), F.expr("try_cast(v AS DOUBLE)").alias("distance"))
    else:
        raise ValueError("a distance table is ani, matrix or phylip")
    return rows.where(F.col("distance").isNotNull() & ~F.isnan("distance") & (F.abs("distance") < float("inf")) & (F.col("query") != ""))


def named(distances: DataFrame, idmap: dict[str, str]) -> DataFrame:
    """References renamed to tree tips: a name or an id of the map may stand for a tip; others are left out."""
    pairs = {**{s: t for t, s in idmap.items()}, **{t: t for t in idmap}}
    names = distances.sparkSession.createDataFrame(sorted(pairs.items()), "_name string, _tip string")
    return distances.join(F.broadcast(names), F.col("ref") == F.col("_name")).select("query", F.col("_tip").alias("ref"), "distance")
