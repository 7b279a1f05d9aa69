"""The older key-overlap distances: Jaccard or containment of plain key sets, with statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sketchloom.operators.entries import entry_counts
from sketchloom.operators.pairs import exact_overlap
from sketchloom.session import small

METRICS = ("jaccard", "min", "qry", "ref")


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(v) if v == v else v)


def chance_overlap(k: int, reduced: int) -> Column:
    """Keys that are expected to be shared by chance, from both sides' unshared keys."""
    p = 1.0 / 4.0 ** (k - reduced)
    x, y = F.col("q_size") - F.col("shared"), F.col("r_size") - F.col("shared")
    px, py = 1 - F.pow(F.lit(1 - p), x), 1 - F.pow(F.lit(1 - p), y)
    below = px + py - 2 * px * py
    return F.when(below != 0, px * py * (x + y) / below).otherwise(0.0)


def distances(qry: DataFrame, ref: DataFrame | None = None, metric: str = "jaccard", k: int = 16, correction: bool = False, reduced: int = 0, keys: tuple[str, ...] = ("ctx", "obj"), threshold: float = 1.0) -> DataFrame:
    """q, r, sizes, shared keys, the metric and its distance, at most 1."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)}")
    other = qry if ref is None else ref
    distinct = lambda e: e.select("sample_id", *keys).distinct()
    q = entry_counts(distinct(qry), "q_size").withColumnRenamed("sample_id", "q")
    r = entry_counts(distinct(other), "r_size").withColumnRenamed("sample_id", "r")
    rows = exact_overlap(qry, ref, keys).join(small(q), "q").join(small(r), "r")
    rows = rows.withColumn("by_chance", chance_overlap(k, reduced) if correction else F.lit(0.0))
    below = {"jaccard": F.col("q_size") + F.col("r_size") - F.col("shared"), "min": F.least("q_size", "r_size"), "qry": F.col("q_size"), "ref": F.col("r_size")}[metric]
    rows = rows.withColumn("denominator", below).withColumn("value", (F.col("shared") - F.col("by_chance")) / F.col("denominator"))
    raw = F.log(1 / (2 * F.col("value")) + 0.5) if metric == "jaccard" else F.log(1 / F.col("value"))
    rows = rows.withColumn("distance", F.when(F.col("value") > 0, F.least(F.lit(1.0), raw / k)).otherwise(1.0))
    return rows.where(F.col("distance") <= threshold)


def with_statistics(rows: DataFrame, comparisons: int, metric: str = "jaccard", k: int = 16) -> DataFrame:
    """p-value, its product with the number of comparisons, and 95 % ranges of metric and distance."""
    rows = rows.withColumn("sd", F.sqrt(F.col("value") * (1 - F.col("value")) / F.col("denominator")))
    rows = rows.withColumn("p_value", 0.5 * erfc(F.when(F.col("sd") > 0, F.col("value") / F.col("sd") * math.sqrt(0.5)).otherwise(float("inf"))))
    to_distance = (lambda v: F.log(1 / (2 * v) + 0.5) / k) if metric == "jaccard" else (lambda v: F.log(1 / v) / k)
    low, high = F.col("value") - 1.96 * F.col("sd"), F.col("value") + 1.96 * F.col("sd")
    safe = lambda v: F.when(v > 0, to_distance(F.nullif(v, F.lit(0.0))))
    return rows.withColumns({"fdr": F.col("p_value") * comparisons, "value_low": low, "value_high": high, "distance_low": safe(high), "distance_high": safe(low)})


def nearest(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` nearest references of each query; ties by id."""
    order = Window.partitionBy("q").orderBy("distance", "r")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
