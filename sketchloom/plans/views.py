"""The driver's tables as sketch relations.

``supp``: suppliers as samples, parts as contexts, whole quantities as 6-bit objects (3 sections).
``cust``: customers as samples, parts as contexts, line numbers as objects.
``size``: suppliers as samples, part sizes as contexts, half quantities as objects; contexts that all samples share.
``rord``, ``qord``: suppliers and customers' nations as samples, orders as contexts; contexts that few samples have.
``genomes``: nations as samples, orders as sequences made from the last digits of their parts' numbers.
``nat``: customers' nations as samples, parts as contexts, whole quantities as objects, as in ``supp``.
``event``: users as samples, event types as dimensions, for abundance vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions.distances import Layout
from sketchloom.operators.entries import counted
from sketchloom.operators.tokenize import KmerLayout
from sketchloom.session import table

#: Objects are quantities below 64: three 2-bit sections. Contexts keep the default 44 bits.
SUPP_LAYOUT = Layout(ctx_bits=44, obj_bits=6)

#: A k-mer of nine bases: objects outside and in the middle, three context bases on either side.
KMERS = KmerLayout.manual(3, 1, 1, fold=1)


def raw_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("ctx"), F.col("l_quantity").cast("long").alias("obj"), F.col("l_orderkey").alias("pos"))


def supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(raw_supp(spark, sf_dir))


def cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    met = li.join(orders, li["l_orderkey"] == orders["o_orderkey"])
    return counted(met.select(F.col("o_custkey").alias("sample_id"), F.col("l_partkey").alias("ctx"), F.col("l_linenumber").cast("long").alias("obj"), F.col("l_orderkey").alias("pos")))


def nat(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    met = li.join(orders, li["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == customer["c_custkey"])
    return counted(met.select(F.col("c_nationkey").cast("long").alias("sample_id"), F.col("l_partkey").alias("ctx"), F.col("l_quantity").cast("long").alias("obj"), F.col("l_orderkey").alias("pos")))


def size(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    met = li.join(part, li["l_partkey"] == part["p_partkey"])
    return counted(met.select(F.col("l_suppkey").alias("sample_id"), F.col("p_size").cast("long").alias("ctx"), F.expr("CAST(l_quantity AS BIGINT) div 2").alias("obj"), F.col("l_orderkey").alias("pos")))


def rord(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return counted(li.select(F.col("l_suppkey").alias("sample_id"), F.col("l_orderkey").alias("ctx"), F.col("l_quantity").cast("long").alias("obj"), F.col("l_linenumber").cast("long").alias("pos")))


def qord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object for each context: the smallest quantity in the order."""
    li, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    met = li.join(orders, li["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == customer["c_custkey"])
    return met.groupBy(F.col("c_nationkey").cast("long").alias("sample_id"), F.col("l_orderkey").alias("ctx")).agg(F.min(F.col("l_quantity").cast("long")).alias("obj"), F.count("*").alias("cnt"))


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, seq and offset; the last eight digits of a part's number in base four are eight bases."""
    li, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    met = li.join(orders, li["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == customer["c_custkey"])
    bases = F.translate(F.lpad(F.conv(F.pmod("l_partkey", F.lit(4**8)), 10, 4), 8, "0"), "0123", "ACGT")
    lines = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), bases.alias("bases"))))
    made = met.groupBy(F.col("c_nationkey").cast("long").alias("sample_id"), "l_orderkey").agg(lines.alias("lines"))
    return made.select("sample_id", F.array_join(F.transform("lines", lambda x: x["bases"]), "").alias("seq"), (F.col("l_orderkey") * 1000).alias("offset"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as records of a supplier, with their quantity as length."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample_id"), F.col("l_quantity").cast("long").alias("length"))


def supp_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("sample_id"), F.col("s_name").alias("name"))


def taxonomy(spark: SparkSession, sf_dir: str) -> str:
    """Suppliers below their nations below their regions as a Newick tree; branches are as long as a rule of the keys says."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select("n_regionkey", "n_nationkey", "s_suppkey").orderBy("n_regionkey", "n_nationkey", "s_suppkey")
    held: dict[int, dict[int, list[str]]] = {}
    for r in rows.toLocalIterator():  # a tree is text, with a word for each tip
        held.setdefault(r[0], {}).setdefault(r[1], []).append(f"s{r[2]}:{(r[2] % 7 + 1) / 50}")
    return "(" + ",".join("(" + ",".join(f"({','.join(tips)})n{n}:{(n % 5 + 1) / 40}" for n, tips in nations.items()) + f")r{r}:{(r + 1) / 80}" for r, nations in held.items()) + ");"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' shares of event types in percent; an event type's number is its place in the alphabet."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    n = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    kinds = n.select("event_type").distinct().select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long").alias("ref_idx"))
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))
    return n.withColumn("pct", share).join(F.broadcast(kinds), "event_type").select(F.col("user_id").alias("sample"), "ref_idx", "pct")
