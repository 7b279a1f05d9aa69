"""Pair features of samples: a row for each sample and context, one equi-join on context, one aggregate by pair.

All pairs of samples meet by :mod:`meets`: what a sample meets in a context is one packed row, so nothing is shuffled for each pair and context.

Pairs of candidates, and samples or objects that aren't whole numbers, meet in the plan itself: a sample's objects of a context are gathered, rows are dealt by context and
sums by pair are shuffled again, after partial aggregation.

What is stored, or asked for in tiles, becomes *groups* (:func:`groups`), which are written: a sample's least and greatest object of a
context and how many it has. Where both sides have at most two objects, the least difference of their objects is an expression of
these two; groups of more are few, have their entries beside them, and meet the others on their own. A context of groups that more
than ``TILE`` samples have is dealt into blocks of about ``TILE``, by its own count, and pairs of blocks meet, each once. So a
row is copied as often as its context has blocks, and a task has at most ``TILE`` squared pairs. Only where there are more than ``TILE`` samples is any
context counted.

:func:`write_index` stores groups bucketed by context: comparisons with them deal the queries by context and read the
reference as it lies.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions.bits import sections
from sketchloom.operators import meets
from sketchloom.operators.entries import context_counts, drop_conflicts
from sketchloom.session import materialize, measured, short_methods, small

#: Members of a context in a block.
TILE = 4096


@dataclass(frozen=True)
class Groups:
    """``rows`` has ctx, sample_id, lo, hi and n; ``many`` has the entries of groups of more than two; ``counts`` has each sample's contexts."""

    rows: DataFrame
    many: DataFrame | None
    n_many: int
    counts: DataFrame
    n_samples: int

    @property
    def clean(self) -> Groups:
        """Without contexts of several objects."""
        rows = self.rows.where("lo = hi")
        counts = materialize(rows.groupBy("sample_id").agg(F.count("*").alias("n_ctx")), "counts")
        return replace(self, rows=rows, many=None, n_many=0, counts=counts)

    def entries(self) -> DataFrame:
        """sample_id, ctx and obj again."""
        few = self.rows if self.many is None else self.rows.where("n <= 2")
        out = few.select("sample_id", "ctx", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("obj"))
        return out if self.many is None else out.unionByName(self.many.select("sample_id", "ctx", "obj"))


def groups(entries: DataFrame | Groups, conflict_free: bool = False) -> Groups:
    """Entries as groups; ``conflict_free`` states that no sample has several objects of a context, so nothing is grouped."""
    if isinstance(entries, Groups):
        return entries
    one = F.col("obj")
    made = entries.select("ctx", "sample_id", one.alias("lo"), one.alias("hi"), F.lit(1).cast("long").alias("n")) if conflict_free else entries.groupBy("ctx", "sample_id").agg(F.min("obj").alias("lo"), F.max("obj").alias("hi"), F.count("*").alias("n"))
    rows, seen = measured(made.where("ctx IS NOT NULL AND sample_id IS NOT NULL AND lo IS NOT NULL"), "groups", many=F.count_if(F.col("n") > 2))
    return _completed(rows, entries, seen["many"])


def _completed(rows: DataFrame, entries: DataFrame, groups_of_many: int) -> Groups:
    counts, seen = measured(rows.groupBy("sample_id").agg(F.count("*").alias("n_ctx")), "counts", samples=F.count("*"))
    many, n_many = None, 0
    if groups_of_many:
        big = rows.where("n > 2").select("ctx", "sample_id")
        many, told = measured(entries.select("ctx", "sample_id", "obj").where("obj IS NOT NULL").join(small(big, groups_of_many), ["ctx", "sample_id"], "left_semi"), "many", rows=F.count("*"))
        n_many = told["rows"]
    return Groups(rows, many, n_many, counts, seen["samples"])


# --- a stored reference -----------------------------------------------------------------------


def write_index(name: str, entries: DataFrame, buckets: int, path: str | None = None) -> None:
    """Groups of entries as table ``name``, bucketed and sorted by context, with tables ``name_many`` and ``name_counts`` beside it.

    ``path`` is a folder for them; without one they lie in the warehouse.
    """
    made = groups(entries)

    def save(df: DataFrame, table: str, bucketed: bool) -> None:
        writer = df.write.mode("errorifexists").format("parquet")
        writer = writer.bucketBy(buckets, "ctx").sortBy("ctx") if bucketed else writer
        (writer.option("path", f"{path}/{table}") if path else writer).saveAsTable(table)

    rows = made.rows.repartition(buckets, "ctx")  # a file for each bucket
    save(rows, name, True)
    save(made.entries().limit(0) if made.many is None else made.many, f"{name}_many", False)
    save(made.counts, f"{name}_counts", False)


def read_index(spark: SparkSession, name: str) -> Groups:
    many, counts = spark.table(f"{name}_many"), spark.table(f"{name}_counts")
    n = many.count()
    return Groups(spark.table(name), many if n else None, n, counts, counts.count())


def drop_index(spark: SparkSession, name: str) -> None:
    for table in (name, f"{name}_many", f"{name}_counts"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


# --- pairs ------------------------------------------------------------------------------------


def _blocks(rows: DataFrame, tile: int, name: str) -> DataFrame:
    return rows.groupBy("ctx").agg(F.count("*").alias("_n")).where(F.col("_n") > tile).select("ctx", F.ceil(F.col("_n") / tile).cast("int").alias(name))


def _tiled(q: DataFrame, r: DataFrame, busy: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the tiles that a row is in, all of its own block of one side and any block of the other."""
    busy = small(busy, n)
    own = lambda side, blocks: F.pmod(F.xxhash64(side), F.coalesce(blocks, F.lit(1)).cast("long")).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.coalesce(blocks, F.lit(1)) - 1))
    q = q.join(busy, "ctx", "left").withColumn("_i", own("q", F.col("bq"))).select("*", every(F.col("br")).alias("_j")).drop("bq", "br")
    r = r.join(busy, "ctx", "left").withColumn("_j", own("r", F.col("br"))).select("*", every(F.col("bq")).alias("_i")).drop("bq", "br")
    return q, r


def _self_tiled(rows: DataFrame, side: str, busy: DataFrame, n: int) -> DataFrame:
    """A row in all tiles of its block: (i, j) of blocks i >= j."""
    blocks = F.coalesce("bq", F.lit(1))
    own = F.pmod(F.xxhash64(side), blocks.cast("long")).cast("int")
    out = rows.join(small(busy, n), "ctx", "left").withColumn(f"_{side}_block", own)
    other = out.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_k")).drop("bq")
    mine = F.col(f"_{side}_block")
    return other.withColumns({"_i": F.greatest(mine, "_k"), "_j": F.least(mine, "_k")}).drop("_k")


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("ctx", F.col("sample_id").alias(side), F.col("lo").alias(f"{side}_lo"), F.col("hi").alias(f"{side}_hi"))


def least_difference() -> Column:
    """The least difference of two sides' objects, of at most two each."""
    d = {(a, b): sections(F.col(f"q_{a}"), F.col(f"r_{b}")) for a in ("lo", "hi") for b in ("lo", "hi")}
    single = (F.col("q_lo") == F.col("q_hi")) & (F.col("r_lo") == F.col("r_hi"))
    return F.when(single, d["lo", "lo"]).otherwise(F.least(*d.values()))


def _of_many(q: Groups, r: Groups, alone: bool, candidates: DataFrame | None) -> DataFrame | None:
    """q, r and least difference in contexts where a side has more than two objects; entries meet entries."""
    named = lambda df, side: df.select("ctx", F.col("sample_id").alias(side), F.col("obj").alias(f"{side}_obj"))
    parts = []
    if q.many is not None:
        parts.append(named(r.entries(), "r").join(small(named(q.many, "q"), q.n_many), "ctx"))
    if r.many is not None:
        few = named(replace(q, many=None, rows=q.rows.where("n <= 2")).entries(), "q")
        parts.append(few.join(small(named(r.many, "r"), r.n_many), "ctx"))
    if not parts:
        return None
    met = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if alone:
        met = met.where("r < q")
    if candidates is not None:
        met = met.join(candidates, ["q", "r"], "left_semi")
    return met.groupBy("ctx", "q", "r").agg(F.min(sections(F.col("q_obj"), F.col("r_obj"))).alias("d")).select("q", "r", "d")


def _gathered(entries: DataFrame, side: str, conflict_free: bool) -> DataFrame:
    """A row for each sample and context: its object, and all of its objects if it may have several."""
    named = entries.select(F.col("sample_id").alias(side), "ctx", F.col("obj").alias(f"{side}_obj"))
    if conflict_free:
        return named
    return named.groupBy("ctx", side).agg(F.min(f"{side}_obj").alias(f"{side}_obj"), F.collect_set(f"{side}_obj").alias(f"{side}_objs"))


def _of_entries(qry: DataFrame, ref: DataFrame | None, conflict_free: bool, ignore_conflicts: bool, wanted: DataFrame | None) -> DataFrame:
    """q, r and least difference in each context they share."""
    other = qry if ref is None else ref
    if ignore_conflicts:
        other = drop_conflicts(other)
    q, r = _gathered(qry, "q", conflict_free), _gathered(other, "r", conflict_free)
    met = q.join(r, "ctx") if wanted is None else wanted.join(q, "q").join(r, ["r", "ctx"])
    if ref is None:
        met = met.where("r < q")
    d = sections(F.col("q_obj"), F.col("r_obj"))
    if not conflict_free:
        every = F.flatten(F.transform("q_objs", lambda x: F.transform("r_objs", lambda y: sections(x, y))))
        d = F.when((F.size("q_objs") == 1) & (F.size("r_objs") == 1), d).otherwise(F.array_min(every))
    return met.select("q", "r", d.alias("d"))


def _of_groups(left: Groups, ref: Groups | None, ignore_conflicts: bool, wanted: DataFrame | None, tile: int) -> DataFrame:
    """The same of groups."""
    alone = ref is None and not ignore_conflicts
    right = left if ref is None else ref
    if ignore_conflicts:
        right = right.clean
    q = _side(left.rows if left.many is None else left.rows.where("n <= 2"), "q")
    r = _side(right.rows if right.many is None else right.rows.where("n <= 2"), "r")
    on = ["ctx"]
    if wanted is not None:
        met = wanted.join(q, "q").join(r, ["r", "ctx"])
    else:
        if max(left.n_samples, right.n_samples) > tile:
            both = _blocks(left.rows, tile, "bq")
            if not alone:
                both = both.join(_blocks(right.rows, tile, "br"), "ctx", "full")
            busy, seen = measured(both, "busy", rows=F.count("*"))
            if seen["rows"]:
                on = ["ctx", "_i", "_j"]
                q, r = (_self_tiled(q, "q", busy, seen["rows"]), _self_tiled(r, "r", busy, seen["rows"])) if alone else _tiled(q, r, busy, seen["rows"])
        met = q.join(r, on)
        if alone and len(on) > 1:
            met = met.where((F.col("_i") == F.col("_j")) | (F.col("_q_block") != F.col("_r_block")))
    if ref is None:
        met = met.where("r < q")
    each = met.select("q", "r", least_difference().alias("d"))
    more = _of_many(left, right, ref is None, wanted)
    return each if more is None else each.unionByName(more)


def pair_features(
    qry: DataFrame | Groups, ref: DataFrame | Groups | None = None, *, conflict_free: bool = False, ignore_conflicts: bool = False, tile: int | None = None, candidates: DataFrame | None = None, busy: bool = False
) -> DataFrame:
    """q, r, xny, n_diff, n_section and n_mut2 of all pairs that share a context.

    Without ``ref`` each pair of different samples of ``qry`` is taken once, with q > r. Where a
    context has several objects, the least difference counts. ``conflict_free`` states that
    neither side has such contexts. With ``candidates`` (q, r) only those pairs
    meet: each brings its query's entries to its reference's, so pairs that aren't candidates cost nothing. All pairs of samples with whole numbers meet by lists of contexts'
    entries, and by blocks in contexts that very many have (:mod:`meets`); a ``tile`` asks for groups in tiles, which others and null objects are met by, too, if a side is groups, and groups against groups, which are read as they lie.
    ``busy`` once asked for blocks; contexts are counted in any case now, and it changes nothing.
    """
    if candidates is None and tile is None and not (isinstance(qry, Groups) and isinstance(ref, Groups)):
        plain = lambda e: e.entries() if isinstance(e, Groups) else e
        left, right = plain(qry), None if ref is None else plain(ref)
        if ignore_conflicts:
            right = ref.clean.entries() if isinstance(ref, Groups) else drop_conflicts(left if right is None else right)
        made = meets.features(left, right)
        if made is not None:
            return made.where("r < q") if ref is None and ignore_conflicts else made
    wanted = None if candidates is None else candidates.select("q", "r").distinct()
    if tile is None and not isinstance(qry, Groups) and not isinstance(ref, Groups):
        each = _of_entries(qry, ref, conflict_free, ignore_conflicts, wanted)
    else:
        each = _of_groups(groups(qry, conflict_free), None if ref is None else groups(ref, conflict_free), ignore_conflicts, wanted, tile or TILE)
    return each.groupBy("q", "r").agg(
        F.count("*").alias("xny"),
        F.count_if(F.col("d") > 0).alias("n_diff"),
        F.sum("d").cast("long").alias("n_section"),
        F.count_if(F.col("d") > 1).alias("n_mut2"),
    )


def counted_contexts(entries: DataFrame | Groups) -> DataFrame:
    """sample_id and n_ctx, broadcast unless they are very many. Those of entries are written and counted first, so that no pair is shuffled to be joined with them."""
    if isinstance(entries, Groups):
        return small(entries.counts, entries.n_samples)
    counts, seen = measured(context_counts(entries), "counts", samples=F.count("*"))
    return small(counts, seen["samples"])


def with_fractions(pairs: DataFrame, qry: DataFrame | Groups, ref: DataFrame | Groups | None = None, ignore_conflicts: bool = False) -> DataFrame:
    """Pair features with both sides' context counts and aligned fractions."""
    short_methods(pairs.sparkSession)  # fractions are what distances are made of
    other = qry if ref is None else ref
    if ignore_conflicts:
        other = other.clean if isinstance(other, Groups) else drop_conflicts(other)
    q = counted_contexts(qry)
    r = q if other is qry else counted_contexts(other)
    side = lambda counts, name: counts.select(F.col("sample_id").alias(name), F.col("n_ctx").alias(f"{name}_ctx"))
    out = pairs.join(side(q, "q"), "q").join(side(r, "r"), "r")
    fraction = lambda c: F.col("xny") / F.col(c)
    return out.withColumns({"af_qry": fraction("q_ctx"), "af_ref": fraction("r_ctx")}).withColumn("max_af", F.greatest("af_qry", "af_ref"))


def exact_overlap(qry: DataFrame, ref: DataFrame | None = None, keys: tuple[str, ...] = ("ctx", "obj")) -> DataFrame:
    """Shared full keys of each pair (sample identifiers only, no objects compared)."""
    self_join = ref is None
    ref = qry if ref is None else ref
    q = qry.select(F.col("sample_id").alias("q"), *keys).distinct()
    r = ref.select(F.col("sample_id").alias("r"), *keys).distinct()
    met = q.join(r, list(keys))
    if self_join:
        met = met.where("r < q")
    return met.groupBy("q", "r").agg(F.count("*").alias("shared"))


def nominated(entries: DataFrame, min_votes: int = 1, max_frequency: int = 0, step: int = 1) -> DataFrame:
    """Candidate pairs (q > r) by votes of shared contexts; hot contexts are left out if ``max_frequency`` is given.

    ``step`` takes every n-th context of a sample. With (1, 0, 1) every pair that shares a context is a candidate.
    """
    contexts = entries.select("sample_id", "ctx").distinct()
    if max_frequency:
        rare = contexts.groupBy("ctx").agg(F.count("*").alias("_n")).where(F.col("_n") <= max_frequency).select("ctx")
        contexts = contexts.join(rare, "ctx", "left_semi")
    counted = contexts.withColumn("obj", F.lit(0).cast("long"))  # a context that is shared is a vote, whatever its objects
    some = None
    if step > 1:
        from pyspark.sql import Window

        some = counted.withColumn("_i", F.row_number().over(Window.partitionBy("sample_id").orderBy("ctx"))).where((F.col("_i") - 1) % step == 0).drop("_i")
    met = pair_features(counted) if some is None else pair_features(some, counted).where("r < q")
    return met.select("q", "r", F.col("xny").alias("votes")).where(F.col("votes") >= min_votes)
