"""Clusters and deduplication plans over an edge list.

Components: each task first contracts the edges it reads to a spanning star of each group it
sees, with its least node in the middle; alternating large-star and small-star steps, grouped minima and windows that stream over sorted neighbours,
then join the groups of all tasks. The edge list is never collected; each round is written to the
shared folder and replaces the last, so a lost executor costs at most a part of one round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sketchloom.session import discard, materialize, measured, numbered, small

#: Edges that a task contracts at a time.
CONTRACTED = 1_000_000


def stars(pairs: Iterator[tuple]) -> list[tuple]:
    """(node, least node of its group) of all nodes but the least ones, for the groups that some pairs join."""
    up: dict = {}

    def root(x):
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in list(up)]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of two columns as stars, of as many edges at a time as ``CONTRACTED``; for mapInArrow, or at the end of a function that makes edges."""
    held, schema = [], None

    def out() -> pa.RecordBatch:
        made = stars(held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], schema.field(i).type) for i in (0, 1)], schema=schema)

    for batch in batches:
        schema = batch.schema
        held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if len(held) >= CONTRACTED:
            yield out()
    if held:
        yield out()


def components(edges: DataFrame, a: str = "a", b: str = "b", contract: bool = True) -> DataFrame:
    """``id`` and ``comp`` of every node that is not its component's smallest; that one is ``comp``.

    Null ends and loops are left out. Ids may be numbers, text or binary. Edges that come out of :func:`contracted` need no second worker: ``contract=False``.
    Rounds go on until one changes nothing; their number grows with the logarithm of the largest component.
    """
    x, y = F.col(a), F.col(b)
    kind = edges.select(a).schema[0].dataType
    now = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    if contract:
        now = now.mapInArrow(contracted, StructType([StructField("u", kind), StructField("v", kind)]))
    state = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    now, before = measured(now.distinct(), "edges", **state)
    least = lambda: F.first("v").over(Window.partitionBy("u").orderBy("v"))
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    after = None if before["n"] else before
    while before != after:
        # a node's greater neighbours meet the least of it and its neighbours; a node of very many is pre-aggregated, and its join may be split ...
        ends = now.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.*").groupBy("u").agg(F.min("v").alias("m"))
        large = now.join(ends.select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "v").select("u", F.col("m").alias("v"))
        # ... and then its smaller neighbours the least of these, which are few
        near = large.select("u", "v", least().alias("m")).select(F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("e")).select("e.*").where("u <> v")
        old, after = now, before
        now, before = measured(near.distinct(), "edges", **state)
        discard(old)
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp"))


# --- quality order --------------------------------------------------------------------------


def quality_keys() -> list[Column]:
    """Sort keys, best sample first, over samples with ``meta`` fields, n_entries and sample_id.

    Metadata counts only where it is valid (version and a total length); a sample with it precedes all
    without. FASTA first, then assembly level, total length, fewer records (0 is worst), median length,
    smaller variation, more entries; at last the smaller sample id.
    """
    m = lambda c: F.when(F.col("meta_valid"), F.col(c))
    finite = lambda c, other: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(other)).otherwise(c)
    return [
        F.col("meta_valid").desc(),
        m("is_fasta").desc_nulls_last(),
        F.when(F.col("meta_valid"), finite(F.col("asm_level").cast("double"), -1.0)).desc_nulls_last(),
        m("total_length_bp").desc_nulls_last(),
        F.when(F.col("meta_valid"), F.when(F.col("record_count") > 0, F.col("record_count"))).asc_nulls_last(),
        m("median_length_bp").desc_nulls_last(),
        F.when(F.col("meta_valid"), finite(F.col("length_cv").cast("double"), float("inf"))).asc_nulls_last(),
        F.col("n_entries").desc(),
        F.col("sample_id").asc(),
    ]


def quality_rank(samples: DataFrame) -> DataFrame:
    """sample_id and its rank, 1 the best; keys are sorted in ranges."""
    keys = samples.select("sample_id", "meta_valid", "is_fasta", "asm_level", "total_length_bp", "record_count", "median_length_bp", "length_cv", "n_entries")
    return numbered(keys, quality_keys(), "_rank").select("sample_id", (F.col("_rank") + 1).cast("int").alias("rank"))


def clusters(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """Single-linkage clusters: sample, cluster number by first member, size and best member."""
    comps = components(edges.select(F.col("q").alias("a"), F.col("r").alias("b"))).select(F.col("id").alias("sample_id"), "comp")
    held = ranks.join(comps, "sample_id", "left").withColumn("comp", F.coalesce("comp", "sample_id"))
    each = held.groupBy("comp").agg(F.count("*").alias("component_size"), F.min_by("sample_id", "rank").alias("representative"))
    number = numbered(each, ["comp"], "_n").withColumn("cluster_id", F.format_string("cluster_%06d", F.col("_n") + 1)).drop("_n")
    return held.join(number, "comp").select("sample_id", "cluster_id", "component_size", "representative")


#: Undecided edges of one component that a task may settle in rank order, and the rounds before that.
ONE_TASK, QUICK_ROUNDS = 1_000_000, 4


def _in_order(open_: DataFrame) -> DataFrame:
    """Samples removed by one pass over each component's undecided edges in rank order.

    Edges are dealt by component and stream through a task, which holds the samples that one component has lost.
    """
    import pandas as pd

    def run(parts):
        comp, gone = None, set()
        for part in parts:
            out = []
            for c, better, worse in zip(part["comp"].tolist(), part["better"].tolist(), part["worse"].tolist(), strict=True):
                if c != comp:
                    comp, gone = c, set()
                if better not in gone and worse not in gone:  # all of its better neighbours came before
                    gone.add(worse)
                    out.append(worse)
            yield pd.DataFrame({"worse": out}, dtype="int64")

    dealt = open_.select("comp", F.col("better").cast("long"), F.col("worse").cast("long")).repartition("comp").sortWithinPartitions("comp", "better")
    return dealt.mapInPandas(run, "worse long")


def _round(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples kept, as no undecided one is better, and their neighbours, which are removed."""
    beaten = open_.select(F.col("worse").alias("n")).distinct()
    kept = open_.select(F.col("better").alias("n")).distinct().join(beaten, "n", "left_anti")
    gone = open_.join(kept.select(F.col("n").alias("better")), "better").select("worse").distinct()
    return kept, gone


def _parted(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undecided edges (comp, worse, better) of the components that a task can settle, and (worse, better) of the others."""
    comps = components(open_, "worse", "better")
    comps = comps.select(F.col("id").alias("better"), "comp").unionByName(comps.select(F.col("comp").alias("better"), "comp").distinct())
    held = materialize(open_.join(comps, "better"), "open-components")
    large = held.groupBy("comp").agg(F.count("*").alias("_n")).where(F.col("_n") > ONE_TASK).select("comp")
    return held.join(large, "comp", "left_anti"), held.join(large, "comp", "left_semi").select("worse", "better")


def greedy(ranks: DataFrame, edges: DataFrame, rounds: int = QUICK_ROUNDS) -> DataFrame:
    """Greedy deduplication in quality order, in parallel rounds.

    In each round every undecided sample without a better undecided neighbour is kept, and its
    undecided neighbours are removed. That is the sequential result: the first maximal independent set
    in quality order. A removed sample's representative is its best kept neighbour.

    A path whose quality falls along it settles one kept sample a round, so after ``rounds`` rounds each component of
    what is left is settled by a task in rank order. Components of more than ``ONE_TASK`` undecided edges go on by
    rounds, the same number each time before they are looked at again; as each round decides a sample at least, that ends.
    """
    rank = ranks.select("sample_id", "rank")
    a = rank.select(F.col("sample_id").alias("q"), F.col("rank").alias("q_rank"))
    b = rank.select(F.col("sample_id").alias("r"), F.col("rank").alias("r_rank"))
    ranked = edges.where("q <> r").select("q", "r").join(a, "q").join(b, "r").select(F.greatest("q_rank", "r_rank").alias("worse"), F.least("q_rank", "r_rank").alias("better")).distinct()
    ranked = materialize(ranked, "greedy-edges")
    open_, removed, parts = ranked, None, 0
    for turn in count(1):
        if open_.isEmpty():
            break
        if turn % (rounds + 1):
            kept, gone = _round(open_)
            gone = materialize(gone, "greedy-gone")
            # a kept sample has no undecided neighbour left
            rest = open_.join(kept.select(F.col("n").alias("better")), "better", "left_anti")
            out = gone.select(F.col("worse").alias("n"))
            rest = rest.join(out.select(F.col("n").alias("worse")), "worse", "left_anti").join(out.select(F.col("n").alias("better")), "better", "left_anti").select("worse", "better")
        else:
            fits, rest = _parted(open_)
            gone = materialize(_in_order(fits), "greedy-gone")
        removed, parts = (gone, 1) if removed is None else (removed.unionByName(gone), parts + 1)
        if parts == 100:  # or the plan would grow with the rounds
            removed, parts = materialize(removed.coalesce(8), "greedy-removed"), 1
        open_ = materialize(rest, "greedy-open")
    best = ranked.groupBy("worse").agg(F.min("better").alias("by"))  # without any removed sample there are no edges
    if removed is not None:
        best = ranked.join(removed.select(F.col("worse").alias("better")), "better", "left_anti").groupBy("worse").agg(F.min("better").alias("by"))
        best = best.join(removed.select("worse"), "worse", "left_semi")
    by = best.join(rank.select(F.col("rank").alias("by"), F.col("sample_id").alias("representative")), "by").select(F.col("worse").alias("rank"), "representative")
    return _plan(rank.join(by, "rank", "left"))


def _plan(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("action", F.when(F.col("representative").isNull(), "keep").otherwise("remove")).withColumn("representative", F.coalesce("representative", "sample_id"))
    sizes = out.groupBy("representative").agg(F.count("*").alias("component_size"))
    return out.join(small(sizes), "representative").select("sample_id", "action", "representative", "component_size")


def _cliques(parts):
    """For mapInPandas: rank and group of the samples that join one, of edges (comp, worse, better) that come sorted.

    A group is called after its first sample. A task holds the group of each sample of one component and the groups' sizes, no edges but one sample's.
    """
    import pandas as pd

    comp = worse = None
    group: dict[int, int] = {}
    size: dict[int, int] = {}
    held: list[int] = []
    out: list[tuple[int, int]] = []

    def decide() -> None:
        """The sample joins the first group whose every member is among its better neighbours."""
        met: dict[int, int] = {}
        for b in held:
            g = group.get(b, b)
            met[g] = met.get(g, 0) + 1
        whole = [g for g, n in met.items() if n == size.get(g, 1)]
        if whole:
            g = group[worse] = min(whole)
            size[g] = size.get(g, 1) + 1
            out.append((worse, g))

    for part in parts:
        for c, w, b in zip(part["comp"].tolist(), part["worse"].tolist(), part["better"].tolist(), strict=True):
            if w != worse or c != comp:
                if held:
                    decide()
                held = []
                worse = w
                if c != comp:
                    comp, group, size = c, {}, {}
            held.append(b)
        yield pd.DataFrame(out, columns=["rank", "by"]).astype("int64")
        out = []
    if held:
        decide()
    yield pd.DataFrame(out, columns=["rank", "by"]).astype("int64")


def _members(parts):
    """For mapInPandas: rank and leader of a leader's members, of edges (lead, worse, better) that come sorted, those to the leader included."""
    import pandas as pd

    lead = worse = None
    members: set[int] = set()
    near, out = 0, []

    def decide() -> None:
        if worse is not None and near == len(members):
            members.add(worse)
            out.append((worse, lead))

    for part in parts:
        for v, w, b in zip(part["lead"].tolist(), part["worse"].tolist(), part["better"].tolist(), strict=True):
            if w != worse or v != lead:
                decide()
                worse, near = w, 0
                if v != lead:
                    lead, members = v, {v}
            near += b in members
        yield pd.DataFrame(out, columns=["rank", "by"]).astype("int64")
        out = []
    decide()
    yield pd.DataFrame(out, columns=["rank", "by"]).astype("int64")


def _grown(inner: DataFrame) -> list[DataFrame]:
    """Members (rank, by) of leaders of very many edges, from edges (lead, worse, better) as :func:`_members` takes them.

    A candidate that has an edge to each better candidate of its leader joins, whichever of those do; candidates
    without an edge to one that has joined are out. Both are counts by candidate, so no task sees a leader's edges; places are taken in ranges.
    """
    out = []
    while not inner.isEmpty():
        # the leader's own edges come first, so a candidate's place from 1 is how many it has to have
        near = materialize(inner.groupBy("lead", "worse").agg(F.count("*").alias("near")), "linkage-near")
        place = numbered(near, ["lead", "worse"], "_n")
        first = place.groupBy("lead").agg(F.min("_n").alias("_first"))
        joined = place.join(first, "lead").where(F.col("near") == F.col("_n") - F.col("_first") + 1).select("lead", F.col("worse").alias("n"))
        joined = materialize(joined, "linkage-members")
        out.append(joined.select(F.col("n").alias("rank"), F.col("lead").alias("by")))
        ask = joined.groupBy("lead").agg(F.count("*").alias("_all"))
        # a better candidate that is still open has an edge to each worse one that joins, so both ends count
        up = inner.join(joined.withColumnRenamed("n", "better"), ["lead", "better"]).select("lead", F.col("worse").alias("n"))
        down = inner.join(joined.withColumnRenamed("n", "worse"), ["lead", "worse"]).select("lead", F.col("better").alias("n"))
        whole = up.unionByName(down).groupBy("lead", "n").agg(F.count("*").alias("_met")).join(ask, "lead").where("_met = _all").select("lead", "n")
        left = materialize(whole.where("n <> lead").join(joined, ["lead", "n"], "left_anti"), "linkage-left")
        ends = left.unionByName(left.select("lead", F.col("lead").alias("n")).distinct())
        rest = inner.join(left.withColumnRenamed("n", "worse"), ["lead", "worse"], "left_semi").join(ends.withColumnRenamed("n", "better"), ["lead", "better"], "left_semi")
        inner = materialize(rest.select("lead", "worse", "better"), "linkage-inner")
    return out


def _linked(open_: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """One round of full linkage over undecided edges: members (rank, by) of the groups that can be told now, and the edges left.

    A sample without a better neighbour leads a group. Its candidates are its neighbours, and no other group can have
    them first if it is the best neighbour of all of them; then its group is a matter of its candidates' edges alone.
    """
    best = materialize(open_.groupBy("worse").agg(F.min("better").alias("best")), "linkage-best")
    foreign = open_.join(best, "worse").where("better <> best").select(F.col("better").alias("lead"))
    cands = best.select("worse", F.col("best").alias("lead"))
    cands = cands.join(foreign.unionByName(best.select(F.col("worse").alias("lead"))).distinct(), "lead", "left_anti")
    cands = materialize(cands.select("lead", "worse"), "linkage-candidates")
    among = open_.join(cands, "worse").join(cands.select(F.col("lead").alias("_lead"), F.col("worse").alias("better")), "better").where("lead = _lead")
    inner = among.select("lead", "worse", "better").unionByName(cands.select("lead", "worse", F.col("lead").alias("better")))
    inner = materialize(inner, "linkage-inner")
    large = inner.groupBy("lead").agg(F.count("*").alias("_n")).where(F.col("_n") > ONE_TASK).select("lead")
    fits = inner.join(large, "lead", "left_anti").repartition("lead").sortWithinPartitions("lead", "worse", "better")
    out = [materialize(fits.mapInPandas(_members, "rank long, by long"), "linkage-groups"), *_grown(inner.join(large, "lead", "left_semi"))]
    done = cands.select(F.col("lead").alias("n")).distinct()
    for part in out:
        done = done.unionByName(part.select(F.col("rank").alias("n")))
    rest = open_.join(done.withColumnRenamed("n", "worse"), "worse", "left_anti").join(done.withColumnRenamed("n", "better"), "better", "left_anti")
    return out, materialize(rest.select("worse", "better"), "linkage-open")


def full_linkage(ranks: DataFrame, edges: DataFrame, rounds: int = QUICK_ROUNDS) -> DataFrame:
    """Clique deduplication in quality order: a sample joins the first group that it has an edge to every member of.

    Groups never cross components. The edges of a component stream through a task in the order of its samples' ranks. A component of
    more than ``ONE_TASK`` edges is settled in parallel rounds, group by group where groups don't depend on one another; after
    each ``rounds`` rounds what is left is parted into components again. The result is that of the sequential pass in all cases.
    """
    ranked = ranks.select("sample_id", "rank")
    q, r = (ranked.select(F.col("sample_id").alias(c), F.col("rank").cast("long").alias(f"{c}_rank")) for c in "qr")
    once = edges.where("q <> r").select("q", "r").join(q, "q").join(r, "r").select(F.greatest("q_rank", "r_rank").alias("worse"), F.least("q_rank", "r_rank").alias("better"))
    open_ = materialize(once.distinct(), "linkage-edges")
    joined: list[DataFrame] = []
    while not open_.isEmpty():
        fits, open_ = _parted(open_)
        joined.append(materialize(fits.repartition("comp").sortWithinPartitions("comp", "worse", "better").mapInPandas(_cliques, "rank long, by long"), "linkage-groups"))
        for _ in range(rounds):
            if open_.isEmpty():
                break
            made, open_ = _linked(open_)
            joined += made
        if len(joined) > 50:  # or the plan would grow with the rounds
            joined = [materialize(_union(joined).coalesce(8), "linkage-groups")]
    if not joined:
        return _plan(ranked.withColumn("representative", F.lit(None).cast(ranks.schema["sample_id"].dataType)))
    by = _union(joined).join(ranked.select(F.col("rank").alias("by"), F.col("sample_id").alias("representative")), "by").select("rank", "representative")
    return _plan(ranked.join(by, "rank", "left"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: What decided between a sample and its representative: label, field, whether more is better.
_RULES = (
    ("higher_asm_level", "asm_level", True),
    ("longer_total_length", "total_length_bp", True),
    ("fewer_records", "record_count", False),
    ("longer_median_length", "median_length_bp", True),
    ("lower_length_cv", "length_cv", False),
    ("more_sketch_entries", "n_entries", True),
)


def _rule() -> Column:
    """The first field in which a sample and its representative differ, named from the representative's side."""
    told = F.when(F.col("sample_id") == F.col("representative"), "self")
    told = told.when(F.col("sample_meta_valid") != F.col("rep_meta_valid"), F.when(F.col("rep_meta_valid"), "valid_metadata").otherwise("sample_valid_metadata"))
    for label, field, more in _RULES:
        own, rep = F.col(f"sample_{field}"), F.col(f"rep_{field}")
        better = rep > own if more else rep < own
        told = told.when(~own.eqNullSafe(rep), F.when(better, label).otherwise(f"sample_{label}"))
    return told.otherwise("sample_order")


def plan_report(plan: DataFrame, samples: DataFrame) -> DataFrame:
    """The deduplication plan's 21 columns, one row for each sample; groups are numbered by their first sample."""
    fields = ("fmt", "asm_level", "total_length_bp", "record_count", "median_length_bp", "length_cv")
    held = (*fields, "n_entries", "meta_valid")
    own = samples.select("sample_id", F.col("name").alias("sample"), *(F.col(c).alias(f"sample_{c}") for c in held))
    rep = samples.select(F.col("sample_id").alias("representative"), F.col("name").alias("representative_name"), *(F.col(c).alias(f"rep_{c}") for c in held))
    first = plan.groupBy("representative").agg(F.min("sample_id").alias("_first"))
    number = numbered(first, ["_first"], "_n").select("representative", F.format_string("cluster_%06d", F.col("_n") + 1).alias("component_id"))
    out = plan.join(small(number), "representative").join(own, "sample_id").join(rep, "representative")
    reason = F.when(F.col("component_size") == 1, "singleton").when(F.col("action") == "keep", "best_representative").otherwise("duplicate")
    return out.select(
        "sample", "component_id", "action", F.col("representative_name").alias("representative"), reason.alias("reason"), _rule().alias("rep_rule"), "component_size",
        F.col("sample_n_entries").alias("sample_sketch_entries"), F.col("rep_n_entries").alias("rep_sketch_entries"), *(f"sample_{c}" for c in fields), *(f"rep_{c}" for c in fields),
    )
