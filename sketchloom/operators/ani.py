"""The comparison report: distances, selection, filters, ranking, unique contexts, coverage, matrices."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.functions import distances as D
from sketchloom.functions.distances import Layout
from sketchloom.operators.entries import unique_owners
from sketchloom.operators.pairs import Groups, counted_contexts, pair_features, with_fractions
from sketchloom.session import BROADCAST_ROWS, bounded_batches, lean, materialize, numbered, small

NAMES = ("BestDist", "RecalDist", "CtxMoE", "Naive", "MashD", "AafD", "MashD_if_far", "AafD_if_far", "p_dist")


@dataclass(frozen=True)
class Options:
    """Selection and filters of a report; ``raw`` is for unassembled queries."""

    metric: int = 1
    afcut: float | None = None
    anicut: float = 0.95
    ctxcut: int = 3
    top: int | None = None
    raw: bool = False
    unified: bool = False
    raw_output: bool = False
    exception: float = 1.0
    max_diff_sections: int | None = None
    max_pdist: float | None = None
    ignore_conflicts: bool = False
    guard: bool = True

    def __post_init__(self):
        if not 1 <= self.metric <= len(NAMES):
            raise ValueError(f"metric is 1 to {len(NAMES)}")
        for name in ("afcut", "anicut", "max_pdist"):
            value = getattr(self, name)
            if value is not None and not 0.0 <= value <= 1.0:
                raise ValueError(f"{name} lies within 0..1")
        if self.top is not None and self.top < 1:
            raise ValueError("top is at least 1")

    @property
    def af(self) -> float:
        return (0.2 if self.raw else 0.5) if self.afcut is None else self.afcut


def base_distances(pairs: DataFrame, options: Options = Options(), layout: Layout = Layout()) -> DataFrame:
    """All base distances of pairs with aligned fractions; context distances are ``exception`` where the fraction fails."""
    ok = F.col("max_af") >= options.af
    far = F.lit(float(options.exception))
    out = pairs.withColumn("af_pass", ok)
    out = out.withColumns({
        "moe_dist": F.when(F.col("af_pass"), D.moe(layout)).otherwise(far),
        "naive_dist": F.when(F.col("af_pass"), D.naive(layout)).otherwise(far),
        "p_dist": F.when(F.col("af_pass"), D.p_dist(layout)).otherwise(far),
        "mash_dist": D.mash(layout),
        "aaf_dist": D.aaf(layout),
        "blastn_af_qry": D.blast_fraction("q_ctx", layout),
        "blastn_af_ref": D.blast_fraction("r_ctx", layout),
    })
    out = out.withColumn("raw_ani", 1 - (F.col("naive_dist") if options.raw else F.col("moe_dist")))
    known = F.lit(options.raw_output) | ~F.col("af_pass")
    learned = F.col("raw_ani") if options.raw else D.calibrated()
    out = out.withColumn("calibrated_ani", F.when(~known, learned))
    if "complete_like" not in out.columns:
        out = out.withColumn("complete_like", F.lit(False))
    guard, replaced = D.guarded(layout)
    if options.raw or options.raw_output or not options.guard:
        guard = F.lit(False)
    return out.withColumn("guarded", guard).withColumn("best_ani", F.when(F.col("guarded"), replaced).otherwise(F.col("calibrated_ani")))


def _available(ani: str) -> Column:
    return F.coalesce((F.col(ani) > 0) & (F.col(ani) <= 1), F.lit(False))


def selected(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """The reported metric: requested, or what it falls back to, with its distance, similarity and confidence."""
    s = options.metric
    if options.raw and not options.unified and s <= 4:
        effective = F.lit(4)
    elif options.raw or options.raw_output:
        effective = F.lit(3 if s <= 2 else s)
    elif s == 1:
        effective = F.when(_available("best_ani"), 1).when(_available("calibrated_ani"), 2).otherwise(3)
    elif s == 2:
        effective = F.when(_available("calibrated_ani"), 2).otherwise(3)
    else:
        effective = F.lit(s)
    out = rows.withColumn("metric_id", effective)
    far = lambda other: F.when(F.col("af_pass"), F.col("moe_dist")).otherwise(F.col(other))
    choices = [1 - F.col("best_ani"), 1 - F.col("calibrated_ani"), F.col("moe_dist"), F.col("naive_dist"), F.col("mash_dist"), F.col("aaf_dist"), far("mash_dist"), far("aaf_dist"), F.col("p_dist")]
    distance = F.coalesce(*(F.when(F.col("metric_id") == i + 1, c) for i, c in enumerate(choices)))
    label = F.element_at(F.array(*(F.lit(n) for n in NAMES)), F.col("metric_id"))
    by_model = F.when(identity(), "high").otherwise(D.confidence())
    if options.raw_output:
        confidence = F.lit("raw")
    elif options.raw and not options.unified and s <= 4:
        confidence = F.lit("unassembled")
    else:
        confidence = F.when((F.col("metric_id") == 1) & F.col("guarded"), "guarded_low_confidence").when(F.col("metric_id") <= 2, by_model).otherwise("raw")
    out = out.withColumns({"distance": distance, "metric": label, "confidence": confidence})
    return out.withColumn("ani", 1 - F.col("distance"))


def identity() -> Column:
    return D.identity_boundary()


def passing(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Aligned fraction, shared contexts, identity (inclusive) and the close filters."""
    keep = F.col("af_pass") & (F.col("xny") >= options.ctxcut) & (F.col("ani") >= options.anicut)
    if options.max_diff_sections is not None:
        keep &= F.col("n_section") <= options.max_diff_sections
    if options.max_pdist is not None:
        keep &= F.col("p_dist") <= options.max_pdist
    return rows.where(keep)


def ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    """Each query's rows by identity, then query fraction, then reference id; at most ``top`` of them."""
    order = Window.partitionBy("q").orderBy(F.desc("ani"), F.desc("af_qry"), F.asc("r"))
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if top is None else out.where(F.col("rank") <= top)


def detail(qry: DataFrame | Groups, ref: DataFrame | Groups | None = None, options: Options = Options(), layout: Layout = Layout(), **how) -> DataFrame:
    """The report of ``qry`` against ``ref`` (or against itself, each pair once)."""
    pairs = pair_features(qry, ref, ignore_conflicts=options.ignore_conflicts, **how)
    # what shares fewer contexts can't be reported, so it goes before anything is computed
    rows = with_fractions(pairs.where(F.col("xny") >= options.ctxcut), qry, ref, options.ignore_conflicts)
    return ranked(passing(selected(base_distances(rows, options, layout), options), options), options.top)


DETAIL = ("Qry", "Ref", "ANI", "Distance", "Confidence", "Selected_metric", "XnY_ctx", "Qry_align_fraction", "blastn_Qry_align_fraction", "Ref_align_fraction", "blastn_Ref_align_fraction", "N_diff_obj", "N_diff_obj_section", "N_mut2_ctx", "Ref_annotation")


def detail_columns(rows: DataFrame, q_samples: DataFrame, r_samples: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """The fifteen report columns, names and annotation joined on, and ``more`` columns of the rows."""
    r_samples = q_samples if r_samples is None else r_samples
    q = q_samples.select(F.col("sample_id").alias("q"), F.col("name").alias("Qry"))
    note = F.coalesce("annotation", F.lit("NA")) if "annotation" in r_samples.columns else F.lit("NA")
    r = r_samples.select(F.col("sample_id").alias("r"), F.col("name").alias("Ref"), note.alias("Ref_annotation"))
    named = rows.join(small(q), "q").join(small(r), "r")
    return named.select(
        "Qry", "Ref", F.col("ani").alias("ANI"), F.col("distance").alias("Distance"), F.col("confidence").alias("Confidence"), F.col("metric").alias("Selected_metric"), F.col("xny").alias("XnY_ctx"),
        F.col("af_qry").alias("Qry_align_fraction"), F.col("blastn_af_qry").alias("blastn_Qry_align_fraction"), F.col("af_ref").alias("Ref_align_fraction"), F.col("blastn_af_ref").alias("blastn_Ref_align_fraction"),
        F.col("n_diff").alias("N_diff_obj"), F.col("n_section").alias("N_diff_obj_section"), F.col("n_mut2").alias("N_mut2_ctx"), "Ref_annotation", *more,
    )


# --- adaptive unique contexts ---------------------------------------------------------------


_UNIQUE = ("u_xny", "u_n_diff", "u_n_section", "u_n_mut2", "u_ref")


def unique_features(qry: DataFrame, ref: DataFrame, options: Options = Options(raw=True, metric=4)) -> DataFrame:
    """Features of all pairs, with those from contexts that one reference alone has beside them (``u_``).

    A reference's unique contexts are decided over all references, before conflicts are ignored.
    """
    keys = ["q", "r"]
    full = with_fractions(pair_features(qry, ref, ignore_conflicts=options.ignore_conflicts), qry, ref, options.ignore_conflicts)
    owners = unique_owners(ref)
    own = ref.join(owners, ["ctx", "sample_id"], "left_semi")
    few = pair_features(qry, own, ignore_conflicts=options.ignore_conflicts).select(*keys, *(F.col(c).alias(f"u_{c}") for c in ("xny", "n_diff", "n_section", "n_mut2")))
    totals = counted_contexts(own).select(F.col("sample_id").alias("r"), F.col("n_ctx").alias("u_ref"))
    both = full.join(few, keys, "left").join(totals, "r", "left")
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in _UNIQUE})


def unique_context(qry: DataFrame, ref: DataFrame, options: Options = Options(raw=True, metric=4), layout: Layout = Layout()) -> DataFrame:
    """Naive identity from contexts that one reference alone has, where they are enough.

    Unique contexts are used if at least a twentieth of the reference's is shared. Gates stay on the full counts.
    """
    keys = ["q", "r"]
    both = unique_features(qry, ref, options).withColumn("unique_selected", (F.col("u_ref") > 0) & (F.col("u_xny") * 20 >= F.col("u_ref")))
    pick = {c: F.when(F.col("unique_selected"), F.col(f"u_{c}")).otherwise(F.col(c)) for c in ("xny", "n_diff", "n_section", "n_mut2")}
    scored = both.select(*keys, *(v.alias(k) for k, v in pick.items()), F.col("xny").alias("full_xny"), "q_ctx", "r_ctx", "af_qry", "af_ref", "max_af", "u_ref", "u_xny", "unique_selected")
    scored = scored.withColumn("distance", D.naive(layout)).withColumn("ani", 1 - F.col("distance")).withColumn("metric", F.when(F.col("unique_selected"), "NaiveUnique").otherwise("NaiveFull"))
    kept = scored.where((F.col("max_af") >= options.af) & (F.col("full_xny") >= options.ctxcut) & (F.col("ani") >= options.anicut))
    order = Window.partitionBy("q").orderBy(F.desc("ani"), F.asc("r"))
    out = kept.withColumn("rank", F.row_number().over(order))
    return out if options.top is None else out.where(F.col("rank") <= options.top)


def unique_report(qry: DataFrame, ref: DataFrame, q_samples: DataFrame, r_samples: DataFrame, options: Options = Options(raw=True, metric=4), layout: Layout = Layout()) -> DataFrame:
    """The diagnostic report of unique contexts: seventeen columns, one row for each pair that shares a context; nulls where nothing can be said."""
    rows = unique_features(qry, ref, options)
    few = rows.select("q", "r", F.col("u_xny").alias("xny"), F.col("u_n_diff").alias("n_diff"), F.col("u_n_section").alias("n_section"), F.col("u_n_mut2").alias("n_mut2"))
    scored = rows.join(few.where("xny > 0").select("q", "r", (1 - D.naive(layout)).alias("u_ani")), ["q", "r"], "left")
    q = q_samples.select(F.col("sample_id").alias("q"), F.col("name").alias("Qry"))
    r = r_samples.select(F.col("sample_id").alias("r"), F.col("name").alias("Ref"))
    share = lambda c: F.when(F.col(c) > 0, F.col("u_xny") / F.col(c))
    return scored.join(small(q), "q").join(small(r), "r").select(
        "Qry", "Ref", F.col("q_ctx").alias("Qry_ctx"), F.col("r_ctx").alias("Ref_ctx"), F.col("xny").alias("XnY_ctx"), F.col("n_diff").alias("N_diff_obj"), F.col("n_section").alias("N_diff_obj_section"), F.col("n_mut2").alias("N_mut2_ctx"),
        F.col("u_ref").alias("Unique_Ref_ctx"), F.col("u_xny").alias("Unique_XnY_ctx"), F.col("u_n_diff").alias("Unique_N_diff_obj"), F.col("u_n_section").alias("Unique_N_diff_obj_section"), F.col("u_n_mut2").alias("Unique_N_mut2_ctx"),
        F.col("u_ani").alias("Unique_ANI"), share("q_ctx").alias("Unique_QAF"), share("u_ref").alias("Unique_RAF"), share("r_ctx").alias("Unique_RAF_fullref"),
    )


# --- coverage -------------------------------------------------------------------------------


def coverage(rows: DataFrame, qry: DataFrame, ref: DataFrame, scope: str = "reference") -> DataFrame:
    """Coverage of each reported (q, r) by the query's counts at the reference's unique keys.

    ``scope`` is where a key must be unique: in the whole ``reference``, or among the references that
    the query's rows report (``reported``).
    """
    hit = materialize(rows.select("q", "r").distinct(), "hits")  # read several times below, and made once
    held = ref.select(F.col("sample_id").alias("r"), "ctx", "obj")
    # a key that one reference alone has is a marker in either scope
    single = held.groupBy("ctx", "obj").agg(F.min("r").alias("r"), F.count("*").alias("_n")).where("_n = 1").select("r", "ctx", "obj")
    counts = qry.select(F.col("sample_id").alias("q"), "ctx", "obj", F.col("cnt").alias("c"))
    per_ref = single.groupBy("r").agg(F.count("*").alias("_single"))
    seen = counts.join(single, ["ctx", "obj"]).select("q", "r", "c").join(hit, ["q", "r"], "left_semi")
    markers = hit.join(small(per_ref), "r", "left").select("q", "r", F.coalesce("_single", F.lit(0)).alias("ref_markers"))
    if scope == "reported":
        # other keys are markers where the query's rows report only one of their references. Keys that the same references have are
        # one set of owners, told apart by their number and two sums of hashes, so a query meets sets and not keys
        owners = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("r")).alias("x"), F.bit_xor(F.xxhash64("r", F.lit(1))).alias("y")]
        sets = materialize(held.distinct().groupBy("ctx", "obj").agg(*owners).where("n > 1"), "owners")
        own = ["n", "x", "y"]
        members = held.distinct().join(sets, ["ctx", "obj"]).groupBy(*own, "r").agg(F.count("*").alias("_keys"))
        alone = materialize(members.join(hit, "r").groupBy("q", *own).agg(F.min("r").alias("r"), F.count("*").alias("_hits"), F.min("_keys").alias("_keys")).where("_hits = 1").drop("_hits"), "alone")
        more = alone.groupBy("q", "r").agg(F.sum("_keys").alias("_more"))
        markers = markers.join(more, ["q", "r"], "left").select("q", "r", (F.col("ref_markers") + F.coalesce("_more", F.lit(0))).alias("ref_markers"))
        seen = seen.unionByName(counts.join(sets, ["ctx", "obj"]).join(alone, ["q", *own]).select("q", "r", "c"))
    elif scope != "reference":
        raise ValueError("scope is 'reference' or 'reported'")
    got = seen.groupBy("q", "r").agg(
        F.count("c").alias("observed_markers"), F.sum("c").alias("count_sum"), F.avg("c").alias("positive_mean_depth"),
        F.expr("percentile(c, 0.5)").alias("positive_median_depth"), F.stddev_pop("c").alias("_sd"),
    )
    out = markers.join(got, ["q", "r"], "left").na.fill(0, ["observed_markers", "count_sum", "positive_mean_depth", "positive_median_depth", "_sd"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    mass = F.sum("count_sum").over(Window.partitionBy("q"))
    return out.select(
        "q", "r", F.lit("refdb_unique_ctxobj_bitset" if scope == "reference" else "reported_unique_ctxobj_sum").alias("estimator"), "ref_markers", "observed_markers",
        share("observed_markers", "ref_markers").alias("observed_fraction"), F.col("count_sum").cast("long").alias("count_sum"), share("count_sum", "ref_markers").alias("estimated_depth"),
        "positive_mean_depth", "positive_median_depth", share("_sd", "positive_mean_depth").alias("count_cv"),
        F.when(mass > 0, F.col("count_sum") / mass).otherwise(0.0).alias("abundance_fraction"),
    )


COVERAGE = ("Coverage_estimator", "Coverage_ref_markers", "Coverage_observed_markers", "Coverage_observed_fraction", "Coverage_count_sum", "Estimated_depth", "Positive_mean_depth", "Positive_median_depth", "Count_CV", "Estimated_abundance_mass", "Estimated_abundance_fraction", "Abundance_fraction_scope")


def coverage_columns(rows: DataFrame, qry: DataFrame, ref: DataFrame, q_samples: DataFrame, r_samples: DataFrame, scope: str | None = "reference") -> DataFrame:
    """The fifteen report columns and the twelve of coverage.

    Without a ``scope``, or where the query has no counts, the estimator says why there is nothing and the others are null.
    """
    values = ("ref_markers", "observed_markers", "observed_fraction", "count_sum", "estimated_depth", "positive_mean_depth", "positive_median_depth", "count_cv", "count_sum", "abundance_fraction")
    if scope is not None and "cnt" in qry.columns:
        found = coverage(rows, qry, ref, scope)
        label = F.lit("refdb" if scope == "reference" else "reported_rows")
        told = found.select("q", "r", F.col("estimator").alias(COVERAGE[0]), *(F.col(v).alias(c) for v, c in zip(values, COVERAGE[1:-1], strict=True)), label.alias(COVERAGE[-1]))
        both = rows.join(told, ["q", "r"], "left")
    else:
        why = "NA:not_computed" if scope is None else "NA:query_missing_counts"
        both = rows.select("*", F.lit(why).alias(COVERAGE[0]), *(F.lit(None).cast("double").alias(c) for c in COVERAGE[1:-1]), F.lit(None).cast("string").alias(COVERAGE[-1]))
    return detail_columns(both, q_samples, r_samples, COVERAGE)


# --- matrices and edges ---------------------------------------------------------------------


#: Ids of samples that share a row of a matrix's frame.
_CHUNK = 4096


def _found(qry: DataFrame, metric: str, ref: DataFrame | None, layout: Layout, both: bool = True) -> DataFrame:
    """q, r and distance of the pairs that share contexts; of a side with itself in both directions, or with r < q."""
    pairs = with_fractions(pair_features(qry, ref), qry, ref)
    found = pairs.select("q", "r", F.least(F.lit(1.0), D.select(metric, layout)).alias("d"))
    if ref is not None or not both:
        return found
    ways = F.explode(F.array(F.struct("q", "r"), F.struct(F.col("r").alias("q"), F.col("q").alias("r"))))
    return found.select(ways.alias("w"), "d").select("w.q", "w.r", "d")


def _rows_of(qry: DataFrame, metric: str, layout: Layout, spots: DataFrame, n: int, kind: str, below: bool = False) -> DataFrame | None:
    """q, and the places and distances of all that it meets (or of those before it) and itself; a row for each query, the same everywhere: pairs that come by query aren't shuffled. None if they don't."""
    if n > BROADCAST_ROWS:  # joins would deal them anew
        return None
    met = pair_features(qry, qry)
    if not getattr(met, "by_query", False):
        return None
    pairs = with_fractions(met.where("r <= q") if below else met, qry, qry)
    far = F.when(F.col("q") == F.col("r"), 0.0).otherwise(F.coalesce(F.least(F.lit(1.0), D.select(metric, layout)), F.lit(1.0)))
    placed = pairs.select("q", "r", far.alias("d")).join(small(spots, n), "r").select("q", "at", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            at, d = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
            return pa.RecordBatch.from_arrays([now, one(at.astype(np.int64)), one(d)], names=["q", "at", "d"])

        for batch in batches:
            if not batch.num_rows:
                continue
            q, at, d = (np.asarray(c) for c in batch.columns)
            cuts = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1, len(q)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and q[a] != now[0].as_py():
                    yield done()
                    held = []
                now = batch.column(0).slice(a, 1)
                held.append((at[a:b].copy(), d[a:b].copy()))
        if held:
            yield done()

    made = placed.mapInArrow(lean(run), f"q {kind}, at array<long>, d array<double>")
    # a sample without contexts meets nothing, not even itself
    bare = _ids(qry).join(qry.where("ctx IS NOT NULL").select("sample_id").distinct(), "sample_id", "left_anti")
    return made.unionByName(bare.select(F.col("sample_id").alias("q"), F.lit(None).cast("array<long>").alias("at"), F.lit(None).cast("array<double>").alias("d")))


def _ids(entries: DataFrame) -> DataFrame:
    return entries.select("sample_id").where("sample_id IS NOT NULL").distinct()


def matrix_cells(qry: DataFrame, metric: str = "ctx-moe", ref: DataFrame | None = None, layout: Layout = Layout(), similarity: bool = False, diagonal: bool = True) -> DataFrame:
    """Dense cells (q, r, value) of all pairs; pairs without shared contexts have distance 1.

    A dense matrix has a cell for every pair; this is the one operator whose output is that large. Its cells are made where
    they are read. Of a side with itself a query's pairs come to one task in any case, and its cells are made there, so no pair is shuffled; else
    what is shuffled is the pairs that share contexts, and a row for each sample and ``_CHUNK`` ids.
    """
    bounded_batches(qry.sparkSession)
    self_join = ref is None
    places = materialize(numbered(_ids(qry if self_join else ref), ["sample_id"], "_at"), "places")
    chunk, at = F.floor(F.col("_at") / _CHUNK).cast("int"), (F.col("_at") % _CHUNK).cast("int")
    chunks = places.groupBy(chunk.alias("chunk")).agg(F.sort_array(F.collect_list("sample_id")).alias("ids"))
    kinds = dict(qry.dtypes)["sample_id"], dict((qry if self_join else ref).dtypes)["sample_id"]
    n = places.count()
    whole = _rows_of(qry, metric, layout, places.select(F.col("sample_id").alias("r"), F.col("_at").alias("at")), n, kinds[0]) if self_join else None
    if whole is not None:
        return _cells(_chunked(whole, n, kinds[0]).join(small(chunks, limit=1000), "chunk").select("q", "ids", "at", "d"), kinds, similarity, diagonal, True)
    spots = places.select(F.col("sample_id").alias("r"), chunk.alias("chunk"), at.alias("at"))
    held = _found(qry, metric, ref, layout).join(small(spots), "r").groupBy("q", "chunk").agg(F.collect_list("at").alias("at"), F.collect_list(F.coalesce("d", F.lit(1.0))).alias("d"))
    frame = _ids(qry).select(F.col("sample_id").alias("q")).crossJoin(small(chunks.select("chunk")))
    rows = frame.join(held, ["q", "chunk"], "left").join(small(chunks, limit=1000), "chunk").select("q", "ids", "at", "d")
    return _cells(rows, kinds, similarity, diagonal, self_join)


def _chunked(rows: DataFrame, n: int, kind: str) -> DataFrame:
    """A row for each query and chunk of ids, with places in the chunk and distances."""
    size = _CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, d = (c[k].values for c in (batch.column(1), batch.column(2)))
                at, d = (np.empty(0, dtype=np.int64), np.empty(0)) if at is None else (np.asarray(at), np.asarray(d))
                order = np.argsort(at)
                at, d = at[order], d[order]
                chunks = np.arange(-(-n // size))
                cuts = np.searchsorted(at, np.r_[chunks * size, n]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in ((at % size).astype(np.int32), d)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(chunks), k))), pa.array(chunks.astype(np.int32)), *lists], names=["q", "chunk", "at", "d"])

    return rows.mapInArrow(lean(run), f"q {kind}, chunk int, at array<int>, d array<double>")


def _cells(rows: DataFrame, kinds: tuple[str, str], similarity: bool, diagonal: bool, self_join: bool) -> DataFrame:
    """The cells of a query's chunks of ids; those that aren't at any of the places have distance 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, where = batch.column(1)[k].values, batch.column(2)[k].values
                d = np.ones(len(ids))
                if where is not None:
                    d[where.to_numpy()] = batch.column(3)[k].values.to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(ids), k))), ids, pa.array(d)], names=["q", "r", "d"])

    cells = rows.mapInArrow(lean(run), f"q {kinds[0]}, r {kinds[1]}, d double")
    if self_join:
        cells = cells.withColumn("d", F.when(F.col("q") == F.col("r"), 0.0).otherwise(F.col("d")))
        cells = cells if diagonal else cells.where("q <> r")
    return cells.select("q", "r", (1 - F.col("d") if similarity else F.col("d")).alias("value"))


def matrix_lines(qry: DataFrame, metric: str = "ctx-moe", layout: Layout = Layout(), separator: str = "\t", below: bool = False) -> DataFrame:
    """q and the line of its distances to all samples by id, or to those before it (``below``), which the first sample has none of.

    A line is made of the pairs that share contexts, and the others' distance in between; cells are no rows.
    """
    bounded_batches(qry.sparkSession)
    places = materialize(numbered(_ids(qry), ["sample_id"], "_at"), "places")
    n = places.count()
    spots = places.select(F.col("sample_id").alias("r"), F.col("_at").alias("at"))
    own = places.select(F.col("sample_id").alias("q"), "_at")
    whole = _rows_of(qry, metric, layout, spots, n, dict(qry.dtypes)["sample_id"], below)
    if whole is not None:
        rows = whole.join(small(own, n), "q").select("q", "_at", "at", "d")
        rows = rows.where("_at > 0") if below else rows
        return _lines(rows, n, separator, below, dict(qry.dtypes)["sample_id"])
    held = _found(qry, metric, None, layout, both=not below).join(small(spots, n), "r").groupBy("q").agg(F.collect_list("at").alias("at"), F.collect_list(F.coalesce("d", F.lit(1.0))).alias("d"))
    rows = own.join(held, "q", "left").select("q", "_at", "at", "d")
    rows = rows.where("_at > 0") if below else rows
    return _lines(rows, n, separator, below, dict(qry.dtypes)["sample_id"])


def _lines(rows: DataFrame, n: int, separator: str, below: bool, kind: str) -> DataFrame:
    """The lines of rows q, its place, and the places and distances of what it meets, itself or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, where = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                cells = ["1.000000"] * (own if below else n)
                for i, d in zip(where or (), batch.column(3)[k].as_py() or (), strict=True):
                    if i != own:
                        cells[i] = "%.6f" % d
                if not below:
                    cells[own] = "0.000000"
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([separator.join(cells)])], names=["q", "line"])

    return rows.mapInArrow(lean(run), f"q {kind}, line string")


def wide_matrix(cells: DataFrame, samples: list[int]) -> DataFrame:
    """Cells as one row for each query; for a few thousand samples at most, as columns are a plan's size."""
    return cells.groupBy("q").pivot("r", samples).agg(F.first("value"))


def lower_triangle(cells: DataFrame, diagonal: bool = False) -> DataFrame:
    """One line for each query: tab-joined values of the samples before it."""
    below = cells.where("r <= q" if diagonal else "r < q")
    text = F.format_string("%.6f", F.col("value"))
    lines = below.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", text.alias("v")))).alias("_cells"))
    return lines.select("q", F.array_join(F.transform("_cells", lambda c: c["v"]), "\t").alias("line"))


def phylip(cells: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of a square PHYLIP matrix (id of width 10, then values) and the map of ids to names."""
    ids = numbered(samples.select("sample_id", "name"), ["sample_id"], "_n").select("sample_id", "name", F.format_string("S%09d", F.col("_n") + 1).alias("ID"))
    if "line" in cells.columns:  # of :func:`matrix_lines`
        lines = cells.withColumnRenamed("line", "_line")
    else:
        made = F.array_sort(F.collect_list(F.struct("r", F.format_string("%.6f", F.col("value")).alias("v"))))
        lines = cells.groupBy("q").agg(made.alias("_cells")).select("q", F.array_join(F.transform("_cells", lambda c: c["v"]), " ").alias("_line"))
    text = F.concat(F.rpad("ID", 10, " "), F.lit(" "), "_line")
    return lines.join(small(ids), lines["q"] == ids["sample_id"]).select("q", text.alias("line")), ids.select("ID", F.col("name").alias("Sample"))


def edges(entries: DataFrame, metric: str = "ctx-moe", cut: float = 0.05, ctxcut: int = 3, max_afcut: float = 0.8, layout: Layout = Layout(), candidates: DataFrame | None = None) -> DataFrame:
    """Sparse edges of a self comparison: distance below ``cut``, enough shared contexts and aligned fraction.

    Where ``candidates`` (q, r) are given, only those pairs are scored, exactly.
    """
    pairs = pair_features(entries, candidates=candidates).where(F.col("xny") >= ctxcut)
    rows = with_fractions(pairs, entries).where(F.col("max_af") >= max_afcut)
    return rows.withColumn("distance", D.select(metric, layout)).where(F.col("distance") < cut).withColumn("similarity", 1 - F.col("distance")).withColumn("metric", F.lit(metric))
