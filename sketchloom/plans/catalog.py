"""All queries of the library by name, with the DuckDB SQL that gives the same rows.

Names start with the number of the operator in the inventory. Doubles are rounded to nine digits on
both sides, as the engines' ``pow`` and ``ln`` may differ in the last bit.
"""

from __future__ import annotations

import uuid
from types import SimpleNamespace

from pyspark.sql import Window
from pyspark.sql import functions as F

from sketchloom.functions import bits
from sketchloom.functions import distances as D
from sketchloom.operators import ani, entries, graph, legacy, pairs, place, profile, setops
from sketchloom.operators.ani import Options
from sketchloom.operators.tokenize import recovered, tokenized
from sketchloom.plans import counts, files, placement, sequences  # noqa: F401  they register queries of their own
from sketchloom.plans import sketching
from sketchloom.plans import sql as S
from sketchloom.plans import views as V
from sketchloom.plans.registry import QUERIES, SQL, Query, query, r9
from sketchloom.session import scratch_path, table

def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


L = V.SUPP_LAYOUT
KERNEL = f"WITH {S.SUPP}, {S.kernel('supp')}, {S.fractions('supp')}"
FEATURES = ("q", "r", "xny", "n_diff", "n_section", "n_mut2")
FEATURE_LIST = ", ".join(FEATURES)

# --- flagship --------------------------------------------------------------------------------


@query(
    "entry_top_hits",
    f"""{KERNEL}, d AS (SELECT *, {S.NAIVE} AS dist FROM f WHERE xny >= 3 AND max_af >= 0.2),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY q ORDER BY 1 - dist DESC, af_qry DESC, r) AS rank FROM d WHERE 1 - dist >= 0.5)
SELECT {FEATURE_LIST}, {S.r9('af_qry')} AS af_qry, {S.r9('af_ref')} AS af_ref, {S.r9('dist')} AS distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""",
)
def entry_top_hits(spark, d):
    rows = ani.detail(V.supp(spark, d), None, Options(metric=4, raw=True, anicut=0.5, top=5), L)
    return rows.select(*FEATURES, r9("af_qry").alias("af_qry"), r9("af_ref").alias("af_ref"), r9("distance").alias("distance"), "rank")


# --- entries: A1-A4, A6, A8-A10, P3, P6-P8, P11-P13 -------------------------------------------


@query("a1_distinct_entries", "SELECT DISTINCT l_suppkey AS sample_id, l_partkey AS ctx, CAST(l_quantity AS BIGINT) AS obj FROM lineitem")
def a1(spark, d):
    return entries.distinct_entries(V.raw_supp(spark, d))


@query("a2_a3_counts_positions", f"WITH {S.SUPP} SELECT * FROM supp")
def a2(spark, d):
    return V.supp(spark, d)


@query("a4_context_counts", "SELECT l_suppkey AS sample_id, COUNT(DISTINCT l_partkey) AS n_ctx FROM lineitem GROUP BY 1")
def a4(spark, d):
    return entries.context_counts(V.supp(spark, d))


@query("a5_pair_features", f"WITH {S.SUPP}, {S.kernel('supp')} SELECT * FROM pairs")
def a5(spark, d):
    return pairs.pair_features(V.supp(spark, d))


@query("a5_pair_features_salted", f"WITH {S.SUPP}, {S.kernel('supp')} SELECT * FROM pairs")
def a5_salted(spark, d):
    return pairs.pair_features(V.supp(spark, d), tile=7)


@query("a5_conflict_free", f"WITH {S.SUPP}, {S.CLEAN}, {S.kernel('clean')} SELECT * FROM pairs")
def a5_free(spark, d):
    return pairs.pair_features(entries.drop_conflicts(V.supp(spark, d)), conflict_free=True)


@query("j3_query_reference_features", f"WITH {S.SUPP}, {S.CUST}, {S.kernel('cust', 'supp')} SELECT * FROM pairs")
def j3(spark, d):
    return pairs.pair_features(V.cust(spark, d), V.supp(spark, d))


@query("j2_stored_index", f"WITH {S.SUPP}, {S.CUST}, {S.kernel('cust', 'supp')} SELECT * FROM pairs")
def j2(spark, d):
    """Against a stored reference, bucketed by context."""
    name = f"sketchloom_{uuid.uuid4().hex}"
    pairs.write_index(name, V.supp(spark, d), 16, scratch_path(spark, "index"))
    return pairs.pair_features(V.cust(spark, d), pairs.read_index(spark, name))


@query("p19_ignore_conflicts", f"WITH {S.SUPP}, {S.CUST}, {S.CLEAN}, {S.kernel('cust', 'clean')} SELECT * FROM pairs")
def p19(spark, d):
    return pairs.pair_features(V.cust(spark, d), V.supp(spark, d), ignore_conflicts=True)


@query(
    "a6_input_metadata",
    """WITH x AS (SELECT l_suppkey AS sample_id, CAST(l_quantity AS BIGINT) AS n FROM lineitem)
SELECT sample_id, CAST(SUM(n) AS BIGINT) AS total_length_bp, COUNT(*) AS record_count, CAST(FLOOR(quantile_cont(n, 0.5)) AS BIGINT) AS median_length_bp,
ROUND(MAX(n) / SUM(n), 9) AS asm_level, ROUND(CASE WHEN COUNT(*) > 1 THEN stddev_pop(n) / AVG(n) ELSE 0 END, 9) AS length_cv FROM x GROUP BY 1""",
)
def a6(spark, d):
    m = entries.metadata(V.records(spark, d))
    return m.select("sample_id", "total_length_bp", "record_count", "median_length_bp", r9("asm_level").alias("asm_level"), r9("length_cv").alias("length_cv"))


@query("a8_unique_union", f"WITH {S.SUPP} SELECT ctx, obj FROM supp GROUP BY 1, 2 HAVING COUNT(*) = 1")
def a8(spark, d):
    return setops.unique_union(V.supp(spark, d))


@query("a9_unique_markers", f"WITH {S.SUPP} SELECT sample_id, ctx, obj, COUNT(*) OVER (PARTITION BY ctx, obj) = 1 AS is_unique FROM supp")
def a9(spark, d):
    return entries.mark_unique(V.supp(spark, d)).select("sample_id", "ctx", "obj", "is_unique")


@query("a10_unique_owners", f"WITH {S.RORD} SELECT ctx, MIN(sample_id) AS sample_id FROM rord GROUP BY 1 HAVING MIN(sample_id) = MAX(sample_id)")
def a10(spark, d):
    return entries.unique_owners(V.rord(spark, d))


@query("p3_sampled_contexts", f"WITH {S.SUPP}, {S.MIX} SELECT sample_id, ctx, obj, cnt, pos FROM h WHERE (x & 4294967295::UBIGINT) <= {0xFFFFFFFF >> 2}::UBIGINT")
def p3(spark, d):
    return bits.sampled(V.supp(spark, d), "ctx", 2)


@query("p1_p4_tokenized", f"WITH {S.TOKENS} SELECT sample_id, ctx, obj, COUNT(*) AS cnt, MIN(pos) AS pos FROM t GROUP BY 1, 2, 3")
def p1_p4(spark, d):
    return entries.counted(tokenized(V.genomes(spark, d), V.KMERS))


@query("p5_recovered_kmers", f"WITH {S.TOKENS} SELECT DISTINCT sample_id, kmer, reverse(translate(kmer, 'ACGT', 'TGCA')) AS reverse_complement FROM t")
def p5(spark, d):
    return recovered(entries.distinct_entries(tokenized(V.genomes(spark, d), V.KMERS)), V.KMERS)


@query("p6_min_occurrence", f"WITH {S.SUPP} SELECT * FROM supp WHERE cnt >= 2")
def p6(spark, d):
    return entries.count_filter(V.supp(spark, d), least=2)


_PCT = """h AS (SELECT sample_id, cnt, CAST(COUNT(*) * cnt AS BIGINT) AS mass FROM size GROUP BY 1, 2),
w AS (SELECT *, SUM(mass) OVER (PARTITION BY sample_id ORDER BY cnt) AS upto, GREATEST(1, CEIL(0.97::DOUBLE * SUM(mass) OVER (PARTITION BY sample_id))) AS rank FROM h),
c AS (SELECT sample_id, MIN(cnt) AS cutoff FROM w WHERE upto >= rank GROUP BY 1)"""


@query("p7_percentile_filter", f"WITH {S.SIZE}, {_PCT} SELECT size.* FROM size JOIN c USING (sample_id) WHERE cnt >= cutoff")
def p7(spark, d):
    return entries.count_filter(V.size(spark, d), percentile=0.97)


@query("p8_capped_cutoff", f"WITH {S.SIZE}, {_PCT} SELECT size.* FROM size JOIN c USING (sample_id) WHERE cnt >= LEAST(cutoff, 2)")
def p8(spark, d):
    return entries.count_filter(V.size(spark, d), percentile=0.97, cap=2)


@query("p11_conflict_drop", f"WITH {S.SUPP}, {S.CLEAN} SELECT * FROM clean")
def p11(spark, d):
    return entries.drop_conflicts(V.supp(spark, d))


@query(
    "p6_p11_filter_before_conflicts",
    f"WITH {S.SUPP}, two AS (SELECT * FROM supp WHERE cnt >= 2) SELECT * FROM two WHERE (sample_id, ctx) IN (SELECT (sample_id, ctx) FROM (SELECT sample_id, ctx FROM two GROUP BY 1, 2 HAVING COUNT(*) = 1))",
)
def p6_p11(spark, d):
    return entries.finalize(V.raw_supp(spark, d), least=2)


_NATION = "SELECT s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"


def _asian(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region").where("r_name = 'ASIA'")
    s = table(spark, d, "supplier")
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("s_name").alias("name"))


@query("p12_keep_samples", f"WITH {S.SUPP} SELECT * FROM supp WHERE sample_id IN (SELECT s_suppkey FROM supplier WHERE s_name IN ({_NATION}))")
def p12_keep(spark, d):
    return entries.keep_samples(V.supp(spark, d), V.supp_samples(spark, d), _asian(spark, d))


@query("p12_remove_samples", f"WITH {S.SUPP} SELECT * FROM supp WHERE sample_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_name IN ({_NATION}))")
def p12_remove(spark, d):
    return entries.remove_samples(V.supp(spark, d), V.supp_samples(spark, d), _asian(spark, d))


@query("p13_drop_position", f"WITH {S.SUPP} SELECT sample_id, ctx, obj, cnt FROM supp")
def p13(spark, d):
    return entries.drop_positions(V.supp(spark, d))


# --- distances: D1-D8, D11-D15 ----------------------------------------------------------------


@query(
    "d1_d7_base_distances",
    f"""{KERNEL} SELECT {FEATURE_LIST}, {S.r9(S.NAIVE)} AS naive, {S.r9(S.p_dist())} AS p_dist, {S.r9(S.MOE)} AS moe, {S.r9(S.MASH)} AS mash, {S.r9(S.AAF)} AS aaf,
{S.r9(S.blast('q_ctx'))} AS blast_qry, {S.r9(S.blast('r_ctx'))} AS blast_ref FROM f""",
)
def d_base(spark, d):
    e = V.supp(spark, d)
    f = pairs.with_fractions(pairs.pair_features(e), e)
    return f.select(*FEATURES, r9(D.naive(L)).alias("naive"), r9(D.p_dist(L)).alias("p_dist"), r9(D.moe(L)).alias("moe"), r9(D.mash(L)).alias("mash"), r9(D.aaf(L)).alias("aaf"), r9(D.blast_fraction("q_ctx", L)).alias("blast_qry"), r9(D.blast_fraction("r_ctx", L)).alias("blast_ref"))


def _if_far(metric: int, other: str) -> tuple[str, Query]:
    sql = f"""{KERNEL} SELECT q, r, CASE WHEN max_af >= 0.3 THEN {S.r9(S.MOE)} ELSE {S.r9(other)} END AS distance,
CASE WHEN max_af >= 0.3 THEN {S.r9(S.NAIVE)} ELSE 1.0 END AS naive FROM f"""

    def run(spark, d):
        e = V.supp(spark, d)
        o = Options(metric=metric, afcut=0.3)
        rows = ani.selected(ani.base_distances(pairs.with_fractions(pairs.pair_features(e), e), o, L), o)
        return rows.select("q", "r", r9("distance").alias("distance"), r9("naive_dist").alias("naive"))

    return sql, run


for _name, _metric, _other in (("d8_mash_if_far", 7, S.MASH), ("d8_d13_aaf_if_far", 8, S.AAF)):
    _sql, _run = _if_far(_metric, _other)
    query(_name, _sql)(_run)


_SIZED = f"WITH {S.SIZE}, {S.kernel('size')}, {S.fractions('size')}"
_IDENTICAL = "xny > 0 AND n_diff = 0 AND af_qry = 1 AND af_ref = 1"


def _sized(spark, d):
    e = V.size(spark, d)
    return pairs.with_fractions(pairs.pair_features(e, busy=True), e)


@query(
    "d12_metric_fallback",
    f"""{_SIZED} SELECT q, r, CASE WHEN {_IDENTICAL} THEN 'BestDist' ELSE 'CtxMoE' END AS metric,
CASE WHEN max_af < 0.5 THEN 1.0 ELSE {S.r9(S.MOE)} END AS distance, CASE WHEN {_IDENTICAL} THEN 'high' ELSE 'raw' END AS confidence FROM f""",
)
def d12(spark, d):
    rows = ani.selected(ani.base_distances(_sized(spark, d), Options(), L), Options())
    return rows.select("q", "r", "metric", r9("distance").alias("distance"), "confidence")


@query(
    "d9_d11_calibrated",
    f"""{_SIZED}, c AS (SELECT *, 1 - {S.MOE} AS raw, CASE WHEN {_IDENTICAL} THEN 1.0 ELSE 1 - {S.MOE} - 0.2 * (n_section / xny) END AS cal FROM f)
SELECT q, r, {S.r9('1 - cal')} AS distance, {S.r9('raw')} AS raw_ani,
CASE WHEN {_IDENTICAL} THEN 'high' WHEN af_ref < 0.5 OR (raw >= 0.95 AND raw - cal > 0.02) THEN 'low' WHEN abs(raw - cal) > 0.01 THEN 'medium' ELSE 'high' END AS confidence FROM c""",
)
def d9_d11(spark, d):
    """With a calibrator that takes off a part of the differing sections; what a learned model would give is the caller's."""
    before = D.set_calibrator(lambda: F.col("raw_ani") - 0.2 * (F.col("n_section") / F.col("xny")))
    try:
        rows = ani.selected(ani.base_distances(_sized(spark, d), Options(metric=2), L), Options(metric=2))
    finally:
        D.set_calibrator(before)
    return rows.select("q", "r", r9("distance").alias("distance"), r9("raw_ani").alias("raw_ani"), "confidence")


_PART = f"part AS (SELECT * FROM size WHERE ctx <= 15 + sample_id % 30), {S.kernel('size', 'part')}, {S.fractions('size', 'part')}"
_SAME = "(GREATEST(0, xny - n_diff))"
_CLOSE = f"((1 - ({S.MASH}) + 1 - ({S.AAF}) + 1 - ({S.MASH.replace('xny', _SAME)}) + 1 - ({S.AAF.replace('xny', _SAME)})) / 4)"


@query(
    "d10_best_guarded",
    f"""WITH {S.SIZE}, {_PART}, c AS (SELECT *, 1 - {S.MOE} AS raw, CASE WHEN {_IDENTICAL} THEN 1.0 ELSE 1 - {S.MOE} - 0.02 * (n_section / xny) END AS cal FROM f),
g AS (SELECT *, q % 2 = 0 AND NOT ({_IDENTICAL}) AND raw >= 0.958 AND cal >= 0.962 AND LEAST(af_qry, af_ref) >= 0.25 AND LEAST(af_qry, af_ref) < 0.5 AND raw - {_CLOSE} >= 0.015 AS guarded, 1 - ({S.AAF.replace('xny', _SAME)}) AS safe FROM c)
SELECT q, r, CASE WHEN guarded AND safe > 0 OR cal > 0 THEN 'BestDist' ELSE 'CtxMoE' END AS metric, {S.r9('CASE WHEN guarded AND safe > 0 THEN 1 - safe WHEN cal > 0 THEN 1 - cal ELSE 1 - raw END')} AS distance, guarded,
CASE WHEN NOT (cal > 0) THEN 'raw' WHEN guarded THEN 'guarded_low_confidence' WHEN {_IDENTICAL} THEN 'high' WHEN af_ref < 0.5 OR (raw >= 0.95 AND raw - cal > 0.02) THEN 'low' WHEN abs(raw - cal) > 0.01 THEN 'medium' ELSE 'high' END AS confidence FROM g""",
)
def d10(spark, d):
    """Complete-like queries (every second) against parts of suppliers: where the guard holds, the calibrated identity is replaced."""
    e = V.size(spark, d)
    part = e.where(F.col("ctx") <= 15 + F.col("sample_id") % 30)
    met = pairs.with_fractions(pairs.pair_features(e, part, busy=True), e, part).withColumn("complete_like", F.col("q") % 2 == 0)
    before = D.set_calibrator(lambda: F.col("raw_ani") - 0.02 * (F.col("n_section") / F.col("xny")))
    try:
        rows = ani.selected(ani.base_distances(met, Options(afcut=0.0), L), Options(afcut=0.0))
    finally:
        D.set_calibrator(before)
    return rows.select("q", "r", "metric", r9("distance").alias("distance"), "guarded", "confidence")


for _label, _expr, _fn in (("d14_metric_and", "ctx-naive&aaf", "GREATEST"), ("d14_metric_or", "mash|p_dist", "LEAST")):
    _parts = (S.NAIVE, S.AAF) if _fn == "GREATEST" else (S.MASH, S.p_dist())

    def _run(spark, d, expr=_expr):
        e = V.supp(spark, d)
        return pairs.with_fractions(pairs.pair_features(e), e).select("q", "r", r9(D.select(expr, L)).alias("distance"))

    query(_label, f"{KERNEL} SELECT q, r, {_fn}({S.r9(_parts[0])}, {S.r9(_parts[1])}) AS distance FROM f")(_run)


# --- reports: P14-P18, O2, O3, K3-K8, K14 -----------------------------------------------------


@query(
    "k3_detail_report",
    f"""{KERNEL}, d AS (SELECT *, {S.MOE} AS dist FROM f WHERE xny >= 3 AND max_af >= 0.2)
SELECT a.s_name AS "Qry", b.s_name AS "Ref", {S.r9('1 - dist')} AS "ANI", {S.r9('dist')} AS "Distance", 'raw' AS "Confidence", 'CtxMoE' AS "Selected_metric", xny AS "XnY_ctx",
{S.r9('af_qry')} AS "Qry_align_fraction", {S.r9(S.blast('q_ctx'))} AS "blastn_Qry_align_fraction", {S.r9('af_ref')} AS "Ref_align_fraction", {S.r9(S.blast('r_ctx'))} AS "blastn_Ref_align_fraction",
n_diff AS "N_diff_obj", n_section AS "N_diff_obj_section", n_mut2 AS "N_mut2_ctx", 'NA' AS "Ref_annotation"
FROM d JOIN supplier a ON a.s_suppkey = q JOIN supplier b ON b.s_suppkey = r""",
)
def k3(spark, d):
    rows = ani.detail(V.supp(spark, d), None, Options(metric=3, afcut=0.2, anicut=0.0), L)
    out = ani.detail_columns(rows, V.supp_samples(spark, d))
    return out.select(*(r9(c).alias(c) if t == "double" else c for c, t in out.dtypes))


@query(
    "p17_close_filters",
    f"""{KERNEL} SELECT q, r, n_section, {S.r9(S.p_dist())} AS p_dist FROM f WHERE xny >= 3 AND max_af >= 0.1 AND n_section <= 275 AND {S.p_dist()} <= 0.69""",
)
def p17(spark, d):
    o = Options(metric=9, afcut=0.1, anicut=0.0, max_diff_sections=275, max_pdist=0.69)
    return ani.detail(V.supp(spark, d), None, o, L).select("q", "r", "n_section", r9("p_dist").alias("p_dist"))


@query(
    "k8_edges",
    f"""{KERNEL} SELECT q AS "Qry", r AS "Ref", {S.r9(S.NAIVE)} AS "Distance", {S.r9(f'1 - ({S.NAIVE})')} AS "Similarity", 'ctx-naive' AS "Metric", xny AS "XnY_ctx", {S.r9('af_qry')} AS "Qry_align_fraction",
{S.r9('af_ref')} AS "Ref_align_fraction", {S.r9('max_af')} AS "max_AF", n_diff AS "N_diff_obj", n_section AS "N_diff_obj_section", n_mut2 AS "N_mut2_ctx" FROM f WHERE {S.NAIVE} < 0.12 AND xny >= 3 AND max_af >= 0.25""",
)
def k8(spark, d):
    e = ani.edges(V.supp(spark, d), "ctx-naive", 0.12, 3, 0.25, L)
    names = {"q": "Qry", "r": "Ref", "distance": "Distance", "similarity": "Similarity", "metric": "Metric", "xny": "XnY_ctx", "af_qry": "Qry_align_fraction", "af_ref": "Ref_align_fraction", "max_af": "max_AF", "n_diff": "N_diff_obj", "n_section": "N_diff_obj_section", "n_mut2": "N_mut2_ctx"}
    return e.select(*((r9(k) if t == "double" else F.col(k)).alias(names[k]) for k, t in e.select(*names).dtypes))


_CELLS = f"""{KERNEL}, s AS (SELECT DISTINCT sample_id FROM supp), v AS (SELECT q, r, LEAST(1, {S.NAIVE}) AS d FROM f),
c AS (SELECT a.sample_id AS q, b.sample_id AS r, CASE WHEN a.sample_id = b.sample_id THEN 0 ELSE coalesce(v.d, 1) END AS value
FROM s a CROSS JOIN s b LEFT JOIN v ON v.q = GREATEST(a.sample_id, b.sample_id) AND v.r = LEAST(a.sample_id, b.sample_id))"""


@query("k5_dense_matrix", f"{_CELLS} SELECT q, r, {S.r9('value')} AS value FROM c")
def k5(spark, d):
    return ani.matrix_cells(V.supp(spark, d), "ctx-naive", layout=L).select("q", "r", r9("value").alias("value"))


_NATIONS = range(25)


@query("k5_wide_matrix", f"WITH {S.NAT}, {S.kernel('nat')}, half AS (SELECT q, r, LEAST(1, {S.NAIVE}) AS d FROM pairs), met AS (SELECT q, r, d FROM half UNION ALL SELECT r, q, d FROM half), ids AS (SELECT DISTINCT sample_id AS id FROM nat), c AS (SELECT a.id AS q, b.id AS r, CASE WHEN a.id = b.id THEN 0 ELSE coalesce(d, 1) END AS value FROM ids a CROSS JOIN ids b LEFT JOIN met ON met.q = a.id AND met.r = b.id) SELECT q, "
    + ", ".join(f'MAX({S.r9("value")}) FILTER (r = {n}) AS "{n}"' for n in _NATIONS) + " FROM c GROUP BY q")
def k5_wide(spark, d):
    """A row for each nation, a column for each."""
    cells = ani.matrix_cells(V.nat(spark, d), "ctx-naive", layout=L)
    return ani.wide_matrix(cells.select("q", "r", r9("value").alias("value")), list(_NATIONS))


@query("k6_lower_triangle", f"{_CELLS} SELECT q, string_agg(printf('%.6f', value), chr(9) ORDER BY r) AS line FROM c WHERE r < q GROUP BY q")
def k6(spark, d):
    return ani.matrix_lines(V.supp(spark, d), "ctx-naive", L, below=True)


_PHYLIP = f"{_CELLS}, ids AS (SELECT s_suppkey AS q, s_name AS name, printf('S%09d', ROW_NUMBER() OVER (ORDER BY s_suppkey)) AS id FROM supplier)"


@query("k7_phylip_lines", f"{_PHYLIP} SELECT q, rpad(MAX(id), 10, ' ') || ' ' || string_agg(printf('%.6f', value), ' ' ORDER BY r) AS line FROM c JOIN ids USING (q) GROUP BY q")
def k7(spark, d):
    return ani.phylip(ani.matrix_lines(V.supp(spark, d), "ctx-naive", L, " "), V.supp_samples(spark, d))[0]


@query("k7_phylip_ids", f"{_PHYLIP} SELECT id AS \"ID\", name AS \"Sample\" FROM ids")
def k7_ids(spark, d):
    return ani.phylip(ani.matrix_lines(V.supp(spark, d), "ctx-naive", L, " "), V.supp_samples(spark, d))[1]


@query("k14_sample_listing", f"WITH {S.SUPP} SELECT COUNT(*) AS count, s_name AS name FROM supp JOIN supplier ON s_suppkey = sample_id GROUP BY 2")
def k14(spark, d):
    n = entries.entry_counts(V.supp(spark, d), "count")
    return n.join(V.supp_samples(spark, d), "sample_id").select("count", "name")


@query("k14_content_listing", f"WITH {S.SUPP} SELECT sample_id, lower(to_hex(ctx)) AS ctx, lower(to_hex(obj)) AS obj, cnt FROM supp")
def k14_content(spark, d):
    return V.supp(spark, d).select("sample_id", F.lower(F.hex("ctx")).alias("ctx"), F.lower(F.hex("obj")).alias("obj"), "cnt")


# --- set algebra: G1-G6, J8-J11, A13 ----------------------------------------------------------


@query("g1_union_pan", f"WITH {S.SUPP} SELECT DISTINCT ctx, obj FROM supp")
def g1(spark, d):
    return setops.union_pan(V.supp(spark, d))


@query("g2_union_sketch", f"WITH {S.SUPP} SELECT DISTINCT CAST(0 AS BIGINT) AS sample_id, ctx, obj FROM supp")
def g2(spark, d):
    return setops.union_sketch(V.supp(spark, d))


@query("g4_markerdb", f"WITH {S.SUPP} SELECT * FROM supp WHERE (ctx, obj) IN (SELECT (ctx, obj) FROM (SELECT ctx, obj FROM supp GROUP BY 1, 2 HAVING COUNT(*) = 1))")
def g4(spark, d):
    return setops.marker_db(V.supp(spark, d))


for _label, _key, _not in (("j9_intersect_full", "full", ""), ("j9_intersect_ctx", "ctx", ""), ("j10_subtract_full", "full", "NOT"), ("j10_subtract_ctx", "ctx", "NOT")):
    _on = "r.ctx = q.ctx AND r.obj = q.obj" if _key == "full" else "r.ctx = q.ctx"

    def _run(spark, d, key=_key, op=setops.subtract if _not else setops.intersect):
        return op(V.qord(spark, d), setops.unique_union(V.rord(spark, d).where("obj < 10")), key)

    query(_label, f"WITH {S.RORD}, {S.QORD}, pan AS (SELECT ctx, obj FROM rord WHERE obj < 10 GROUP BY 1, 2 HAVING COUNT(*) = 1) SELECT * FROM qord q WHERE {_not} EXISTS (SELECT 1 FROM pan r WHERE {_on})")(_run)


@query("g6_append", f"WITH {S.SUPP}, {S.CUST} SELECT * FROM supp UNION ALL SELECT sample_id + (SELECT MAX(sample_id) + 1 FROM supp), ctx, obj, cnt, pos FROM cust")
def g6(spark, d):
    return setops.append(V.supp(spark, d), V.cust(spark, d))


_META = ("total_length_bp", "record_count", "median_length_bp")
_PARTS = f"""WITH n AS (SELECT MAX(s_suppkey) + 1 AS off FROM supplier), m AS (SELECT l_suppkey AS sample_id, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_length_bp, COUNT(*) AS record_count, CAST(FLOOR(quantile_cont(CAST(l_quantity AS BIGINT), 0.5)) AS BIGINT) AS median_length_bp FROM lineitem GROUP BY 1),
one AS (SELECT s_suppkey AS sample_id, s_name AS name, m.* EXCLUDE sample_id FROM supplier JOIN m ON sample_id = s_suppkey), two AS (SELECT n_nationkey + off AS sample_id, n_name AS name FROM nation, n)"""


@query(
    "g6_append_metadata",
    f"""{_PARTS} SELECT 'all' AS parts, * FROM one UNION ALL SELECT 'all', sample_id + off, name, {", ".join(_META)} FROM one, n
UNION ALL SELECT 'none', sample_id, name, NULL, NULL, NULL FROM one UNION ALL SELECT 'none', *, NULL, NULL, NULL FROM two
UNION ALL SELECT 'mixed', sample_id, name, 0, 0, 0 FROM one UNION ALL SELECT 'mixed', *, 0, 0, 0 FROM two""",
)
def g6_metadata(spark, d):
    """Samples with metadata after samples with metadata, none after none, and none after some."""
    m = entries.metadata(V.records(spark, d)).select("sample_id", *_META)
    bare = V.supp_samples(spark, d)
    one, two = bare.join(m, "sample_id"), table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("sample_id"), F.col("n_name").alias("name"))
    cases = {"all": [one, one], "none": [one.select("sample_id", "name"), two], "mixed": [one, two]}
    none = {c: F.lit(None).cast("long") for c in _META}
    first, *rest = (got.withColumns({c: v for c, v in none.items() if c not in got.columns}).select(F.lit(k).alias("parts"), "sample_id", "name", *_META) for k, got in ((k, setops.append_samples(parts)) for k, parts in cases.items()))
    return first.unionByName(rest[0]).unionByName(rest[1])


@query("g12_combined_pan", f"WITH {S.SUPP}, {S.CUST} SELECT ctx, obj FROM supp UNION SELECT ctx, obj FROM cust")
def g12(spark, d):
    return setops.combined_pan(setops.union_pan(V.supp(spark, d)), setops.union_pan(V.cust(spark, d)))


@query(
    "a13_grouped_taxa",
    f"WITH {S.SUPP} SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS sample_id, s_nationkey || '_' || n_name AS name, ctx, obj FROM supp JOIN supplier ON s_suppkey = sample_id JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey <> 0",
)
def a13(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    groups = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("sample_id"), F.col("s_nationkey").cast("long").alias("taxid"), F.col("n_name").alias("taxname"))
    return entries.grouped(V.supp(spark, d), groups)


@query("j8_exact_overlap", f"WITH {S.SUPP} SELECT q.sample_id AS q, r.sample_id AS r, COUNT(*) AS shared FROM supp q JOIN supp r ON q.ctx = r.ctx AND q.obj = r.obj AND r.sample_id < q.sample_id GROUP BY 1, 2")
def j8(spark, d):
    return pairs.exact_overlap(V.supp(spark, d))


# --- graphs: G7-G11, A14, O5 ------------------------------------------------------------------

_VOTES = "ctxs AS (SELECT DISTINCT sample_id, ctx FROM supp), votes AS (SELECT q.sample_id AS q, r.sample_id AS r, COUNT(*) AS votes FROM ctxs q JOIN ctxs r ON q.ctx = r.ctx AND r.sample_id < q.sample_id GROUP BY 1, 2)"


@query("a14_votes", f"WITH {S.SUPP}, {_VOTES} SELECT * FROM votes WHERE votes >= 2")
def a14(spark, d):
    return pairs.nominated(V.supp(spark, d), min_votes=2)


_RARE = "ctxs AS (SELECT DISTINCT sample_id, ctx FROM supp), rare AS (SELECT * FROM ctxs WHERE ctx IN (SELECT ctx FROM ctxs GROUP BY 1 HAVING COUNT(*) <= 22)), votes AS (SELECT q.sample_id AS q, r.sample_id AS r FROM rare q JOIN rare r ON q.ctx = r.ctx AND r.sample_id < q.sample_id GROUP BY 1, 2 HAVING COUNT(*) >= 17)"


@query(
    "g11_nominated_edges",
    f"{KERNEL}, {_RARE} SELECT {FEATURE_LIST}, {S.r9(S.NAIVE)} AS distance FROM f SEMI JOIN votes USING (q, r) WHERE {S.NAIVE} < 0.12 AND xny >= 3 AND max_af >= 0.25",
)
def g11(spark, d):
    e = V.supp(spark, d)
    got = ani.edges(e, "ctx-naive", 0.12, 3, 0.25, L, candidates=pairs.nominated(e, min_votes=17, max_frequency=22))
    return got.select(*FEATURES, r9("distance").alias("distance"))


def _samples(spark, d):
    """Suppliers with metadata from their lines, as quality needs it."""
    m = entries.metadata(V.records(spark, d)).join(entries.entry_counts(V.supp(spark, d)), "sample_id").join(V.supp_samples(spark, d), "sample_id")
    return m.withColumns({"meta_valid": F.col("total_length_bp") > 0, "is_fasta": F.lit(True), "fmt": F.lit("fasta")})


_SAMPLES = """m AS (SELECT l_suppkey AS sample_id, SUM(CAST(l_quantity AS BIGINT)) AS total, COUNT(*) AS records, FLOOR(quantile_cont(CAST(l_quantity AS BIGINT), 0.5)) AS median,
MAX(CAST(l_quantity AS BIGINT)) / SUM(CAST(l_quantity AS BIGINT)) AS level, stddev_pop(CAST(l_quantity AS BIGINT)) / AVG(CAST(l_quantity AS BIGINT)) AS cv FROM lineitem GROUP BY 1),
n AS (SELECT sample_id, COUNT(*) AS entries FROM supp GROUP BY 1),
k AS (SELECT sample_id, ROW_NUMBER() OVER (ORDER BY level DESC, total DESC, records, median DESC, cv, entries DESC, sample_id) AS rank FROM m JOIN n USING (sample_id))"""


@query("o5_quality_order", f"WITH {S.SUPP}, {_SAMPLES} SELECT sample_id, CAST(rank AS INTEGER) AS rank FROM k")
def o5(spark, d):
    return graph.quality_rank(_samples(spark, d))


_CUT = 0.1149
_EDGES = f"edges AS (SELECT q, r FROM f WHERE {S.NAIVE} < {_CUT} AND xny >= 3 AND max_af >= 0.25)"


def _edges(spark, d):
    return ani.edges(V.supp(spark, d), "ctx-naive", _CUT, 3, 0.25, L)


@query(
    "g7_clusters",
    f"""WITH RECURSIVE {S.SUPP}, {S.kernel('supp')}, {S.fractions('supp')}, {_SAMPLES}, {_EDGES}, links AS (SELECT q AS a, r AS b FROM edges UNION SELECT r, q FROM edges),
reach(id, seen) AS (SELECT sample_id, sample_id FROM k UNION SELECT links.b, reach.seen FROM reach JOIN links ON links.a = reach.id),
c AS (SELECT id AS sample_id, MIN(seen) AS comp FROM reach GROUP BY 1),
g AS (SELECT comp, COUNT(*) AS component_size, arg_min(sample_id, rank) AS representative, ROW_NUMBER() OVER (ORDER BY comp) AS i FROM c JOIN k USING (sample_id) GROUP BY comp)
SELECT sample_id, printf('cluster_%06d', i) AS cluster_id, component_size, representative FROM c JOIN g USING (comp)""",
)
def g7(spark, d):
    return graph.clusters(graph.quality_rank(_samples(spark, d)), _edges(spark, d))


_GRAPH = f"WITH RECURSIVE {S.SUPP}, {S.kernel('supp')}, {S.fractions('supp')}, {_SAMPLES}, {_EDGES}, e AS (SELECT a.rank AS x, b.rank AS y FROM (SELECT q AS i, r AS j FROM edges UNION SELECT r, q FROM edges) JOIN k a ON a.sample_id = i JOIN k b ON b.sample_id = j)"
# the sequential pass: a sample is kept if none of the kept before it is its neighbour
_PASS = "pass(step, kept) AS (SELECT CAST(0 AS BIGINT), []::BIGINT[] UNION ALL SELECT step + 1, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.x = step + 1 AND list_contains(kept, e.y)) THEN kept ELSE list_append(kept, step + 1) END FROM pass WHERE step < (SELECT COUNT(*) FROM k)), fin AS (SELECT unnest(kept) AS rank FROM pass WHERE step = (SELECT COUNT(*) FROM k))"
_GREEDY = f"{_GRAPH}, {_PASS}, chosen AS (SELECT k.sample_id, k.rank, CASE WHEN k.rank IN (SELECT rank FROM fin) THEN k.rank ELSE (SELECT MIN(e.y) FROM e WHERE e.x = k.rank AND e.y IN (SELECT rank FROM fin)) END AS rep FROM k)"
# the same for cliques: a sample joins the first group that it has an edge to every member of
_CLIQUES = f"""{_GRAPH}, pass(step, groups) AS (SELECT CAST(0 AS BIGINT), []::BIGINT[][] UNION ALL SELECT step + 1, CASE WHEN g = 0 THEN list_append(groups, [step + 1]) ELSE list_transform(groups, lambda m, i : CASE WHEN i = g THEN list_append(m, step + 1) ELSE m END) END
FROM (SELECT step, groups, coalesce(list_position(list_transform(groups, lambda m : len(list_filter(m, lambda o : list_contains(near.ys, o))) = len(m)), true), 0) AS g
FROM pass JOIN (SELECT k.rank AS x, coalesce(list(e.y) FILTER (e.y IS NOT NULL), []) AS ys FROM k LEFT JOIN e ON e.x = k.rank GROUP BY 1) near ON near.x = step + 1)),
fin AS (SELECT unnest(groups) AS members FROM pass WHERE step = (SELECT COUNT(*) FROM k)), chosen AS (SELECT k.sample_id, k.rank, f.rep FROM k JOIN (SELECT members[1] AS rep, unnest(members) AS rank FROM fin) f USING (rank))"""
_PLANNED = "SELECT chosen.sample_id, CASE WHEN chosen.rank = rep THEN 'keep' ELSE 'remove' END AS action, b.sample_id AS representative, COUNT(*) OVER (PARTITION BY rep) AS component_size FROM chosen JOIN k b ON b.rank = rep"


@query("g8_greedy_dedup", f"{_GREEDY} {_PLANNED}")
def g8(spark, d):
    return graph.greedy(graph.quality_rank(_samples(spark, d)), _edges(spark, d))


@query("g9_full_linkage_dedup", f"{_CLIQUES} {_PLANNED}")
def g9(spark, d):
    return graph.full_linkage(graph.quality_rank(_samples(spark, d)), _edges(spark, d))


@query("g10_deduplicated_sketch", f"{_GREEDY} SELECT s.sample_id, s_name AS name, COUNT(*) AS n FROM supp s JOIN chosen USING (sample_id) JOIN supplier ON s_suppkey = s.sample_id WHERE chosen.rank = rep GROUP BY 1, 2")
def g10(spark, d):
    """Entries and samples that deduplication leaves."""
    layout = SimpleNamespace(distances=lambda: L)
    samples = entries.metadata(V.records(spark, d)).join(V.supp_samples(spark, d), "sample_id")
    made, kept, _ = sketching.deduplicated(V.supp(spark, d), samples, layout, metric="ctx-naive", cut=_CUT, ctxcut=3, max_afcut=0.25)
    return made.join(kept.select("sample_id", "name"), "sample_id").groupBy("sample_id", "name").agg(F.count("*").alias("n"))


_RULE = "CASE WHEN sample_id = representative THEN 'self' " + "".join(f"WHEN s.{c} <> r.{c} THEN CASE WHEN r.{c} {o} s.{c} THEN '{n}' ELSE 'sample_{n}' END " for n, c, o in (("higher_asm_level", "level", ">"), ("longer_total_length", "total", ">"), ("fewer_records", "records", "<"), ("longer_median_length", "median", ">"), ("lower_length_cv", "cv", "<"), ("more_sketch_entries", "entries", ">"))) + "ELSE 'sample_order' END"


@query(
    "k9_dedup_plan",
    f"""{_GREEDY}, plan AS ({_PLANNED}), own AS (SELECT * FROM m JOIN n USING (sample_id) JOIN supplier ON s_suppkey = sample_id),
num AS (SELECT representative, printf('cluster_%06d', ROW_NUMBER() OVER (ORDER BY MIN(sample_id))) AS component_id FROM plan GROUP BY 1)
SELECT s.s_name AS sample, component_id, action, r.s_name AS representative, CASE WHEN component_size = 1 THEN 'singleton' WHEN action = 'keep' THEN 'best_representative' ELSE 'duplicate' END AS reason,
{_RULE} AS rep_rule, component_size, s.entries AS sample_sketch_entries, r.entries AS rep_sketch_entries,
{", ".join(f"'fasta' AS {x}_fmt, {S.r9(f'{t}.level')} AS {x}_asm_level, CAST({t}.total AS BIGINT) AS {x}_total_length_bp, {t}.records AS {x}_record_count, CAST({t}.median AS BIGINT) AS {x}_median_length_bp, {S.r9(f'{t}.cv')} AS {x}_length_cv" for x, t in (("sample", "s"), ("rep", "r")))}
FROM plan JOIN num USING (representative) JOIN own s USING (sample_id) JOIN own r ON r.sample_id = representative""",
)
def k9(spark, d):
    s = _samples(spark, d)
    got = graph.plan_report(graph.greedy(graph.quality_rank(s), _edges(spark, d)), s)
    return got.select(*(r9(c).alias(c) if t == "double" else c for c, t in got.dtypes))


# --- analytics: V1-V4, A11, A12, J12 ----------------------------------------------------------


@query(
    "v1_unique_context_ani",
    f"""WITH {S.RORD}, {S.QORD}, {S.kernel('qord', 'rord')}, {S.fractions('qord', 'rord')},
own AS (SELECT * FROM rord WHERE ctx IN (SELECT ctx FROM rord GROUP BY 1 HAVING MIN(sample_id) = MAX(sample_id))), {S.kernel('qord', 'own', 'u')},
t AS (SELECT sample_id, COUNT(DISTINCT ctx) AS n FROM own GROUP BY 1),
b AS (SELECT f.q, f.r, f.xny AS full_xny, coalesce(t.n, 0) AS u_ref, coalesce(u.xny, 0) AS u_xny, coalesce(t.n, 0) > 0 AND coalesce(u.xny, 0) * 20 >= coalesce(t.n, 0) AS pick, max_af,
f.xny AS f1, f.n_diff AS f2, f.n_section AS f3, f.n_mut2 AS f4, coalesce(u.xny, 0) AS u1, coalesce(u.n_diff, 0) AS u2, coalesce(u.n_section, 0) AS u3
FROM f LEFT JOIN u ON u.q = f.q AND u.r = f.r LEFT JOIN t ON t.sample_id = f.r),
s AS (SELECT *, CASE WHEN pick THEN u1 ELSE f1 END AS xny, CASE WHEN pick THEN u2 ELSE f2 END AS n_diff, CASE WHEN pick THEN u3 ELSE f3 END AS n_section FROM b),
z AS (SELECT q, r, full_xny, u_ref, u_xny, CASE WHEN pick THEN 'NaiveUnique' ELSE 'NaiveFull' END AS metric, max_af, {S.NAIVE} AS distance FROM s)
SELECT q, r, full_xny, u_ref, u_xny, metric, {S.r9('distance')} AS distance, CAST(ROW_NUMBER() OVER (PARTITION BY q ORDER BY 1 - distance DESC, r) AS INTEGER) AS rank FROM z WHERE max_af >= 0.02 AND full_xny >= 10""",
)
def v1(spark, d):
    o = Options(metric=4, raw=True, afcut=0.02, anicut=0.0, ctxcut=10)
    return ani.unique_context(V.qord(spark, d), V.rord(spark, d), o, L).select("q", "r", "full_xny", "u_ref", "u_xny", "metric", r9("distance").alias("distance"), "rank")


_COVERAGE = """g AS (SELECT h.q, h.r, COUNT(k.ctx) AS ref_markers, COUNT(c.cnt) AS observed_markers, CAST(coalesce(SUM(c.cnt), 0) AS BIGINT) AS count_sum, coalesce(AVG(c.cnt), 0) AS positive_mean_depth,
coalesce(quantile_cont(c.cnt, 0.5), 0) AS positive_median_depth, coalesce(stddev_pop(c.cnt), 0) AS sd FROM h LEFT JOIN mk k ON k.q = h.q AND k.r = h.r LEFT JOIN cust c ON c.sample_id = h.q AND c.ctx = k.ctx AND c.obj = k.obj GROUP BY 1, 2)
SELECT q, r, ref_markers, observed_markers, count_sum, {a} AS observed_fraction, {b} AS estimated_depth, {c} AS positive_mean_depth, {d} AS positive_median_depth, {e} AS count_cv, {f} AS abundance_fraction FROM g""".format(
    a=S.r9("CASE WHEN ref_markers > 0 THEN observed_markers / ref_markers ELSE 0 END"), b=S.r9("CASE WHEN ref_markers > 0 THEN count_sum / ref_markers ELSE 0 END"),
    c=S.r9("positive_mean_depth"), d=S.r9("positive_median_depth"), e=S.r9("CASE WHEN positive_mean_depth > 0 THEN sd / positive_mean_depth ELSE 0 END"),
    f=S.r9("CASE WHEN SUM(count_sum) OVER (PARTITION BY q) > 0 THEN count_sum / SUM(count_sum) OVER (PARTITION BY q) ELSE 0 END"),
)
_HITS = f"WITH {S.SUPP}, {S.CUST}, {S.kernel('cust', 'supp')}, h AS (SELECT q, r FROM pairs WHERE xny >= 3)"


def _coverage(scope: str) -> Query:
    def run(spark, d):
        q, r = V.cust(spark, d), V.supp(spark, d)
        got = ani.coverage(pairs.pair_features(q, r).where("xny >= 3"), q, r, scope).drop("estimator")
        return got.select(*(r9(c).alias(c) if t == "double" else c for c, t in got.dtypes))

    return run


query("a11_coverage_reference", f"{_HITS}, mk AS (SELECT h.q, h.r, s.ctx, s.obj FROM h JOIN supp s ON s.sample_id = h.r WHERE (s.ctx, s.obj) IN (SELECT (ctx, obj) FROM (SELECT ctx, obj FROM supp GROUP BY 1, 2 HAVING COUNT(*) = 1))), {_COVERAGE}")(_coverage("reference"))
_TOP = f"WITH {S.SUPP}, {S.NAT}, {S.kernel('nat', 'supp')}, h AS (SELECT q, r FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY q ORDER BY n_section, xny DESC, r) AS i FROM pairs WHERE xny >= 3) WHERE i <= 3)"
_ALONE = "al AS (SELECT h.q, h.r, s.ctx, s.obj, COUNT(*) OVER (PARTITION BY h.q, s.ctx, s.obj) AS n FROM h JOIN supp s ON s.sample_id = h.r), mk AS (SELECT * FROM al WHERE n = 1)"


@query("a11_coverage_of_three", f"{_TOP}, {_ALONE}, {_COVERAGE.replace('LEFT JOIN cust c', 'LEFT JOIN nat c')}")
def a11_three(spark, d):
    """Three references are reported for a query, so that keys of many references have one owner among these."""
    q, r = V.nat(spark, d), V.supp(spark, d)
    order = Window.partitionBy("q").orderBy("n_section", F.desc("xny"), "r")
    hits = pairs.pair_features(q, r).where("xny >= 3").withColumn("_i", F.row_number().over(order)).where("_i <= 3")
    got = ani.coverage(hits, q, r, "reported").drop("estimator")
    return got.select(*(r9(c).alias(c) if t == "double" else c for c, t in got.dtypes))


query("a11_coverage_reported", f"{_HITS}, al AS (SELECT h.q, h.r, s.ctx, s.obj, COUNT(*) OVER (PARTITION BY h.q, s.ctx, s.obj) AS n FROM h JOIN supp s ON s.sample_id = h.r), mk AS (SELECT * FROM al WHERE n = 1), {_COVERAGE}")(_coverage("reported"))

_PROFILE = """met AS (SELECT q.sample_id AS q, r.sample_id AS r, q.cnt AS c, ROW_NUMBER() OVER (PARTITION BY q.sample_id, r.sample_id ORDER BY q.cnt) - 1 AS i, COUNT(*) OVER (PARTITION BY q.sample_id, r.sample_id) AS n
FROM supp q JOIN supp r ON r.ctx = q.ctx AND r.obj = q.obj),
prof AS (SELECT q, r, n, AVG(c) AS mean, SUM(CASE WHEN i >= FLOOR(n * 0.98::DOUBLE) AND i < n * 0.99::DOUBLE THEN c ELSE 0 END) / (FLOOR(n * 0.99::DOUBLE) - FLOOR(n * 0.98::DOUBLE) + 1) AS tail_mean,
MAX(CASE WHEN i = n // 2 THEN c END) AS median, MAX(c) AS max FROM met WHERE n >= 6 GROUP BY 1, 2, 3)"""


@query("v3_a12_composition", f"WITH {S.SUPP}, {_PROFILE} SELECT q, r, n, {S.r9('mean')} AS mean, {S.r9('tail_mean')} AS tail_mean, median, max FROM prof")
def v3(spark, d):
    e = V.supp(spark, d)
    p = profile.composition(e, e)
    return p.select("q", "r", "n", r9("mean").alias("mean"), r9("tail_mean").alias("tail_mean"), "median", "max")


_VECTORS = """n AS (SELECT user_id AS sample, event_type, COUNT(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2),
v AS (SELECT sample, DENSE_RANK() OVER (ORDER BY event_type) - 1 AS ref_idx, 100.0::DOUBLE * n / SUM(n) OVER (PARTITION BY sample) AS pct FROM n)"""
_NORM = "(SELECT sample, sqrt(SUM(pct * pct)) AS norm FROM v GROUP BY 1)"
_MEASURES = {
    "cosine": f"SELECT x.sample AS q, y.sample AS s, {S.r9('SUM(x.pct * y.pct) / (MAX(a.norm) * MAX(b.norm))')} AS value FROM v x JOIN v y USING (ref_idx) JOIN {_NORM} a ON a.sample = x.sample JOIN {_NORM} b ON b.sample = y.sample GROUP BY 1, 2",
    "l1": f"SELECT x.sample AS q, y.sample AS s, {S.r9('SUM(abs(x.pct - y.pct)) + 200 - SUM(x.pct) - SUM(y.pct)')} + 0.0 AS value FROM v x JOIN v y USING (ref_idx) GROUP BY 1, 2",
    "l2": f"SELECT x.sample AS q, y.sample AS s, {S.r9('sqrt(SUM((x.pct - y.pct) * (x.pct - y.pct)))')} AS value FROM v x JOIN v y USING (ref_idx) GROUP BY 1, 2",
}
for _measure, _text in _MEASURES.items():

    def _run(spark, d, measure=_measure):
        v = V.vectors(spark, d)
        return profile.vector_search(v, v, measure).select("q", "s", (r9("value") + 0.0).alias("value"))

    query(f"v4_j12_search_{_measure}", f"WITH {_VECTORS} {_text}")(_run)


# --- older distances: D16, O8, V9 -------------------------------------------------------------

_OLD = f"""WITH {S.SUPP}, z AS (SELECT sample_id, COUNT(*) AS n FROM supp GROUP BY 1),
p AS (SELECT q.sample_id AS q, r.sample_id AS r, COUNT(*) AS shared FROM supp q JOIN supp r ON q.ctx = r.ctx AND q.obj = r.obj AND r.sample_id < q.sample_id GROUP BY 1, 2),
j AS (SELECT p.*, a.n AS q_size, b.n AS r_size FROM p JOIN z a ON a.sample_id = p.q JOIN z b ON b.sample_id = p.r)"""


@query("d16_jaccard", f"{_OLD} SELECT q, r, shared, q_size, r_size, {S.r9('shared / (q_size + r_size - shared)')} AS value, {S.r9('LEAST(1, ln(1 / (2 * (shared / (q_size + r_size - shared))) + 0.5) / 16)')} AS distance FROM j")
def d16(spark, d):
    return legacy.distances(V.supp(spark, d)).select("q", "r", "shared", "q_size", "r_size", r9("value").alias("value"), r9("distance").alias("distance"))


_PX, _PY = "(1 - pow(1 - pow(0.25::DOUBLE, 8), q_size - shared))", "(1 - pow(1 - pow(0.25::DOUBLE, 8), r_size - shared))"


@query(
    "d16_containment_corrected",
    f"{_OLD}, c AS (SELECT *, {_PX} * {_PY} * (q_size + r_size - 2 * shared) / ({_PX} + {_PY} - 2 * {_PX} * {_PY}) AS rs FROM j), "
    f"w AS (SELECT *, (shared - rs) / LEAST(q_size, r_size) AS value FROM c) SELECT q, r, {S.r9('rs')} AS by_chance, {S.r9('value')} AS value, {S.r9('CASE WHEN value > 0 THEN LEAST(1, ln(1 / value) / 16) ELSE 1 END')} AS distance FROM w",
)
def d16_corrected(spark, d):
    rows = legacy.distances(V.supp(spark, d), metric="min", correction=True, reduced=8)
    return rows.select("q", "r", r9("by_chance").alias("by_chance"), r9("value").alias("value"), r9("distance").alias("distance"))


# erfc by the series of erf whose terms are all positive
_ERFC = "CASE WHEN x > 6 THEN 0 ELSE 1 - x * 2 / sqrt(pi()) * list_sum(list_transform(range(0, 200), lambda n : exp(n * ln(x * x) - lgamma(n + 1.5) + lgamma(1.5) - x * x))) END"
_TO_DISTANCE = lambda v: f"CASE WHEN {v} > 0 THEN ln(1 / (2 * {v}) + 0.5) / 16 END"


@query(
    "d16_statistics",
    f"""{_OLD}, v AS (SELECT q, r, shared / (q_size + r_size - shared) AS value, q_size + r_size - shared AS denominator FROM j), s AS (SELECT *, sqrt(value * (1 - value) / denominator) AS sd FROM v),
x AS (SELECT *, CASE WHEN sd > 0 THEN value / sd * sqrt(0.5) ELSE 9 END AS x FROM s), t AS (SELECT *, 0.5 * ({_ERFC}) AS p_value, value - 1.96 * sd AS low, value + 1.96 * sd AS high FROM x)
SELECT q, r, {S.r9('sd')} AS sd, ROUND(p_value, 7) AS p_value, ROUND(p_value * (SELECT COUNT(*) * COUNT(*) FROM supplier), 4) AS fdr, {S.r9('low')} AS value_low, {S.r9('high')} AS value_high,
{S.r9(_TO_DISTANCE('high'))} AS distance_low, {S.r9(_TO_DISTANCE('low'))} AS distance_high FROM t""",
)
def d16_statistics(spark, d):
    n = V.supp_samples(spark, d).count()  # on both sides, with or without entries
    rows = legacy.with_statistics(legacy.distances(V.supp(spark, d)), comparisons=n * n)
    return rows.select("q", "r", r9("sd").alias("sd"), F.round("p_value", 7).alias("p_value"), F.round("fdr", 4).alias("fdr"), r9("value_low").alias("value_low"), r9("value_high").alias("value_high"), r9("distance_low").alias("distance_low"), r9("distance_high").alias("distance_high"))


@query("o8_nearest", f"{_OLD}, w AS (SELECT q, r, shared / (q_size + r_size - shared) AS value FROM j), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY q ORDER BY {S.r9('LEAST(1, ln(1 / (2 * value) + 0.5) / 16)')}, r) AS rank FROM w) SELECT q, r, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3")
def o8(spark, d):
    rows = legacy.distances(V.supp(spark, d)).withColumn("distance", r9("distance"))
    return legacy.nearest(rows, 3).select("q", "r", "rank")


# --- placement and read counts: V5, V6, O7, A7, P10 -------------------------------------------

#: A tree of three suppliers; its edges, numbered by their lower nodes, with each tip's side and distance.
_TREE, _TIPS = "(A:0.3,(B:0.2,C:0.25):0.1);", ("A", "B", "C")
_SIDES = """(VALUES (1, 'A', 0.3, 'A', 1, 0.0), (1, 'A', 0.3, 'B', -1, 0.6), (1, 'A', 0.3, 'C', -1, 0.65), (2, 'internal_2', 0.1, 'A', -1, 0.4), (2, 'internal_2', 0.1, 'B', 1, 0.2), (2, 'internal_2', 0.1, 'C', 1, 0.25),
(3, 'B', 0.2, 'A', -1, 0.6), (3, 'B', 0.2, 'B', 1, 0.0), (3, 'B', 0.2, 'C', -1, 0.45), (4, 'C', 0.25, 'A', -1, 0.65), (4, 'C', 0.25, 'B', -1, 0.45), (4, 'C', 0.25, 'C', 1, 0.0)) AS side(edge, label, len, tip, s, base)"""


@query(
    "v6_placement",
    f"""{KERNEL}, d AS (SELECT CAST(q AS VARCHAR) AS query, substr('ABC', CAST(r AS INTEGER), 1) AS tip, CAST({S.p_dist()} AS DOUBLE) AS dist FROM f WHERE r BETWEEN 1 AND 3 AND q > 3),
y AS (SELECT query, edge, label, CAST(len AS DOUBLE) AS len, s, dist - CAST(base AS DOUBLE) AS y, LEAST(1 / (GREATEST(dist, 1e-6) * GREATEST(dist, 1e-6)), 1e6) AS w FROM d JOIN {_SIDES} USING (tip)),
m AS (SELECT query, edge, label, len, COUNT(*) FILTER (s = 1) AS clade_size, SUM(w * y) / SUM(w) AS my, SUM(w * s) / SUM(w) AS ms, SUM(w * s * y) / SUM(w) AS msy FROM y GROUP BY ALL HAVING COUNT(*) = 3),
t AS (SELECT *, LEAST(len, GREATEST(0, (msy - ms * my) / (1 - ms * ms))) AS t1 FROM m),
u AS (SELECT *, CASE WHEN my - ms * t1 >= 0 THEN t1 ELSE LEAST(CASE WHEN ms < 0 THEN LEAST(len, GREATEST(0, my / ms)) ELSE len END, GREATEST(CASE WHEN ms > 0 THEN LEAST(len, GREATEST(0, my / ms)) ELSE 0 END, msy)) END AS place FROM t),
v AS (SELECT *, GREATEST(0, my - ms * place) AS pendant FROM u),
z AS (SELECT v.query, v.edge, v.label, clade_size, pendant, place, SUM(w * (y - pendant - s * place) * (y - pendant - s * place)) / SUM(w) AS score FROM v JOIN y USING (query, edge) GROUP BY ALL)
SELECT query, edge AS edge_child, label AS edge_label, clade_size, {S.r9('score')} AS wls_score, {S.r9('pendant')} AS pendant_length, {S.r9('place')} AS distal_from_child, {S.r9('score - MIN(score) OVER (PARTITION BY query)')} AS wls_delta FROM z""",
)
def v6(spark, d):
    e = V.supp(spark, d)
    near = pairs.pair_features(e.where("sample_id > 3"), e.where("sample_id BETWEEN 1 AND 3"))
    far = near.select(F.col("q").cast("string").alias("query"), F.translate(F.col("r").cast("string"), "123", "ABC").alias("ref"), D.p_dist(L).alias("distance"))
    got = place.placed(place.fitted(far, place.Tree(_TREE), list(_TIPS)), place.Options(top=10))
    return got.select("query", "edge_child", "edge_label", F.col("clade_size").cast("long").alias("clade_size"), r9("wls_score").alias("wls_score"), r9("pendant_length").alias("pendant_length"), r9("distal_from_child").alias("distal_from_child"), r9("wls_delta").alias("wls_delta"))
