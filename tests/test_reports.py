"""Reports of unique contexts and coverage, deduplicated sketches, group tables, stored vectors, split FASTQ, the guard."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sketchloom.functions import distances as D
from sketchloom.operators import ani, entries, pairs, profile
from sketchloom.operators.ani import Options
from sketchloom.operators.tokenize import KmerLayout
from sketchloom.plans import sketching
from sketchloom.sources import fastx, sinks, store

ENTRIES = "sample_id long, ctx long, obj long"


def samples(spark, *names):
    return spark.createDataFrame(list(enumerate(names)), "sample_id long, name string")


def test_unique_report(spark, tmp_path):
    ref = spark.createDataFrame([(0, 10, 1), (0, 20, 1), (0, 20, 3), (0, 30, 0), (1, 10, 2), (1, 40, 4)], ENTRIES)
    qry = spark.createDataFrame([(0, 10, 1), (0, 20, 2), (0, 20, 3), (0, 30, 5), (0, 40, 0), (0, 99, 0)], ENTRIES)
    report = ani.unique_report(qry, ref, samples(spark, "q"), samples(spark, "a", "b", "none"))
    got = {r.Ref: r for r in report.collect()}
    assert len(report.columns) == 17 and set(got) == {"a", "b"}
    a = got["a"]  # contexts 20 and 30 are a's alone; 20 matches, 30 differs in two sections
    assert (a.Qry_ctx, a.Ref_ctx, a.XnY_ctx, a.Unique_Ref_ctx, a.Unique_XnY_ctx, a.Unique_N_diff_obj, a.Unique_N_diff_obj_section, a.Unique_N_mut2_ctx) == (5, 3, 3, 2, 2, 1, 2, 1)
    assert (a.Unique_QAF, a.Unique_RAF, a.Unique_RAF_fullref) == pytest.approx((2 / 5, 1.0, 2 / 3)) and 0 < a.Unique_ANI < 1
    no = ani.unique_report(qry.where("ctx = 10"), ref, samples(spark, "q"), samples(spark, "a", "b")).where("Ref = 'a'").first()
    assert no.Unique_XnY_ctx == 0 and no.Unique_ANI is None and no.Unique_RAF == 0
    sinks.write_tsv(report, str(tmp_path / "r"))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_tsv(report, str(tmp_path / "r"))


def test_coverage_columns(spark):
    ref = spark.createDataFrame([(0, c, c) for c in range(8)] + [(1, c, c) for c in range(4, 12)], ENTRIES)
    qry = spark.createDataFrame([(0, c, c, 2 * c) for c in range(1, 10)], ENTRIES + ", cnt long")
    o = Options(metric=4, raw=True, afcut=0.0, anicut=0.0, ctxcut=1)
    rows, q, r = ani.detail(qry, ref, o), samples(spark, "q"), samples(spark, "a", "b")
    out = ani.coverage_columns(rows, qry, ref, q, r)
    assert tuple(out.columns) == (*ani.DETAIL, *ani.COVERAGE)
    got = {x.Ref: x for x in out.collect()}
    a = got["a"]  # keys 0-3 are a's alone; the query has 1-3
    assert (a.Coverage_estimator, a.Coverage_ref_markers, a.Coverage_observed_markers, a.Coverage_count_sum, a.Estimated_abundance_mass, a.Abundance_fraction_scope) == ("refdb_unique_ctxobj_bitset", 4, 3, 12, 12, "refdb")
    assert a.Estimated_abundance_fraction == pytest.approx(12 / (12 + 34)) and a.Estimated_depth == pytest.approx(3.0)
    assert {x.Abundance_fraction_scope for x in ani.coverage_columns(rows, qry, ref, q, r, "reported").collect()} == {"reported_rows"}
    without = ani.coverage_columns(rows, qry.drop("cnt"), ref, q, r).first()
    assert without.Coverage_estimator == "NA:query_missing_counts" and without.Estimated_depth is None
    assert ani.coverage_columns(rows, qry, ref, q, r, None).first().Coverage_estimator == "NA:not_computed"


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.mark.parametrize("how", [{}, {"full_linkage": True}, {"max_frequency": 4, "min_votes": 2}])
def test_sketches_are_deduplicated(spark, tmp_path, how):
    rng = random.Random(3)
    whole, other = dna(rng, 6000), dna(rng, 6000)
    files = {"a.fa": f">r\n{whole}\n", "parts.fa": f">r1\n{whole[:3000]}\n>r2\n{whole[3000:]}\n", "b.fa": f">r\n{other}\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    layout = KmerLayout.coden(9, 2)
    made, known, _ = sketching.sketch(spark, [str(tmp_path / n) for n in files], layout)
    kept, left, plan = sketching.deduplicated(made, known, layout, metric="ctx-naive", cut=0.01, **how)
    got = {r["sample"].rsplit("/", 1)[-1]: (r.action, r.representative.rsplit("/", 1)[-1], r.reason) for r in plan.collect()}
    assert got == {"a.fa": ("keep", "a.fa", "best_representative"), "parts.fa": ("remove", "a.fa", "duplicate"), "b.fa": ("keep", "b.fa", "singleton")}
    assert len(plan.columns) == 21 and sorted(r.name.rsplit("/", 1)[-1] for r in left.collect()) == ["a.fa", "b.fa"]
    assert {r.sample_id for r in kept.select("sample_id").distinct().collect()} == {0, 2}


def test_group_tables(spark, tmp_path):
    (tmp_path / "groups.tsv").write_text("7\tseven\n0\tnone\n7\tseven\n9\n")
    got = entries.read_groups(str(tmp_path / "groups.tsv"), samples(spark, "a", "b", "c", "d"))
    assert sorted(map(tuple, got.collect())) == [(0, 7, "seven"), (1, 0, "none"), (2, 7, "seven"), (3, 9, "")]
    with pytest.raises(ValueError, match="4 lines for 2 samples"):
        entries.read_groups(str(tmp_path / "groups.tsv"), samples(spark, "a", "b"))


def test_stored_vectors(spark, tmp_path):
    v = spark.createDataFrame([(1, 0, 60.0), (1, 1, 80.0), (2, 1, 100.0)], "sample long, ref_idx long, pct double")
    store.write_vectors(str(tmp_path / "v"), v)
    back, norms = store.read_vectors(spark, str(tmp_path / "v"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.collect())) and {r["sample"]: r.norm for r in norms.collect()} == {1: 100.0, 2: 100.0}
    assert {(r.q, r.s): round(r.value, 6) for r in profile.vector_search(v, back).collect()}[1, 2] == 0.8


def test_split_fastq(spark, tmp_path):
    rng = random.Random(6)
    reads = [(f"r{i}", f"c {i}" if i % 3 else "", dna(rng, rng.randint(1, 90))) for i in range(3000)]
    for k, part in enumerate((reads[:2900], reads[2900:])):
        text = "".join(f"@{n}{' ' if c else ''}{c}\n{s}\n+\n{'@' * len(s)}\n" for n, c, s in part)
        (tmp_path / f"{k}.fastq").write_text(text.replace("\n", "\r\n") if k else text)
    paths = [str(tmp_path / f"{k}.fastq") for k in range(2)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = fastx.records(spark, paths).orderBy("path", "rec_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.name, r.comment, bytes(r.seq).decode()) for r in got] == reads
    want = fastx.records(spark, paths).collect()
    assert sorted((r.rec_no, r.name, r.offset, r.length, r.fmt) for r in got) == sorted((r.rec_no, r.name, r.offset, r.length, r.fmt) for r in want)


def test_guard(spark):
    rows = [(300, 10, 15, 4, 900, 800, 0.33, 0.375, True), (300, 10, 15, 4, 900, 800, 0.33, 0.375, False), (300, 10, 15, 4, 500, 800, 0.6, 0.6, True), (300, 0, 0, 0, 300, 300, 1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "xny long, n_diff long, n_section long, n_mut2 long, q_ctx long, r_ctx long, af_qry double, af_ref double, complete_like boolean")
    df = df.withColumns({"raw_ani": F.lit(0.99), "calibrated_ani": F.lit(0.98)})
    on, value = D.guarded()
    got = df.select(on.alias("on"), value.alias("value")).collect()
    assert [r.on for r in got] == [True, False, False, False]
    assert got[0].value == pytest.approx(1 + math.log(290 / 800) / 22)
    assert df.select(D.confidence().alias("c")).first().c == "low"


def test_candidates_meet_alone(spark):
    rng = random.Random(1)
    e = spark.createDataFrame(sorted({(s, rng.randrange(30), rng.randrange(64)) for s in range(6) for _ in range(40)}), ENTRIES)
    every = {(r.q, r.r): tuple(r) for r in pairs.pair_features(e).collect()}
    some = spark.createDataFrame([(3, 1), (5, 0), (3, 1), (1, 3)], "q long, r long")
    assert {(r.q, r.r): tuple(r) for r in pairs.pair_features(e, candidates=some).collect()} == {k: every[k] for k in ((3, 1), (5, 0))}


@pytest.mark.parametrize("measure", ["cosine", "l1", "l2"])
def test_vectors_by_blocks(spark, monkeypatch, measure):
    """Blocks of samples give what dimensions give, repeated rows included, and no pair is shuffled."""
    monkeypatch.setattr(profile, "BLOCK", 4)
    monkeypatch.setattr(profile, "PART", 2)
    rows = [(s, d, float(1 + (s * 7 + d * 3) % 11)) for s in range(11) for d in range(4) if (s + d) % 3] + [(3, 1, 2.5), (5, 0, 4.0), (20, 9, 1.0)]
    v = spark.createDataFrame(rows, "sample long, ref_idx long, pct double")
    q = v.where("sample % 2 = 1")
    got = profile._in_blocks(q, v, measure)
    assert got is not None and "hashpartitioning(q#" not in got._jdf.queryExecution().executedPlan().toString()
    told = lambda df: {(r.q, r.s): pytest.approx(r.value, abs=1e-9) for r in df.collect()}
    assert {(r.q, r.s): r.value for r in got.collect()} == told(profile._joined(q, v, measure))
    assert profile._in_blocks(v, v.unionByName(v.selectExpr("sample", "ref_idx", "CAST(NULL AS DOUBLE) AS pct")), measure) is None


def test_matrix_frame_is_not_shuffled(spark, monkeypatch):
    """Cells and lines come from the pairs that meet; no cell is dealt by its pair."""
    monkeypatch.setattr(ani, "_CHUNK", 3)
    rows = [(s, c, (s + c) % 4) for s in range(-3, 8) for c in range(s + 3, s + 6)]
    e = spark.createDataFrame(rows, ENTRIES)
    cells = ani.matrix_cells(e, "ctx-naive")
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert not any("q#" in x and "r#" in x for x in plan.splitlines() if "hashpartitioning(" in x)
    assert cells.count() == 121 and cells.where("q = r").agg(F.sum("value")).first()[0] == 0
    assert {r.q: r.line for r in ani.matrix_lines(e, "ctx-naive", below=True).collect()} == {r.q: r.line for r in ani.lower_triangle(cells).collect()}
    names = spark.createDataFrame([(s, f"n{s}") for s in range(-3, 8)], "sample_id long, name string")
    lines = lambda x: {r.q: r.line for r in ani.phylip(x, names)[0].collect()}
    assert lines(ani.matrix_lines(e, "ctx-naive", separator=" ")) == lines(cells)


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_copies_of_blocks_are_not_broadcast(spark, monkeypatch, small):
    """Blocks are broadcast once if they are small, and else dealt; what is copied for pairs of blocks never goes through the driver."""
    from sketchloom.operators import blocks

    monkeypatch.setattr(blocks, "SMALL", small)
    monkeypatch.setattr(profile, "BLOCK", 3)
    v = spark.createDataFrame([(f"s{s}", d, float(1 + (s * 7 + d * 3) % 11)) for s in range(20) for d in range(3) if s % 4 or d], "sample string, ref_idx long, pct double")
    got = profile._in_blocks(v, v, "l1")
    plan = got._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate")] if "Generate" in plan else plan
    assert ("BroadcastExchange" in plan) == bool(small) and "BroadcastExchange" not in (above if not small else "") and ("Generate" in plan) == (not small)
    told = lambda df: {(r.q, r.s): pytest.approx(r.value, abs=1e-9) for r in df.collect()}
    assert {(r.q, r.s): r.value for r in got.collect()} == told(profile._joined(v, v, "l1"))


def test_rounding_of_columns_is_that_of_round(spark):
    """Values are rounded as whole numbers only where that gives what ``round`` gives."""
    from sketchloom.plans.registry import r9

    odd = [float("nan"), float("inf"), -0.0, None, -1e-12, 1e20, 999.9999999995, 5e-10, -5e-10, 1.0000000005, -3.2500000015]
    v = spark.createDataFrame([(x,) for x in odd], "v double").unionByName(spark.range(20000).selectExpr("id * 5e-10 - 1e-6 AS v")).unionByName(spark.range(20000).selectExpr("(rand(3) - 0.5) * pow(10, id % 7 - 3) AS v"))
    told = v.select(F.hash(r9("v")).alias("a"), F.hash(F.round("v", 9)).alias("b"))
    assert told.where("a <> b").count() == 0


def test_matrix_rows_are_made_where_a_query_is_met(spark, monkeypatch):
    """A query's pairs come to one task, and its cells and its line are made there; samples without contexts have theirs, too."""
    monkeypatch.setattr(ani, "_CHUNK", 3)
    rows = [(s, c, (s + c) % 4) for s in range(-3, 8) for c in range(s + 3, s + 6)] + [(9, None, 1), (11, 40, 2)]
    e = spark.createDataFrame(rows, ENTRIES)
    cells, lines = ani.matrix_cells(e, "ctx-naive"), {b: ani.matrix_lines(e, "ctx-naive", below=b) for b in (True, False)}
    for made in (cells, *lines.values()):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert sum("hashpartitioning(q#" in x for x in plan.splitlines()) == 1
    told = lambda df: sorted(map(tuple, df.collect()))
    got = told(cells), {b: told(x) for b, x in lines.items()}
    monkeypatch.setattr(ani, "BROADCAST_ROWS", 0)  # the other way
    assert got == (told(ani.matrix_cells(e, "ctx-naive")), {b: told(ani.matrix_lines(e, "ctx-naive", below=b)) for b in (True, False)})
    assert len(got[0]) == 169 and len(got[1][False]) == 13 and len(got[1][True]) == 12
