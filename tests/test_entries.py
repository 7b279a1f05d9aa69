import pytest
from pyspark.sql import functions as F

from sketchloom.functions import distances as D
from sketchloom.operators import entries, legacy, profile, setops


def frame(spark, rows, more=", cnt long"):
    return spark.createDataFrame(rows, "sample_id long, ctx long, obj long" + more)


def test_filters_come_before_conflicts(spark):
    # an error object seen once is filtered, which frees its context
    raw = frame(spark, [(0, 1, 1)] * 3 + [(0, 1, 2)] + [(0, 2, 1)] * 2, "")
    assert {(x.ctx, x.obj, x.cnt) for x in entries.finalize(raw, least=2).collect()} == {(1, 1, 3), (2, 1, 2)}
    assert {(x.ctx, x.obj) for x in entries.finalize(raw).collect()} == {(2, 1)}
    assert entries.finalize(raw, conflicts=True).count() == 3


def test_percentile_cutoff(spark):
    e = frame(spark, [(0, i, 0, 1) for i in range(10)] + [(0, 20, 0, 90)])
    assert entries.percentile_cutoff(e, 0.05).first().cutoff == 1
    assert entries.percentile_cutoff(e, 0.5).first().cutoff == 90
    assert entries.count_filter(e, percentile=0.5, cap=1).count() == 11
    with pytest.raises(ValueError):
        entries.percentile_cutoff(e, 1.5)


def test_metadata(spark):
    r = spark.createDataFrame([(0, 10), (0, 20), (0, 30), (0, 41), (1, 5)], "sample_id long, length long")
    got = {x.sample_id: x for x in entries.metadata(r).collect()}
    assert got[0].median_length_bp == 25 and got[0].asm_level == pytest.approx(41 / 101) and got[1].length_cv == 0.0
    assert entries.metadata(r, F.lit("fastq")).first().asm_level == 0.0


def test_grouping(spark):
    e = frame(spark, [(0, 1, 1, 5), (1, 1, 1, 7), (1, 2, 2, 1), (2, 9, 9, 1)])
    samples = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "sample_id long, name string")
    groups = entries.from_names(samples, [(5, "x"), (5, "x"), (0, "-")])
    got = entries.grouped(e, groups)
    assert {(x.sample_id, x.name, x.ctx) for x in got.collect()} == {(5, "5_x", 1), (5, "5_x", 2)} and "cnt" not in got.columns
    with pytest.raises(ValueError):
        entries.grouped(e, entries.from_names(samples, [(5, "x"), (5, "y"), (0, "-")]))


def test_sets(spark):
    e = frame(spark, [(0, 1, 1, 5), (0, 2, 1, 7), (1, 1, 1, 1), (1, 3, 3, 1)])
    assert setops.union_pan(e).count() == 3 and setops.unique_union(e).count() == 2 and setops.marker_db(e).count() == 2
    pan = spark.createDataFrame([(1, 9), (2, 1)], "ctx long, obj long")
    assert {x.ctx for x in setops.intersect(e, pan).collect()} == {2}
    assert {x.ctx for x in setops.intersect(e, pan, "ctx").collect()} == {1, 2}
    assert {x.ctx for x in setops.subtract(e, pan, "ctx").collect()} == {3}
    with pytest.raises(ValueError):
        setops.intersect(e, pan, "obj")
    with pytest.raises(ValueError):
        setops.append(e, e, {"hash_id": 1}, {"hash_id": 2})
    assert {x.sample_id for x in setops.append(e, e).collect()} == {0, 1, 2, 3}


def row(spark, **values):
    base = {"xny": 100, "n_diff": 10, "n_section": 12, "n_mut2": 1, "q_ctx": 120, "r_ctx": 200}
    return spark.createDataFrame([base | values])


def test_distance_corners(spark):
    def value(c, **values):
        return row(spark, **values).select(c.alias("v")).first().v

    zero = {"n_diff": 0, "n_section": 0, "n_mut2": 0}
    for metric in ("ctx-moe", "ctx-naive", "p_dist"):
        assert value(D.METRICS[metric](D.Layout()), **zero) == 0.0
        assert value(D.METRICS[metric](D.Layout()), xny=0, **zero) == 1.0
    assert value(D.mash(), xny=0) == 1.0 and value(D.aaf(), xny=120) == 0.0
    assert value(D.p_dist(D.Layout(obj_bits=20))) == pytest.approx(12 / 1000)
    assert value(D.select("mash&aaf")) == pytest.approx(max(value(D.mash()), value(D.aaf())))
    assert value(D.select("mash|aaf")) == pytest.approx(min(value(D.mash()), value(D.aaf())))


@pytest.mark.parametrize("wrong", ["", "mash&aaf|p_dist", "&mash", "mash&&aaf", "nothing", "mash&mash&mash&mash&mash"])
def test_bad_metric_expressions(wrong):
    with pytest.raises(ValueError):
        D.parse(wrong)


def test_composition_tail(spark):
    q = frame(spark, [(0, i, 0, i + 1) for i in range(200)])
    m = spark.createDataFrame([(5, i, 0) for i in range(200)] + [(6, i, 0) for i in range(5)], "sample_id long, ctx long, obj long")
    got = profile.composition(q, m).collect()
    assert len(got) == 1  # five shared keys are too few
    # slots 196 and 197 of sorted counts, over one slot more
    assert got[0].tail_mean == pytest.approx((197 + 198) / 3) and got[0].median == 101 and got[0].max == 200
    v = profile.abundance_vectors(profile.composition(q, m)).first()
    assert v.pct == pytest.approx(100.0)


def test_older_distances(spark):
    e = spark.createDataFrame([(0, i, 0) for i in range(10)] + [(1, i, 0) for i in range(5)], "sample_id long, ctx long, obj long")
    got = legacy.distances(e, metric="min", k=16).first()
    assert got.value == 1.0 and got.distance == 0.0
    j = legacy.distances(e, metric="jaccard", k=16).first()
    assert j.value == 0.5
    s = legacy.with_statistics(legacy.distances(e), 3).first()
    assert s.fdr == pytest.approx(3 * s.p_value) and s.value_low < 0.5 < s.value_high


def test_numbered_rows(spark):
    from sketchloom.session import numbered

    rng = __import__("random").Random(4)
    rows = [(rng.randrange(50), i, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long, Part string").repartition(7)
    got = {(r.a, r.b): r.place for r in numbered(df, ["a", F.col("b").desc()], "place").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(((a, b) for a, b, _ in rows), key=lambda x: (x[0], -x[1])) and set(got.values()) == set(range(3000))
    assert numbered(df.limit(0), ["a"], "place").count() == 0
