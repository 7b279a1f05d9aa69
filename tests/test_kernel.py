"""Pair features and unique contexts against a plain dictionary computation."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sketchloom.operators import ani, entries, pairs, setops
from sketchloom.operators.ani import Options

SCHEMA = "sample_id long, ctx long, obj long"


def groups(a: int, b: int) -> int:
    x = a ^ b
    n = 0
    while x:
        n += bool(x & 3)
        x >>= 2
    return n


def by_ctx(rows):
    out = defaultdict(lambda: defaultdict(set))
    for s, c, o in rows:
        out[s][c].add(o)
    return out


def features(q_rows, r_rows, only=None, ignore=False):
    q, r = by_ctx(q_rows), by_ctx(r_rows)
    out = {}
    for a in q:
        for b in r:
            shared = [c for c in q[a] if c in r[b] and (only is None or (c, b) in only) and not (ignore and len(r[b][c]) > 1)]
            if shared:
                d = [min(groups(x, y) for x in q[a][c] for y in r[b][c]) for c in shared]
                out[a, b] = (len(d), sum(x > 0 for x in d), sum(d), sum(x > 1 for x in d))
    return out


def collected(df):
    return {(x.q, x.r): (x.xny, x.n_diff, x.n_section, x.n_mut2) for x in df.collect()}


@pytest.mark.parametrize("seed", range(6))
def test_random_features(spark, seed):
    rng = random.Random(seed)
    ref = [(s, rng.randrange(30), rng.randrange(256)) for s in range(4) for _ in range(25)]
    qry = [(s, rng.randrange(35), rng.randrange(256)) for s in range(2) for _ in range(35)]
    q, r = (spark.createDataFrame(sorted(set(x)), SCHEMA) for x in (qry, ref))
    assert collected(pairs.pair_features(q, r)) == features(qry, ref)
    assert collected(pairs.pair_features(q, r, ignore_conflicts=True)) == features(qry, ref, ignore=True)
    assert collected(pairs.pair_features(q, r, tile=1)) == features(qry, ref)
    every = {k: v for k, v in features(ref, ref).items() if k[1] < k[0]}
    assert collected(pairs.pair_features(r)) == every and collected(pairs.pair_features(r, tile=1)) == every and collected(pairs.pair_features(r, tile=2)) == every
    assert collected(pairs.pair_features(r, ignore_conflicts=True)) == {k: v for k, v in features(ref, ref, ignore=True).items() if k[1] < k[0]}
    some = spark.createDataFrame([(1, 0), (3, 2), (1, 0)], "q long, r long")
    assert collected(pairs.pair_features(r, candidates=some)) == {k: v for k, v in every.items() if k in ((1, 0), (3, 2))}
    owners = defaultdict(set)
    for s, c, _ in ref:
        owners[c].add(s)
    only = {(c, next(iter(s))) for c, s in owners.items() if len(s) == 1}
    assert {(x.ctx, x.sample_id) for x in entries.unique_owners(r).collect()} == only
    got = {(x.q, x.r): (x.u_xny, x.unique_selected) for x in ani.unique_context(q, r, Options(metric=4, raw=True, afcut=0.0, anicut=0.0, ctxcut=1)).collect()}
    few = features(qry, ref, only)
    totals = defaultdict(int)
    for _, b in only:
        totals[b] += 1
    for (a, b), (n, *_rest) in features(qry, ref).items():
        u = few.get((a, b), (0,))[0]
        assert got[a, b] == (u, totals[b] > 0 and 20 * u >= totals[b]), n


@pytest.mark.parametrize("contexts, chosen", [(20, True), (21, False)])
def test_a_twentieth_of_the_unique_contexts(spark, contexts, chosen):
    # one shared unique context of 20 or 21
    ref = [(0, c, 1) for c in range(contexts)] + [(0, 100, 1), (1, 100, 1)]
    qry = [(0, 0, 1), (0, 100, 1)]
    q, r = spark.createDataFrame(qry, SCHEMA), spark.createDataFrame(ref, SCHEMA)
    got = ani.unique_context(q, r, Options(metric=4, raw=True, afcut=0.0, anicut=0.0, ctxcut=1)).where("r = 0").first()
    assert got.unique_selected is chosen and got.metric == ("NaiveUnique" if chosen else "NaiveFull")


def test_ownership_comes_before_conflicts_are_ignored(spark):
    ref = spark.createDataFrame([(0, 1, 0), (0, 2, 0), (1, 1, 1), (1, 1, 2)], SCHEMA)
    qry = spark.createDataFrame([(0, 1, 0)], SCHEMA)
    got = ani.unique_context(qry, ref, Options(metric=4, raw=True, afcut=0.0, anicut=0.0, ctxcut=1, ignore_conflicts=True)).collect()
    assert [(x.r, x.u_ref, x.u_xny) for x in got] == [(0, 1, 0)]  # context 1 has two owners, so only 2 is unique


def test_empty_sides(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(0, 1, 0)], SCHEMA)
    assert pairs.pair_features(none, some).count() == 0 and pairs.pair_features(some, none).count() == 0
    assert ani.detail(none).count() == 0


def test_identity_is_exact(spark):
    e = spark.createDataFrame([(s, c, c % 7) for s in range(2) for c in range(50)], SCHEMA)
    for metric in range(1, 10):
        row = ani.detail(e, None, Options(metric=metric)).first()
        assert row.ani == 1.0 and row.distance == 0.0
    assert ani.detail(e).first().metric == "BestDist" and ani.detail(e).first().confidence == "high"


def test_nomination_by_one_vote_is_complete(spark):
    rng = random.Random(5)
    e = spark.createDataFrame(sorted({(s, rng.randrange(200), rng.randrange(16)) for s in range(12) for _ in range(40)}), SCHEMA)
    direct = {(x.q, x.r) for x in pairs.pair_features(e).collect()}
    assert {(x.q, x.r) for x in pairs.nominated(e).collect()} == direct
    fewer = {(x.q, x.r) for x in pairs.nominated(e, min_votes=3, max_frequency=6, step=2).collect()}
    assert fewer < direct


def test_bad_options():
    for wrong in ({"metric": 10}, {"anicut": 1.2}, {"afcut": float("nan")}, {"top": 0}):
        with pytest.raises(ValueError):
            Options(**wrong)


def test_coverage_counts(spark):
    ref = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 1), (1, 3, 1), (1, 4, 1), (2, 2, 1)], SCHEMA)
    qry = spark.createDataFrame([(7, 1, 1, 4), (7, 2, 1, 6), (7, 4, 1, 2)], SCHEMA + ", cnt long")
    hits = spark.createDataFrame([(7, 0), (7, 1)], "q long, r long")
    got = {x.r: x for x in ani.coverage(hits, qry, ref, "reference").collect()}
    assert (got[0].ref_markers, got[0].observed_markers, got[0].count_sum) == (1, 1, 4)
    got = {x.r: x for x in ani.coverage(hits, qry, ref, "reported").collect()}
    assert (got[0].ref_markers, got[0].observed_markers, got[0].count_sum, got[0].positive_median_depth) == (2, 2, 10, 5.0)
    assert got[1].abundance_fraction == pytest.approx(2 / 12) and got[0].count_cv == pytest.approx(0.2)


def test_stored_index_is_not_shuffled(spark, tmp_path):
    rng = random.Random(6)
    ref = spark.createDataFrame(sorted({(s, rng.randrange(40), rng.randrange(64)) for s in range(9) for _ in range(30)}), SCHEMA)
    qry = spark.createDataFrame(sorted({(s, rng.randrange(40), rng.randrange(64)) for s in range(5) for _ in range(30)}), SCHEMA)
    want = collected(pairs.pair_features(qry, ref))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs.write_index("idx", ref, 8, str(tmp_path))
        index = pairs.read_index(spark, "idx")
        assert collected(pairs.pair_features(qry, index)) == want
        assert {tuple(r) for r in index.entries().select("sample_id", "ctx", "obj").collect()} == {tuple(r) for r in ref.collect()}
        # without the groups of many objects there is one join, whose reference side is read as it lies
        few = pairs.replace(index, many=None, rows=index.rows.where("n <= 2"))
        plan = pairs.pair_features(pairs.groups(qry, conflict_free=True), few)._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin") :]
        assert "Bucketed: true" in join and join.count("Exchange hashpartitioning(ctx") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        pairs.drop_index(spark, "idx")


def test_a_context_of_very_many_samples(spark):
    """2,400 samples share a context: blocks of it meet, and no task holds all of it."""
    n = 2_400
    e = spark.range(n).selectExpr("id AS sample_id", "7L AS ctx", "id % 4 AS obj")
    pairs_of = pairs.pair_features(e, conflict_free=True, tile=300)
    got = pairs_of.agg({"xny": "sum", "n_diff": "sum"}).first()
    each = n // 4
    assert (got["sum(xny)"], got["sum(n_diff)"]) == (n * (n - 1) // 2, n * (n - 1) // 2 - 4 * (each * (each - 1) // 2))


def test_metadata_of_appended_samples(spark):
    have = spark.createDataFrame([(0, "a", 5, "fasta"), (1, "b", 6, "fasta")], "sample_id long, name string, total_length_bp long, fmt string")
    bare = spark.createDataFrame([(0, "c", "note")], "sample_id long, name string, annotation string")
    rows = lambda df: [tuple(r) for r in df.orderBy("sample_id").collect()]
    assert rows(setops.append_samples([have, have]).select("sample_id", "total_length_bp")) == [(0, 5), (1, 6), (2, 5), (3, 6)]
    mixed = setops.append_samples([have, bare])
    assert rows(mixed.select("sample_id", "name", "total_length_bp", "fmt", "annotation")) == [(0, "a", 0, "", None), (1, "b", 0, "", None), (2, "c", 0, "", "note")]
    assert setops.append_samples([bare, bare]).columns == bare.columns
    with pytest.raises(ValueError):
        setops.append_samples([bare, bare], [{"hash_id": 1}, {"hash_id": 2}])


def test_distance_models_are_compiled(spark):
    """Methods beyond 8,000 bytes are interpreted by the JVM, so stages of models must not be one such method."""
    e = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "sample_id long, ctx long, obj long")
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(key)
    pairs.with_fractions(pairs.pair_features(e), e)
    assert int(spark.conf.get(key)) == 8000
    spark.conf.set(key, "20000")
    pairs.with_fractions(pairs.pair_features(e), e)
    assert spark.conf.get(key) == "20000"
    spark.conf.unset(key)


def test_busy_contexts_meet_by_blocks(spark, monkeypatch):
    """Contexts that most samples have, of one and of several objects, beside rare ones: the same features by blocks, by lists and by groups."""
    from sketchloom.operators import meets

    rng = random.Random(9)
    rows = {(s, c, rng.randrange(40) - 3) for s in range(60) for c in range(-1, 4) for _ in range(rng.randrange(4))} | {(rng.randrange(60), rng.randrange(100, 160), rng.randrange(1 << 40)) for _ in range(300)}
    e = spark.createDataFrame(sorted(rows), "sample_id long, ctx long, obj long")
    other = e.where("sample_id % 3 = 0").selectExpr("sample_id + 1000 AS sample_id", "ctx", "obj")
    for ref in (None, other):
        want = sorted(map(tuple, pairs.pair_features(e, ref, tile=7).collect()))
        assert sorted(map(tuple, pairs.pair_features(e, ref, busy=True).collect())) == want
        with monkeypatch.context() as m:
            for name, value in (("BUSY", 8), ("LEAST", 9), ("MOST", 9)):
                m.setattr(meets, name, value)
            assert sorted(map(tuple, pairs.pair_features(e, ref, busy=True).collect())) == want


def test_pairs_are_not_shuffled_one_by_one(spark):
    """What a sample meets goes on as packed rows dealt by the sample, whatever its number; nothing is dealt by pair."""
    ids = [-(2**62), -7, 0, 300, 70_000, 2**33, 2**62]
    rows = [(s, c, (3 * i + c) % 16) for i, s in enumerate(ids) for c in range(4) if (i + c) % 3]
    for some in (rows, [x for x in rows if 0 <= x[0] < 2**32], [x for x in rows if -8 < x[0] < 301]):
        e = spark.createDataFrame(some, SCHEMA)
        got = pairs.pair_features(e)
        dealt = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(" in line]
        assert dealt and not any("r#" in line.split("hashpartitioning(")[1] for line in dealt)
        assert collected(got) == {k: v for k, v in features(some, some).items() if k[1] < k[0]}
        assert collected(pairs.pair_features(e, e)) == features(some, some)


def test_what_a_sample_meets_is_added_up_bit_by_bit(monkeypatch):
    """A query that meets many entries of few partners: no more than ``held`` of them are added up at a time."""
    from sketchloom.operators import meets

    rng = np.random.default_rng(3)
    seen, summed = [], meets._summed
    monkeypatch.setattr(meets, "_summed", lambda p, d: seen.append(len(p)) or summed(p, d))
    rows, want = [], {}
    for q in np.repeat([4, 9], 30).tolist():
        partner, d = rng.integers(0, 50, 40).astype(np.uint8), rng.integers(0, 4, 40).astype(np.uint8)
        rows.append((q, partner.tobytes(), d.tobytes()))
        for p, x in zip(partner.tolist(), d.tolist(), strict=True):
            want[q, p - 5] = np.add(want.get((q, p - 5), 0), [1, x > 0, x, x > 1])
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), *(pa.array([r[i] for r in part], pa.binary()) for i in (1, 2))], names=["q", "partners", "least"]) for part in (rows[:20], rows[20:])]
    got = [tuple(r.values()) for b in meets.by_partner(iter(batches), -5, np.dtype(np.uint8), 100, meets._NAMES) for r in b.to_pylist()]
    assert sorted(got) == sorted((*k, *v.tolist()) for k, v in want.items()) and max(seen) < 100 + 40 and len(seen) > 20


@pytest.mark.parametrize("small, few", [(1 << 20, 1024), (0, 1024), (1 << 20, 0)])
def test_pairs_of_busy_contexts_are_not_shuffled(spark, monkeypatch, small, few):
    """If all contexts are few, pairs of blocks have whole features and are joined with counts where they are; blocks that aren't small are dealt, not broadcast."""
    from sketchloom.operators import blocks, meets

    for module, name, value in ((meets, "BUSY", 8), (meets, "LEAST", 9), (meets, "MOST", 9), (meets, "PART", 4), (meets, "FEW", few), (blocks, "SMALL", small)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(4)
    rows = sorted({(s, c, rng.randrange(16 if c < 4 else 1 << 20)) for s in range(40) for c in range(6) for _ in range(rng.randrange(12 if c else 90))} | {(s, 50 + s // 2, 1) for s in range(40)})
    e = spark.createDataFrame(rows, SCHEMA)
    other = e.where("sample_id % 3 = 0")
    for ref, want in ((None, {k: v for k, v in features(rows, rows).items() if k[1] < k[0]}), (other, features(rows, [x for x in rows if x[0] % 3 == 0]))):
        got = pairs.pair_features(e, ref)
        plan = pairs.with_fractions(got, e, ref)._jdf.queryExecution().executedPlan().toString()
        dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "hashpartitioning(" in line]
        assert ("BroadcastExchange" in plan) and bool(dealt) == (not small or not few) and not any(x.startswith(("q#", "r#")) for x in dealt if few)
        assert collected(got) == want


def test_the_side_of_fewer_numbers_makes_the_partners(spark, monkeypatch):
    """Few queries against many references: rows are packed numbers of the queries, dealt by the reference."""
    from sketchloom.operators import meets

    seen, by_lists = [], meets.by_lists
    monkeypatch.setattr(meets, "by_lists", lambda q, r, low, high: seen.append((low, high)) or by_lists(q, r, low, high))
    few = [(s, c, (s + c) % 16) for s in range(3) for c in range(9)]
    many = [(s * 300, c, (s * c) % 16) for s in range(1, 9) for c in range(s)]
    q, r = (spark.createDataFrame(x, SCHEMA) for x in (few, many))
    assert collected(pairs.pair_features(q, r)) == features(few, many) and collected(pairs.pair_features(r, q)) == features(many, few)
    assert seen == [(0, 2), (0, 2)]
