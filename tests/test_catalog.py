"""Every query that has SQL gives the SQL's rows, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__
from sketchloom.operators import legacy
from sketchloom.plans import catalog, views
from sketchloom.plans import sql as S

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "null" if v is None else repr(float(v) + 0.0) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = canonical(df.columns, df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    assert got == canonical([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


#: Query, and SQL that gives how many rows there are to choose from and how many are chosen: some are, and some aren't.
BRANCHES = {
    "p7_percentile_filter": ("size", None),
    "p8_capped_cutoff": ("size", None),
    "p10_stored_ranges": ("size", None),
    "a7_p10_read_counts": ("size", None),
    "a10_unique_owners": ("(SELECT DISTINCT ctx FROM rord)", None),
    "j9_intersect_full": ("qord", None),
    "j10_subtract_ctx": ("qord", None),
    "p17_close_filters": ("f", None),
    "g11_nominated_edges": ("f", None),
    "v1_unique_context_ani": (None, "metric = 'NaiveUnique'"),
    "d12_metric_fallback": (None, "metric = 'BestDist'"),
    "d9_d11_calibrated": (None, "confidence = 'low'"),
    "d10_best_guarded": (None, "guarded"),
    "g7_clusters": (None, "component_size >= 3"),
    "g8_greedy_dedup": (None, "action = 'remove'"),
    "g9_full_linkage_dedup": (None, "action = 'remove'"),
    "k9_dedup_plan": (None, "reason = 'singleton'"),
}


@pytest.mark.parametrize("name", sorted(BRANCHES))
def test_queries_choose(name):
    """At the scale of 0.01 every query keeps some rows and drops some, or meets both branches."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"/root/testdata/sf0.01/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    sql, (source, branch) = catalog.oracle_sql()[name], BRANCHES[name]
    if source:
        # the same common table expressions, with all rows of the source instead of those chosen
        ctes = f"WITH {S.SIZE}, {S.RORD}, {S.QORD}, {S.SUPP}, {S.kernel('supp')}, {S.fractions('supp')}"
        every, chosen = con.execute(f"{ctes} SELECT count(*) FROM {source}").fetchone()[0], con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0]
    else:
        every, chosen = con.execute(f"SELECT count(*), count(*) FILTER ({branch}) FROM ({sql})").fetchone()
    assert 0 < chosen < every


def test_calibrated_labels_all_occur(duck):
    found = duck.execute(f"SELECT DISTINCT confidence FROM ({catalog.oracle_sql()['d9_d11_calibrated']})").fetchall()
    assert {"low", "medium", "high"} >= {x for x, in found} and len(found) > 1


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_statistics_count_all_comparisons(spark, duck, size):
    path = f"/root/testdata/{size}"
    where = lambda t: f"'{path}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{path}/{t}.parquet') else ''}'"
    n = duck.execute(f"SELECT count(*) FROM {where('supplier')}").fetchone()[0]
    sets = {}
    for sample, *key in duck.execute(f"SELECT DISTINCT l_suppkey, l_partkey, CAST(l_quantity AS BIGINT) FROM {where('lineitem')}").fetchall():
        sets.setdefault(sample, set()).add(tuple(key))
    want = {}
    for q, r in ((q, r) for q in sets for r in sets if r < q and sets[q] & sets[r]):
        union = len(sets[q] | sets[r])
        value = len(sets[q] & sets[r]) / union
        sd = math.sqrt(value * (1 - value) / union)
        want[q, r] = n * n * 0.5 * math.erfc(value / sd * math.sqrt(0.5)) if sd else 0.0
    rows = legacy.with_statistics(legacy.distances(views.supp(spark, path)), comparisons=n * n)
    got = {(x.q, x.r): x.fdr for x in rows.collect()}
    assert got.keys() == want.keys() and len(got) > 1
    assert all(got[k] == pytest.approx(want[k], abs=1e-9, rel=1e-9) for k in got)
    rounded = {(x.q, x.r): x.fdr for x in catalog.queries()["d16_statistics"](spark, path).collect()}
    assert rounded.keys() == want.keys() and all(rounded[k] == pytest.approx(want[k], abs=5.1e-5) for k in got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scopes_of_coverage_differ():
    """Keys of many references have one owner among the three that are reported, so the two scopes differ for all rows."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"/root/testdata/sf0.01/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    reported = con.execute(f"SELECT q, r, ref_markers FROM ({catalog.oracle_sql()['a11_coverage_of_three']})").fetchall()
    alone = dict(con.execute(f"WITH {S.SUPP} SELECT sample_id, COUNT(*) FROM supp WHERE (ctx, obj) IN (SELECT (ctx, obj) FROM supp GROUP BY ctx, obj HAVING COUNT(*) = 1) GROUP BY 1").fetchall())
    assert len(reported) == 75 and all(n > alone[r] for _, r, n in reported)


@pytest.mark.parametrize("name", ["p1_p4_tokenized", "p5_recovered_kmers", "s8_split_records", "s4_s5_sequence_files", "v9_quality_filter", "v10_reversed_samples", "v10_reversed_reads"])
def test_sequences_of_large_part_numbers(spark, tmp_path, name):
    """Parts' numbers of more than eight digits in base four, as larger tables have."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem"):
        path = f"{SF}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        more = "* REPLACE (l_partkey + 99991 * (l_orderkey % 3) AS l_partkey)" if t == "lineitem" else "*"
        con.execute(f"COPY (SELECT {more} FROM '{path}') TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    got = canonical(df.columns, df.collect())
    cur = con.execute(catalog.oracle_sql()[name])
    assert got == canonical([c[0] for c in cur.description], cur.fetchall())
