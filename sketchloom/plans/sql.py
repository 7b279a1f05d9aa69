"""DuckDB SQL for the catalog's queries: common parts."""

from __future__ import annotations

from sketchloom.functions import coefficients as K

SUPP = "supp AS (SELECT l_suppkey AS sample_id, l_partkey AS ctx, CAST(l_quantity AS BIGINT) AS obj, COUNT(*) AS cnt, MIN(l_orderkey) AS pos FROM lineitem GROUP BY 1, 2, 3)"
CUST = "cust AS (SELECT o_custkey AS sample_id, l_partkey AS ctx, CAST(l_linenumber AS BIGINT) AS obj, COUNT(*) AS cnt, MIN(l_orderkey) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"
SIZE = "size AS (SELECT l_suppkey AS sample_id, CAST(p_size AS BIGINT) AS ctx, CAST(l_quantity AS BIGINT) // 2 AS obj, COUNT(*) AS cnt, MIN(l_orderkey) AS pos FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)"
RORD = "rord AS (SELECT l_suppkey AS sample_id, l_orderkey AS ctx, CAST(l_quantity AS BIGINT) AS obj, COUNT(*) AS cnt, MIN(CAST(l_linenumber AS BIGINT)) AS pos FROM lineitem GROUP BY 1, 2, 3)"
QORD = "qord AS (SELECT CAST(c_nationkey AS BIGINT) AS sample_id, l_orderkey AS ctx, MIN(CAST(l_quantity AS BIGINT)) AS obj, COUNT(*) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"
NAT = "nat AS (SELECT CAST(c_nationkey AS BIGINT) AS sample_id, l_partkey AS ctx, CAST(l_quantity AS BIGINT) AS obj, COUNT(*) AS cnt, MIN(l_orderkey) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)"
CLEAN = "clean AS (SELECT * FROM supp WHERE (sample_id, ctx) IN (SELECT (sample_id, ctx) FROM (SELECT sample_id, ctx FROM supp GROUP BY 1, 2 HAVING COUNT(*) = 1)))"
SECTIONS = "bit_count((xor(q.obj, r.obj) | (xor(q.obj, r.obj) >> 1)) & 6148914691236517205)"


def kernel(qry: str, ref: str | None = None, name: str = "pairs") -> str:
    """CTEs ``{name}_ctx`` and ``{name}`` with the pair features."""
    on = "q.ctx = r.ctx" + ("" if ref else " AND r.sample_id < q.sample_id")
    return f"""{name}_ctx AS (SELECT q.sample_id AS q, r.sample_id AS r, q.ctx, MIN({SECTIONS}) AS d FROM {qry} q JOIN {ref or qry} r ON {on} GROUP BY 1, 2, 3),
{name} AS (SELECT q, r, COUNT(*) AS xny, COUNT(*) FILTER (d > 0) AS n_diff, CAST(SUM(d) AS BIGINT) AS n_section, COUNT(*) FILTER (d > 1) AS n_mut2 FROM {name}_ctx GROUP BY q, r)"""


def fractions(qry: str, ref: str | None = None, pairs: str = "pairs", name: str = "f") -> str:
    count = lambda e: f"(SELECT sample_id, COUNT(DISTINCT ctx) AS n FROM {e} GROUP BY 1)"
    return f"""{name} AS (SELECT p.*, a.n AS q_ctx, b.n AS r_ctx, p.xny / a.n AS af_qry, p.xny / b.n AS af_ref, GREATEST(p.xny / a.n, p.xny / b.n) AS max_af
FROM {pairs} p JOIN {count(qry)} a ON a.sample_id = p.q JOIN {count(ref or qry)} b ON b.sample_id = p.r)"""


def num(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


NAIVE_FOUND = f"(1 - pow(1 - n_diff / (xny + n_diff), (n_section + {num(K.EPSILON)}) / (n_diff + {num(K.EPSILON)})))"
NAIVE = f"CASE WHEN xny = 0 THEN 1 WHEN {NAIVE_FOUND} <= 0 THEN 0 ELSE {NAIVE_FOUND} * {num(K.NAIVE_11[0])} + {num(K.NAIVE_11[1])} * LEAST(1, {NAIVE_FOUND} / {num(K.NAIVE_RAMP)}) END"


def p_dist(obj_bits: int = 6) -> str:
    return f"CASE WHEN xny = 0 THEN 1 ELSE n_section / (xny * {num(obj_bits / 2)}) END"


def linear(features: list[str], crossed: int, denominators, coefficients) -> str:
    inverse = [f"(1 / ({' + '.join(f'{num(w)} * {x}' for w, x in zip(ws, features, strict=True))} + {num(K.EPSILON)}))" for ws in denominators]
    terms = [*features, *inverse, *(f"{x} * {r}" for r in inverse for x in features[:crossed])]
    return " + ".join([num(coefficients[0]), *(f"{num(c)} * {t}" for c, t in zip(coefficients[1:], terms, strict=True))])


_FEATURES = ["CAST(xny AS DOUBLE)", "CAST(n_section AS DOUBLE)", "CAST(n_mut2 AS DOUBLE)", "CAST(n_diff AS DOUBLE)"]
_FAR, _NEAR = linear(_FEATURES, 3, K.MOE_DENOMINATORS, K.MOE), linear(_FEATURES, 3, K.MOE95_DENOMINATORS, K.MOE95)
MOE = f"CASE WHEN xny <= 0 THEN 1 WHEN n_diff <= 0 THEN 0 ELSE GREATEST(CASE WHEN {_FAR} < 0.05 THEN {_NEAR} ELSE {_FAR} END, 0) END"


def blast(contexts: str) -> str:
    return f"LEAST(1, GREATEST(0, {linear([*_FEATURES, f'CAST({contexts} AS DOUBLE)'], 4, K.AF_DENOMINATORS, K.AF)}))"


def clean(x: str) -> str:
    return f"GREATEST({x}, 0)"


MASH = f"CASE WHEN xny = 0 THEN 1 ELSE {clean('-ln(2 * (xny / (q_ctx + r_ctx - xny)) / (1 + xny / (q_ctx + r_ctx - xny))) / 22')} END"
AAF = f"CASE WHEN xny = 0 THEN 1 ELSE {clean('-ln(xny / LEAST(q_ctx, r_ctx)) / 22')} END"


_M = "18446744073709551616::UHUGEINT"
#: The hash of the contexts of ``supp``, in ``h``.
MIX = f"""h0 AS (SELECT *, CAST((CAST(ctx AS UHUGEINT) + 11400714819323198485::UHUGEINT) % {_M} AS UBIGINT) AS x FROM supp),
h1 AS (SELECT * EXCLUDE x, CAST((CAST(xor(x, x >> 30) AS UHUGEINT) * 13787848793156543929::UHUGEINT) % {_M} AS UBIGINT) AS x FROM h0),
h2 AS (SELECT * EXCLUDE x, CAST((CAST(xor(x, x >> 27) AS UHUGEINT) * 10723151780598845931::UHUGEINT) % {_M} AS UBIGINT) AS x FROM h1),
h AS (SELECT * EXCLUDE x, xor(x, x >> 31) AS x FROM h2)"""
GENOMES = f"""g AS (SELECT CAST(c_nationkey AS BIGINT) AS sample_id, l_orderkey, l_orderkey * 1000 AS off, string_agg({" || ".join(f"substr('ACGT', CAST((l_partkey // {4**i}) % 4 + 1 AS BIGINT), 1)" for i in range(7, -1, -1))}, '' ORDER BY l_linenumber, l_partkey) AS seq
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey, l_orderkey)"""


def packed(text: str, n: int) -> str:
    """The number of ``n`` bases."""
    return " + ".join(f"(instr('ACGT', substr({text}, {i + 1}, 1)) - 1) * {4 ** (n - 1 - i)}" for i in range(n))


def tokens(window: str = "true") -> str:
    """CTEs up to ``t``, the sampled k-mers of ``views.KMERS``; ``window`` says which windows count, from base ``i`` of a sequence."""
    return f"""{GENOMES}, p AS (SELECT sample_id, off + i - 1 AS pos, substr(seq, i, 9) AS own, reverse(translate(substr(seq, i, 9), 'ACGT', 'TGCA')) AS other FROM (SELECT *, unnest(range(1, length(seq) - 7)) AS i FROM g) WHERE {window}),
o AS (SELECT sample_id, pos, CASE WHEN substr(own, 2, 3) || substr(own, 6, 3) < substr(other, 2, 3) || substr(other, 6, 3) THEN own ELSE other END AS kmer FROM p),
supp AS (SELECT sample_id, pos, kmer, CAST({packed("'A' || substr(kmer, 2, 3) || 'A' || substr(kmer, 6, 3) || 'A'", 9)} AS BIGINT) AS ctx FROM o),
{MIX}, t AS (SELECT sample_id, pos, kmer, CAST({packed("substr(kmer, 2, 3) || substr(kmer, 6, 3)", 6)} AS BIGINT) AS ctx, CAST({packed("substr(kmer, 1, 1) || substr(kmer, 5, 1) || substr(kmer, 9, 1)", 3)} AS BIGINT) AS obj
FROM h WHERE (x & 4294967295::UBIGINT) <= {0xFFFFFFFF >> 1}::UBIGINT)"""


TOKENS = tokens()


def r9(x: str) -> str:
    return f"ROUND(CAST({x} AS DOUBLE), 9)"
