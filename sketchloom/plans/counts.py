"""Queries of read-count ranges, inferred from a sample's histogram or stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from sketchloom.operators import readqc
from sketchloom.plans import sql as S
from sketchloom.plans import views as V
from sketchloom.plans.registry import query

_BINS = "OVER (PARTITION BY sample_id ORDER BY c)"
_NB = "c * ln(1 - size / (size + mean)) + size * ln(size / (size + mean)) + lgamma(c + size) - lgamma(size) - lgamma(c + 1)"


def _stretch(source: str, ok: str, name: str) -> str:
    """CTE with the first and last bin of the stretch around the mode in which ``ok`` holds of all other bins."""
    return f"{name} AS (SELECT sample_id, coalesce(MAX(i) FILTER (i < mode AND NOT ({ok})) + 1, 0) AS lo, coalesce(MIN(i) FILTER (i > mode AND NOT ({ok})) - 1, MAX(i)) AS hi FROM {source} GROUP BY 1)"


# bins are numbered from 0 in the order of their counts
_RANGES = f"""{S.SIZE}, bins AS (SELECT sample_id, CAST(cnt AS DOUBLE) AS c, CAST(COUNT(*) AS DOUBLE) AS f FROM size GROUP BY 1, 2),
steps AS (SELECT *, ROW_NUMBER() {_BINS} - 1 AS i, coalesce(c - lag(c) {_BINS} = 1, false) AS has_prev, coalesce(lead(c) {_BINS} - c = 1, false) AS has_next, coalesce(lag(f) {_BINS}, 0) AS prev_f, coalesce(lead(f) {_BINS}, 0) AS next_f,
SUM(c * f) {_BINS} AS mass, SUM(c * f) OVER (PARTITION BY sample_id) AS whole, COUNT(*) OVER (PARTITION BY sample_id) AS n FROM bins),
smooth AS (SELECT *, (2 * f + CASE WHEN has_prev THEN prev_f ELSE 0 END + CASE WHEN has_next THEN next_f ELSE 0 END) / (2 + has_prev::INT + has_next::INT) AS s, SUM((NOT has_prev)::INT) {_BINS} AS run FROM steps),
quarts AS (SELECT sample_id, MIN(i) FILTER (mass >= 0.25 * whole) AS q1, MIN(i) FILTER (mass >= 0.5 * whole) AS q2, MIN(i) FILTER (mass >= 0.75 * whole) AS q3 FROM smooth GROUP BY 1),
tops AS (SELECT *, (i = 0 OR (has_prev AND s >= lag(s) {_BINS})) AND (i = n - 1 OR (has_next AND s >= lead(s) {_BINS})) AS top FROM smooth),
modes AS (SELECT sample_id, i AS mode, f AS mode_f, run AS mode_run, q2 FROM tops JOIN quarts USING (sample_id) WHERE i BETWEEN q1 AND q3 QUALIFY ROW_NUMBER() OVER (PARTITION BY sample_id ORDER BY top DESC, s DESC, i) = 1),
valleys AS (SELECT sample_id, arg_min(i, (s, i)) + 1 AS valley FROM smooth JOIN modes USING (sample_id) WHERE mode > 1 AND i < mode GROUP BY 1),
near AS (SELECT b.*, mode, mode_f, q2, coalesce(valley, 0) AS valley, run = mode_run AND i >= coalesce(valley, 0) AS near FROM smooth b JOIN modes USING (sample_id) LEFT JOIN valleys USING (sample_id)),
{_stretch("near", f"near AND f >= GREATEST(2, floor(mode_f / {readqc.FIT_SHARE}))", "fit0")},
ends AS (SELECT DISTINCT sample_id, n, valley FROM near),
fit1 AS (SELECT sample_id, n, valley, CASE WHEN hi - lo < 2 THEN GREATEST(valley, lo - 1) ELSE lo END AS lo, CASE WHEN hi - lo < 2 THEN LEAST(n - 1, hi + 1) ELSE hi END AS hi FROM fit0 JOIN ends USING (sample_id)),
fit2 AS (SELECT sample_id, CASE WHEN hi - lo < 2 THEN GREATEST(valley, lo - 1) ELSE lo END AS lo, CASE WHEN hi - lo < 2 THEN LEAST(n - 1, hi + 1) ELSE hi END AS hi FROM fit1),
shape AS (SELECT sample_id, lo AS fit_lo, hi AS fit_hi, SUM(c * f) / SUM(f) AS mean, GREATEST(0, SUM(c * c * f) / SUM(f) - pow(SUM(c * f) / SUM(f), 2)) AS variance FROM near JOIN fit2 USING (sample_id) WHERE i BETWEEN lo AND hi GROUP BY 1, 2, 3),
sized AS (SELECT *, CASE WHEN variance > mean THEN mean * mean / (variance - mean) END AS size FROM near JOIN shape USING (sample_id)),
power AS (SELECT *, CASE WHEN variance <= mean THEN c * ln(mean) - mean - lgamma(c + 1) ELSE {_NB} END AS power FROM sized),
want AS (SELECT *, exp(LEAST(power - MAX(CASE WHEN i = mode THEN power END) OVER (PARTITION BY sample_id), 700)) AS want, f / mode_f AS seen FROM power),
{_stretch("want", f"near AND NOT (want < {readqc.NEGLIGIBLE} AND seen < {readqc.NEGLIGIBLE}) AND want <= seen * {readqc.TOLERANCE} AND seen <= want * {readqc.TOLERANCE}", "told")},
lasts AS (SELECT DISTINCT sample_id, q2, valley, CASE WHEN lo = hi THEN fit_lo ELSE lo END AS lo, CASE WHEN lo = hi THEN fit_hi ELSE hi END AS hi FROM want JOIN told USING (sample_id)),
ranges AS (SELECT sample_id, MAX(c) FILTER (i = LEAST(lo, GREATEST(valley, q2))) AS lower, MAX(c) FILTER (i = GREATEST(hi, q2)) AS upper FROM smooth JOIN lasts USING (sample_id) GROUP BY 1)"""


@query("a7_p10_read_counts", f"WITH {_RANGES} SELECT size.* FROM size JOIN ranges USING (sample_id) WHERE cnt BETWEEN lower AND upper")
def a7(spark, d):
    """Counts outside the range that a sample's histogram suggests are dropped; histograms are compared with simulated ones in the tests, too."""
    e = V.size(spark, d)
    return readqc.sketch_qc(e, readqc.inferred_ranges(e))


@query("a7_inferred_ranges", f"WITH {_RANGES} SELECT sample_id, true AS valid, CAST(lower AS BIGINT) AS lower, CAST(upper AS BIGINT) AS upper FROM ranges")
def a7_ranges(spark, d):
    return readqc.inferred_ranges(V.size(spark, d)).drop("mode")


@query("p10_stored_ranges", f"WITH {S.SIZE} SELECT * FROM size WHERE sample_id % 3 = 0 OR cnt BETWEEN 1 + sample_id % 2 AND 1 + sample_id % 4")
def p10(spark, d):
    """Stored ranges, by a rule of the sample; those that aren't valid keep all."""
    e, s = V.size(spark, d), F.col("sample_id")
    ranges = e.select("sample_id").distinct().withColumns({"valid": s % 3 != 0, "lower": 1 + s % 2, "upper": 1 + s % 4})
    return readqc.sketch_qc(e, ranges)
