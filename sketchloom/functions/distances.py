"""Distances between samples as Column expressions over the pair features.

The features of a pair are the columns ``xny`` (shared contexts), ``n_diff`` (shared contexts whose
objects differ), ``n_section`` (differing object sections), ``n_mut2`` (contexts with two or more),
``q_ctx`` and ``r_ctx`` (contexts of either side). :data:`METRICS` is a registry of name to builder; a
caller may add to it. ``select`` parses expressions such as ``ctx-moe&aaf`` or ``mash|p_dist``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sketchloom.functions import coefficients as K


@dataclass(frozen=True)
class Layout:
    """What a distance needs to know of how contexts and objects are laid out."""

    ctx_bits: int = 44
    obj_bits: int = 20
    codens: int = 11
    fold: int = 8


def _d(x: float) -> Column:
    return F.lit(float(x))


def _f(name: str) -> Column:
    return F.col(name).cast("double")


def naive(layout: Layout = Layout()) -> Column:
    xny, diff, section = _f("xny"), _f("n_diff"), _f("n_section")
    scale, intercept = K.NAIVE_11 if layout.codens >= 11 else K.NAIVE_9
    ratio = (section + K.EPSILON) / (diff + K.EPSILON)
    found = 1 - F.pow(1 - diff / (xny + diff), ratio)
    value = found * scale + intercept * F.least(_d(1), found / K.NAIVE_RAMP)
    return F.when(F.col("xny") == 0, _d(1)).when(found <= 0, _d(0)).otherwise(value)


def p_dist(layout: Layout = Layout()) -> Column:
    if not layout.obj_bits:
        return _d(1)
    return F.when(F.col("xny") == 0, _d(1)).otherwise(_f("n_section") / (_f("xny") * (layout.obj_bits / 2)))


def _linear(base: list[Column], crossed: int, denominators, coefficients) -> Column:
    """Intercept, features, reciprocals, and the first ``crossed`` features times each reciprocal."""
    reciprocals = [1 / (sum((w * x for w, x in zip(ws[1:], base[1:], strict=True)), ws[0] * base[0]) + K.EPSILON) for ws in denominators]
    factors = [*((x,) for x in base), *((r,) for r in reciprocals), *((x, r) for r in reciprocals for x in base[:crossed])]
    total = _d(coefficients[0])
    for c, term in zip(coefficients[1:], factors, strict=True):
        product = _d(c)
        for x in term:
            product = product * x
        total = total + product
    return total


def moe(layout: Layout = Layout()) -> Column:
    scale = math.ldexp(1.0, max(-60, min(60, layout.fold - K.FOLD)))
    base = [_f(c) * scale for c in ("xny", "n_section", "n_mut2", "n_diff")]
    wide, near = ((K.MOE_DENOMINATORS, K.MOE), (K.MOE95_DENOMINATORS, K.MOE95)) if layout.codens >= 11 else ((K.MOE_DENOMINATORS_9, K.MOE_9), (K.MOE95_DENOMINATORS_9, K.MOE95_9))
    far = _linear(base, 3, *wide)
    close = _linear(base, 3, *near)
    value = F.when(far < 0.05, close).otherwise(far)
    return F.when(F.col("xny") <= 0, _d(1)).when(F.col("n_diff") <= 0, _d(0)).otherwise(F.greatest(value, _d(0)))


def blast_fraction(contexts: str, layout: Layout = Layout()) -> Column:
    """The BLAST-like alignment fraction of the side with ``contexts`` contexts, within 0..1."""
    scale = math.ldexp(1.0, max(-60, min(60, layout.fold - K.FOLD)))
    base = [_f(c) * scale for c in ("xny", "n_section", "n_mut2", "n_diff", contexts)]
    value = _linear(base, 4, K.AF_DENOMINATORS, K.AF)
    return F.least(_d(1), F.greatest(_d(0), value))


def clean(distance: Column) -> Column:
    """Not finite becomes 1, negative 0."""
    return F.when(distance.isNull() | F.isnan(distance) | (F.abs(distance) == float("inf")), _d(1)).otherwise(F.greatest(distance, _d(0)))


def mash(layout: Layout = Layout(), shared: Column | None = None) -> Column:
    shared = _f("xny") if shared is None else shared
    union = _f("q_ctx") + _f("r_ctx") - shared
    j = shared / F.nullif(union, _d(0))
    k = layout.ctx_bits / 2
    return F.when((shared <= 0) | (union <= 0), _d(1)).otherwise(clean(-F.log(2 * j / (1 + j)) / k))


def aaf(layout: Layout = Layout(), shared: Column | None = None) -> Column:
    shared = _f("xny") if shared is None else shared
    smaller = F.least(_f("q_ctx"), _f("r_ctx"))
    return F.when((shared <= 0) | (smaller <= 0), _d(1)).otherwise(clean(-F.log(shared / F.nullif(smaller, _d(0))) / (layout.ctx_bits / 2)))


Builder = Callable[[Layout], Column]
METRICS: dict[str, Builder] = {"ctx-moe": moe, "ctx-naive": naive, "p_dist": p_dist, "mash": mash, "aaf": aaf}


def register(name: str, builder: Builder) -> None:
    METRICS[name] = builder


def parse(expression: str) -> tuple[str, list[str]]:
    """Operator (``&``, ``|`` or none) and the metrics of an expression; at most four, operators not mixed."""
    compact = "".join(expression.split())
    used = [op for op in "&|" if op in compact]
    if len(used) > 1:
        raise ValueError(f"a metric expression can't mix & and |: {expression!r}")
    op = used[0] if used else ""
    names = compact.split(op) if op else [compact]
    if not 1 <= len(names) <= 4 or any(n not in METRICS for n in names):
        raise ValueError(f"not a metric expression: {expression!r}; metrics are {', '.join(METRICS)}")
    return (op if len(names) > 1 else ""), names


def select(expression: str, layout: Layout = Layout()) -> Column:
    """The distance of an expression: the largest under ``&``, the smallest under ``|``."""
    op, names = parse(expression)
    values = [clean(METRICS[n](layout)) for n in names]
    return values[0] if not op else F.greatest(*values) if op == "&" else F.least(*values)


# --- calibration hook, best metric and confidence -------------------------------------------

#: A function of the feature columns to a calibrated identity; none is shipped.
_calibrator: Callable[[], Column] | None = None


def set_calibrator(builder: Callable[[], Column] | None) -> Callable[[], Column] | None:
    """Use another calibrator, or none; gives the one before."""
    global _calibrator
    before, _calibrator = _calibrator, builder
    return before


def identity_boundary() -> Column:
    """Full overlap without any difference: calibrated and best identity are exactly 1."""
    none = (F.col("n_diff") == 0) & (F.col("n_section") == 0) & (F.col("n_mut2") == 0)
    return (F.col("xny") > 0) & none & (F.col("af_qry") == 1.0) & (F.col("af_ref") == 1.0)


def calibrated() -> Column:
    """The calibrated identity; null without a calibrator except at the identity boundary."""
    learned = _calibrator() if _calibrator else F.lit(None).cast("double")
    return F.when(identity_boundary(), _d(1)).otherwise(learned)


def guarded(layout: Layout = Layout()) -> tuple[Column, Column]:
    """Whether the guard for complete-like queries replaces the calibrated identity, and by what.

    Needs ``raw_ani``, ``calibrated_ani``, alignment fractions and ``complete_like``.
    """
    exact = F.greatest(_d(0), _f("xny") - _f("n_diff"))
    near = (1 - mash(layout) + 1 - aaf(layout) + 1 - mash(layout, exact) + 1 - aaf(layout, exact)) / 4
    least = F.least("af_qry", "af_ref")
    on = F.col("complete_like") & ~identity_boundary() & (F.col("raw_ani") >= 0.958) & (F.col("calibrated_ani") >= 0.962) & (least >= 0.25) & (least < 0.5) & (F.col("raw_ani") - near >= 0.015)
    return F.coalesce(on, F.lit(False)), 1 - aaf(layout, exact)


def confidence() -> Column:
    """Label from raw and calibrated identity and the reference's aligned fraction."""
    drop = F.col("raw_ani") - F.col("calibrated_ani")
    return F.when((F.col("af_ref") < 0.5) | ((F.col("raw_ani") >= 0.95) & (drop > 0.02)), "low").when(F.abs(drop) > 0.01, "medium").otherwise("high")
