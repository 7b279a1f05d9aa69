import math

import numpy as np
import pytest

from sketchloom.llm import whitening

VECTORS = "vec_id long, embedding array<double>, component string, N long"


def brute(rows):
    """Covariance of the different integer vectors in whole numbers, then eigenvectors."""
    held = {i: tuple(math.floor(256 * c) for c in v) for i, v in rows}
    fit = sorted(set(held.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    cov = np.array([[(n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j]) / n**2 for j in range(d)] for i in range(d)])
    return held, n, sums, cov


def check(got, rows, count=4):
    held, n, sums, cov = brute(rows)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:count]
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(held) * len(order)
    for k, o in enumerate(order, 1):
        sign = 0
        for i, x in held.items():
            r = by[i, k]
            want = sum((a - s / n) * v for a, s, v in zip(x, sums, vectors[:, o], strict=True)) / math.sqrt(values[o])
            sign = sign or np.sign(want * r.whitened)
            assert r.whitened == pytest.approx(sign * want, abs=1e-7) and r.n == n
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            assert r.explained == pytest.approx(values[o] / np.trace(cov), rel=1e-9) and r.identity_error < 1e-8


def test_against_whole_numbers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, 6)) @ rng.normal(0, 1, (6, 6)) + [0, 1000, -5000, 0, 3, 1e5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, x[0].tolist()) for i in range(200)]
    got = whitening.digest(spark.createDataFrame([(i, v, "c", 7) for i, v in rows], VECTORS).repartition(3)).collect()
    check(got, rows)


def test_defined_results(spark):
    rows = [(i, [float(i), float(i * i % 7), -2.5 * i]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, [1.0]), (105, [])]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows + odd], VECTORS)
    got = whitening.digest(df).collect()
    assert {r.vec_id for r in got} == set(range(40))
    # the third dimension follows the first, so the third component has no variance
    assert all((r.whitened is None) == (r.component == 3) for r in got)
    check([r for r in got if r.component < 3], rows, 2)
    assert whitening.digest(df.where("false")).count() == 0
    assert whitening.digest(df.where("vec_id = 105")).count() == 0
    same = whitening.digest(spark.createDataFrame([(1, [0.5, 0.5], "", 0), (1, [0.5, 0.5], "", 0), (None, [0.5, 0.5], "", 0)], VECTORS)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 1 for r in same)


def test_entries_beyond_doubles_and_longs(spark):
    rows = [(0, [2.0**40, 0.0]), (1, [-(2.0**40), 1.0]), (2, [1e300, -0.0]), (3, [1.0, 0.25])]
    got = {(r.vec_id, r.component): r for r in whitening.digest(spark.createDataFrame([(i, v, "", 0) for i, v in rows], VECTORS)).collect()}
    assert len(got) == 8 and got[0, 1].n == 4 and got[2, 1].deviation is None and got[2, 1].whitened == pytest.approx(got[2, 1].whitened)


def test_planes_give_exact_products(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**45), 2**45, (130, 3))
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(2)
    low, high = whitening.ranges(fit, 3)
    n, sums, products = whitening.scatter(fit, low, high)
    big = x.astype(object)
    assert n == 130 and sums == big.sum(0).tolist() and products == (big.T @ big).tolist()
