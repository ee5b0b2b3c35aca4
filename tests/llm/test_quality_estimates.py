"""The robust estimates against numpy, and what they reject."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evspark.llm import quality

LEAST = np.array([v for _, v in quality.FEATURES])


def central(x):
    bins = np.sort(np.floor(x * 64))
    return bins[(len(bins) - 1) // 2] / 64 + 1 / 128


def starts(x):
    m = np.array([central(c) for c in x.T])
    s = np.sqrt((1.4826 * np.array([central(np.abs(c - v)) for c, v in zip(x.T, m, strict=True)])) ** 2 + LEAST)
    z = (x - m) / s
    u = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    shapes = [np.eye(5), np.cov(np.tanh(z).T, bias=True) + 0.05 * np.eye(5), u.T @ u / len(u) + 0.02 * np.eye(5)]
    return [(m, c * np.outer(s, s)) for c in shapes]


def distance(x, m, c):
    y = np.linalg.solve(np.linalg.cholesky(c), (x - m).T)
    return (y * y).sum(0)


def step(x, m, c):
    bins = np.floor(np.log2(distance(x, m, c) + 1e-3) * quality.BINS)
    kept, under = np.zeros(len(x), bool), 0
    for b in np.unique(bins):
        if under < 0.75 * len(x):
            kept |= bins == b
        under += (bins == b).sum()
    near = x[kept]
    return near.mean(0), quality.CONSISTENCY * np.cov(near.T, bias=True) + np.diag(LEAST)


def by_force(groups, settled=1e-2):
    """All groups go on until none of their determinants falls, as one loop does for all."""
    now = {(g, k): e for g, x in groups.items() for k, e in enumerate(starts(x))}
    first = True
    while True:
        fresh = {k: step(groups[k[0]], *e) for k, e in now.items()}
        fell = max(np.linalg.slogdet(now[k][1])[1] - np.linalg.slogdet(fresh[k][1])[1] for k in now)
        now, again = fresh, first or fell >= settled
        first = False
        if not again:
            break
    return {g: min((now[g, k] for k in range(3)), key=lambda e: np.linalg.slogdet(e[1])[1]) for g in groups}


def rows_of(seed):
    r = np.random.default_rng(seed)
    out = []
    for lang, shift in (("en", 0.0), ("fr", 1.0)):
        for source, n in (("a", 400), ("b", 60), ("c", 3)):
            x = r.normal(size=(n, 5)) * [0.8, 0.2, 0.0, 0.1, 0.2] + [5.5 + shift, 5, 0, 0.1, 0.2]
            x[:, 1] += 0.15 * (x[:, 0] - x[:, 0].mean())
            bad = r.random(n) < 0.15
            x[bad] += [0, 2.5, 3, 0, 0]
            x[:, 2:] = np.maximum(x[:, 2:], 0)
            out += [(lang, source, *map(float, v), bool(b)) for v, b in zip(x, bad, strict=True)]
    return [(i, *v) for i, v in enumerate(out)]


@pytest.mark.parametrize("small", [True, False])
def test_estimates_equal_those_by_force(spark, small):
    rows = rows_of(1)
    names = [n for n, _ in quality.FEATURES]
    table = spark.createDataFrame(rows, "key long, g0 string, g1 string, x0 double, x1 double, x2 double, x3 double, x4 double, bad boolean")
    got = {(r.g0, r.g1): r for r in quality.estimates(table, small).collect()}
    x = {g: np.array([r[3:8] for r in rows if r[1:3] == g]) for g in {r[1:3] for r in rows}}
    x |= {(g,): np.concatenate([v for k, v in x.items() if k[0] == g]) for g in ("en", "fr")}
    best = by_force(x)
    for g, r in got.items():
        w = len(x[g]) / (len(x[g]) + 200)
        m, c = (w * a + (1 - w) * b for a, b in zip(best[g], best[g[:1]], strict=True))
        assert np.allclose([r[f"m{i}"] for i in range(5)], m, atol=1e-6)
        assert np.allclose([r[f"c{i}{j}"] for i, j in quality.PAIRS], [c[i, j] for i, j in quality.PAIRS], atol=1e-6)
        d = distance(x[g], m, c)
        bad = np.array([q[8] for q in rows if q[1:3] == g])
        assert (d[bad] > 50).all() and (d[~bad] < 50).all()
    assert set(names) == {"x0", "x1", "x2", "x3", "x4"}


def test_rows_of_one_group_only_and_none(spark):
    table = spark.createDataFrame([(1, "en", "a", 5.0, 5.0, 0.0, 0.0, 0.0)] * 3, "key long, g0 string, g1 string, x0 double, x1 double, x2 double, x3 double, x4 double")
    (r,) = quality.estimates(table, True).collect()
    assert r.m0 == pytest.approx(5.0) and r.c00 == pytest.approx(LEAST[0])
    assert quality.estimates(table.where(F.lit(False)), True).count() == 0
