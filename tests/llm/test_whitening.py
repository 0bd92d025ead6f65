import math
from fractions import Fraction

import numpy as np
import pytest

from scholium.llm import whitening

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, deviation string, component int")


def run(spark, rows, k=4, kind="array<double>"):
    df = frame(spark, [(i, v, "x", 7) for i, v in rows], kind)
    return [tuple(r) for r in whitening.whiten(df, whitening.fit(df, components=k)).collect()]


def exact(rows):
    """n, S and the covariance in rational numbers, over the distinct integer vectors."""
    x = {tuple(math.floor(256 * c) for c in v) for v in rows}
    d, n = len(next(iter(x))), len(x)
    s = [sum(v[j] for v in x) for j in range(d)]
    cov = [[sum((v[i] - Fraction(s[i], n)) * (v[j] - Fraction(s[j], n)) for v in x) / n for j in range(d)] for i in range(d)]
    return n, s, cov


def check(rows, got, k):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, s, cov = exact([v for _, v in good])
    d = len(s)
    lam, vec = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    lam, vec = lam[::-1], vec[:, ::-1]
    assert len(got) == len(good) * min(k, d)
    key = lambda i: -1 if i is None else i
    by = {}
    for i, c, *rest in got:
        by.setdefault((key(i), c), []).append(rest)
    signs = {}
    for i, v in good:
        x = [math.floor(256 * c) for c in v]
        for c in range(1, min(k, d) + 1):
            n_, deviation, white, explained, error = by[key(i), c][0]
            assert n_ == n and deviation == sum((n * a - b) ** 2 for a, b in zip(x, s)) and error <= 1e-4
            want = float(np.array([float(a - Fraction(b, n)) for a, b in zip(x, s)]) @ vec[:, c - 1] / np.sqrt(lam[c - 1]))
            if abs(want) > 1e-6:
                assert signs.setdefault(c, np.sign(want * white)) == np.sign(want * white)
            assert abs(abs(want) - abs(white)) < 1e-8 * max(1, abs(want))
            assert explained == pytest.approx(lam[c - 1] / lam.sum(), rel=1e-9)


def test_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * [1, 0.9, 0.5, 0.3, 0.2, 0.1] + 0.3).tolist()) for i in range(200)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (2000, None), (2001, [None] * 6), (2002, [NAN] * 6), (2003, [1.0, INF, 0.0, 0.0, 0.0, 0.0]), (2004, [1.0, -INF, 0.0, 0.0, 0.0, 0.0])]
    check(rows, run(spark, rows), 4)
    check(rows, run(spark, rows, 6), 6)


def test_few_dimensions_and_floats(spark):
    rows = [(i, [float(np.float32(0.1 * i)), float(np.float32(math.sin(i)))]) for i in range(20)]
    check(rows, run(spark, rows, kind="array<float>"), 4)


def test_without_variance(spark):
    one = run(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert one == [(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    line = run(spark, [(i, [float(i), 1.0, 2.0]) for i in range(4)])
    assert all((r[4] is None) == (r[1] > 1) and r[5] == (1.0 if r[1] == 1 else 0.0) and r[6] < 1e-12 for r in line)


def test_nothing_usable(spark):
    assert run(spark, []) == run(spark, [(1, None), (2, [None]), (3, [NAN]), (4, [])]) == []


def test_other_lengths_take_no_part(spark):
    rows = [(i, [float(i), float(i * i)]) for i in range(5)]
    assert len(run(spark, rows)) == 10
    near = lambda got: sorted((*r[:4], *(round(x, 12) for x in r[4:])) for r in got)
    assert near(run(spark, [*rows, (9, [1.0]), (10, [1.0, 2.0, 3.0])])) == near(run(spark, rows))


def test_large_numbers(spark):
    rows = [(i, [1e13 * i, 3e12 * (i % 3), float(i)]) for i in range(7)]
    got = run(spark, rows)
    _, s, _ = exact([v for _, v in rows])
    by = {i: dev for i, c, _, dev, *_ in got if c == 1}
    for i, v in rows:
        want = sum((7 * math.floor(256 * a) - b) ** 2 for a, b in zip(v, s))
        assert by[i] == (want if want < 2**63 else None)
    assert max(r[6] for r in got) < 1e-4
    run(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])])  # beyond a long: the nearest long


@pytest.mark.parametrize("lam", [np.linspace(1, 100, 40), np.r_[np.full(10, 5.0), 5 + 1e-9 * np.arange(10), np.linspace(6, 9, 10)], np.r_[5 + 1e-13 * np.arange(8), 7, 8], np.zeros(4), np.r_[np.zeros(12), 1:9]])
def test_refinement_reaches_double_precision(lam):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(len(lam), len(lam))))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(len(lam), dtype=np.longdouble) - (q.T @ q) / 2)
    a = (q * lam.astype(np.longdouble)) @ q.T
    values, x = whitening.eigen((a + a.T) / 2)
    size = max(1e-300, float(np.abs(lam).max()))
    assert float(np.abs(x.T @ x - np.eye(len(lam))).max()) < 1e-16
    assert float(np.abs(a @ x - x * values).max()) < 1e-16 * size
    assert np.all(np.diff(values) <= 0) and float(np.abs(np.sort(lam)[::-1] - values).max()) < 1e-16 * size


def test_close_eigenvalues_get_their_own_vectors():
    """float32 can't tell these apart; float64 only to some five digits of the vectors."""
    lam, n = np.array([1 + 2e-11, 1 + 1e-11, 1.0, 0.5]), 4
    h = np.eye(n, dtype=np.longdouble) - 2 * np.outer(*[np.array([1, 2, 3, 4], np.longdouble) / np.sqrt(np.longdouble(30))] * 2)
    _, x = whitening.eigen((h * lam.astype(np.longdouble)) @ h.T)
    assert float(np.abs(np.abs(x) - np.abs(h)).max()) < 1e-7
