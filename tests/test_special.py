import math

import numpy as np

from cytoframe.functions import special as sp


def test_normal_tails_invert():
    p = np.array([0.5, 0.1, 1e-5, 1e-50, 1e-299, 0.9])
    assert np.allclose(np.log(sp.norm_sf(sp.norm_isf(p))), np.log(p), rtol=1e-10, atol=1e-12)


def test_chi_square_closed_forms():
    x = np.array([0.0, 0.3, 2.0, 40.0])
    assert np.allclose(sp.chi2_sf(x, 2), np.exp(-x / 2), rtol=1e-12)
    assert np.allclose(sp.chi2_sf(x, 4), np.exp(-x / 2) * (1 + x / 2), rtol=1e-10)
    assert abs(sp.chi2_sf(np.array([3.841458820694124]))[0] - 0.05) < 1e-12


def test_f_and_t_closed_forms():
    t = np.array([0.0, 0.5, 3.0, 200.0])
    assert np.allclose(sp.t_sf2(t, np.ones(4)), 1 - 2 / np.pi * np.arctan(t), rtol=1e-9)
    assert np.allclose(sp.t_sf2(t, np.full(4, 2.0)), 1 - t / np.sqrt(2 + t * t), rtol=1e-6, atol=1e-12)
    assert np.allclose(sp.f_sf(t**2, 1.0, np.full(4, 7.0)), sp.t_sf2(t, np.full(4, 7.0)), rtol=1e-12)


def test_fisher_against_enumeration():
    def tail(a, b, c, d):
        n, r, k = a + b + c + d, a + b, a + c
        pmf = lambda x: math.comb(k, x) * math.comb(n - k, r - x) / math.comb(n, r)
        lo, hi = max(0, r + k - n), min(r, k)
        xs = range(a, hi + 1) if a * n >= r * k else range(lo, a + 1)
        return min(1.0, 2 * sum(map(pmf, xs)))

    rows = [(8, 2, 1, 9), (3, 3, 3, 3), (0, 5, 5, 0), (10, 1, 4, 7)]
    assert np.allclose(sp.fisher_doubled(*map(list, zip(*rows))), [tail(*r) for r in rows])
    assert sp.fisher_doubled([0], [0], [0], [0])[0] == 1


def test_binomial_tail():
    want = sum(math.comb(20, i) * 0.3**i * 0.7 ** (20 - i) for i in range(9, 21))
    assert abs(sp.binom_sf(np.array([8]), np.array([20]), 0.3)[0] - want) < 1e-12
    assert sp.binom_sf(np.array([-1, 20]), np.array([20, 20]), 0.3).tolist() == [1.0, 0.0]


def test_exact_tests_side_by_side(monkeypatch):
    """Against sums over whole tables in exact fractions, in pieces of any size."""
    from fractions import Fraction
    from math import comb

    rng = np.random.default_rng(4)
    rows = [tuple(int(v) for v in rng.integers(0, 30, 4)) for _ in range(60)] + [(0, 0, 0, 0), (0, 0, 3, 4), (5, 0, 7, 0), (0, 9, 9, 0), (9, 0, 0, 9), (400, 3, 2, 390)]
    doubled, both = [], []
    for a, b, c, d in rows:
        n, r, k = a + b + c + d, a + b, a + c
        p = {x: Fraction(comb(k, x) * comb(n - k, r - x), comb(n, r)) for x in range(max(0, r + k - n), min(r, k) + 1)}
        trivial = not r or not k or r == n or k == n
        doubled.append(1.0 if trivial else float(min(1, 2 * sum(v for x, v in p.items() if (x >= a if a * n >= r * k else x <= a)))))
        both.append(float(sum(v for v in p.values() if v <= p[a] * Fraction(10_000_001, 10_000_000))) if n else 1.0)
    cols = list(zip(*rows))
    for terms in (1, 50, 1 << 21):
        monkeypatch.setattr(sp, "_TERMS", terms)
        assert np.allclose(sp.fisher_doubled(*cols), doubled, rtol=1e-9) and np.allclose(sp.fisher_two_sided(*cols), both, rtol=1e-6)
    big = sp.fisher_doubled([3_000_000], [2_000_000], [2_999_000], [2_001_000])  # beyond the table
    assert 0 < big[0] < 1
    assert len(sp.fisher_doubled([], [], [], [])) == 0


def test_log_gamma_and_t_to_thirteen_places():
    """Six digits of a million rows agree with SQL only where the tails are far better than six digits."""
    x = np.linspace(0.05, 20, 400)
    assert np.abs(sp.lgamma(x) - [math.lgamma(v) for v in x]).max() < 1e-13
    t = np.linspace(0, 20, 401)
    assert np.abs(sp.t_sf2(t, np.full(401, 1.0)) - (1 - 2 / np.pi * np.arctan(t))).max() < 1e-13
    assert np.abs(sp.t_sf2(t, np.full(401, 4.0)) - (1 - t / np.sqrt(4 + t * t) * (1.5 - t * t / (8 + 2 * t * t)))).max() < 1e-13
