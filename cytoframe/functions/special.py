"""Tail probabilities in numpy: normal, chi-square, F, t, hypergeometric, binomial."""

from __future__ import annotations

import math

import numpy as np

def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x > 0, to about 1e-14: eight steps up, then Stirling's series, whose first term left out is below 1e-16 there."""
    x = np.asarray(x, float)
    y = x + 8.0
    low = np.log(x)
    for k in range(1, 8):
        low += np.log(x + k)
    r = 1 / (y * y)
    series = np.zeros_like(y)
    for c in (3617 / 122400, -1 / 156, 691 / 360360, -1 / 1188, 1 / 1680, -1 / 1260, 1 / 360, -1 / 12):  # from the smallest
        series = series * r - c
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series / y - low


def erfc(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return np.fromiter(map(math.erfc, x.ravel().tolist()), float, x.size).reshape(x.shape)


def norm_sf(z: np.ndarray) -> np.ndarray:
    return 0.5 * erfc(np.asarray(z, float) / math.sqrt(2))


def norm_isf(p: np.ndarray) -> np.ndarray:
    """Inverse upper tail, to 1e-300: a start from the tail's expansion, then Newton on its logarithm."""
    p = np.atleast_1d(np.asarray(p, float))
    upper = np.minimum(p, 1 - p)
    upper = np.maximum(upper, 1e-300)
    t = np.sqrt(-2 * np.log(upper))
    z = np.maximum(t - np.log(np.maximum(t * math.sqrt(2 * math.pi), 1.0)) / np.maximum(t, 1e-9), 0.0)
    for _ in range(30):
        sf = np.maximum(norm_sf(z), 5e-324)
        hazard = np.exp(-0.5 * z * z - 0.5 * math.log(2 * math.pi) - np.log(sf))
        step = (np.log(sf) - np.log(upper)) / hazard
        z = np.maximum(z + step, 0.0)
        if np.max(np.abs(step), initial=0) < 1e-13:
            break
    return np.where(p <= 0.5, z, -z)


def chi2_sf(x: np.ndarray, df: float = 1) -> np.ndarray:
    """Upper tail of chi-square; one degree of freedom by erfc, others by the incomplete gamma function."""
    x = np.maximum(np.asarray(x, float), 0.0)
    if df == 1:
        return erfc(np.sqrt(x / 2))
    a, h = df / 2.0, x / 2.0
    out = np.ones_like(h)
    small = h < a + 1
    if small.any():
        s = h[small]
        term = total = np.full_like(s, 1 / a)
        for n in range(1, 500):
            term = term * s / (a + n)
            total = total + term
        out[small] = 1 - np.where(s > 0, np.exp(-s + a * np.log(np.maximum(s, 1e-300)) - math.lgamma(a)) * total, 0)
    if (~small).any():
        s = h[~small]
        b = s + 1 - a
        c, d = np.full_like(s, 1e300), 1 / b
        f = d
        for i in range(1, 300):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            f = f * c * d
        out[~small] = np.exp(-s + a * np.log(s) - math.lgamma(a)) * f
    return np.clip(out, 0, 1)


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, on the side where that converges fast."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    x = np.clip(x, 0, 1)
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(y) + q * np.log1p(-y))
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    out = np.where((y <= 0), 0.0, front * f / p)
    return np.where(flip, 1 - out, out)


def f_sf(x: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    x = np.maximum(np.asarray(x, float), 0.0)
    d1, d2 = np.asarray(d1, float), np.asarray(d2, float)
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_sf2(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Both tails of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


#: Tables of counts that are summed at once, in terms of their tails.
_TERMS = 1 << 21


def _log_factorials(most: int):
    """Of whole numbers up to most: a table, or where that would be long the function."""
    if most > 1 << 22:
        return lambda k: lgamma(k + 1.0)
    table = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, most + 1)))))
    return lambda k: table[k]


def _tails(low: np.ndarray, high: np.ndarray):
    """Pieces of rows with their terms: (rows, which row of the piece each term is of, terms, where each row's terms begin)."""
    sizes = high - low + 1
    ends = np.cumsum(sizes)
    at = 0
    while at < len(low):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TERMS, "right")), at + 1)
        own = sizes[at:to]
        of, starts = np.repeat(np.arange(to - at), own), np.cumsum(own) - own
        yield slice(at, to), of, np.arange(int(own.sum())) - starts[of] + low[at:to][of], starts
        at = to


def fisher_doubled(a, b, c, d) -> np.ndarray:
    """min(1, 2 x tail) of the hypergeometric on the side of a's expectation; rows (a, b) and (c, d)."""
    a, b, c, d = (np.asarray(v, np.int64) for v in (a, b, c, d))
    n, r, k = a + b + c + d, a + b, a + c
    out = np.ones(len(a))
    some = np.flatnonzero((r > 0) & (k > 0) & (r < n) & (k < n))
    if not len(some):
        return out
    a, n, r, k = a[some], n[some], r[some], k[some]
    upper = a * n >= r * k
    f = _log_factorials(int(n.max()))
    whole = f(k) + f(n - k) - f(n) + f(r) + f(n - r)
    for rows, of, x, starts in _tails(np.where(upper, a, np.maximum(0, r + k - n)), np.where(upper, np.minimum(r, k), a)):
        nn, rr, kk = n[rows][of], r[rows][of], k[rows][of]
        lp = whole[rows][of] - f(x) - f(kk - x) - f(rr - x) - f(nn - kk - rr + x)
        out[some[rows]] = np.minimum(1.0, 2 * np.add.reduceat(np.exp(lp), starts))
    return out


def binom_sf(k: np.ndarray, n: np.ndarray, p: np.ndarray | float) -> np.ndarray:
    """P(X > k)."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    out = np.where(k < 0, 1.0, 0.0)
    mid = (k >= 0) & (k < n)
    if mid.any():
        out[mid] = betainc(k[mid] + 1, n[mid] - k[mid], p[mid])
    return out


def fisher_two_sided(a, b, c, d) -> np.ndarray:
    """Sum of the probabilities of all tables at most as likely as the one seen; rows (a, b) and (c, d)."""
    a, b, c, d = (np.asarray(v, np.int64) for v in (a, b, c, d))
    n, r, k = a + b + c + d, a + b, a + c
    out = np.ones(len(a))
    some = np.flatnonzero(n > 0)
    if not len(some):
        return out
    a, n, r, k = a[some], n[some], r[some], k[some]
    f, low = _log_factorials(int(n.max())), np.maximum(0, r + k - n)
    for rows, of, x, starts in _tails(low, np.minimum(r, k)):
        nn, rr, kk = n[rows][of], r[rows][of], k[rows][of]
        lp = -f(x) - f(kk - x) - f(rr - x) - f(nn - kk - rr + x)
        p = np.exp(lp - np.maximum.reduceat(lp, starts)[of])
        seen = p[starts + a[rows] - low[rows]]
        out[some[rows]] = np.minimum(1.0, np.add.reduceat(np.where(p <= seen[of] * (1 + 1e-7), p, 0.0), starts) / np.add.reduceat(p, starts))
    return out
