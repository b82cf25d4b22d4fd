"""Tail probabilities as DuckDB SQL, for the queries that are held against SQL.

Each is a series of positive terms, so nothing cancels: good to about twelve
places wherever the queries' arguments lie.
"""

from __future__ import annotations

#: Terms of a series. With at most eight samples, and the smaller of the two sides of a beta, these are plenty.
TERMS = 600


def erfc(x: str) -> str:
    """Complementary error function of x >= 0."""
    term = f"exp((2 * n + 1) * ln({x}) + 2 * n * ln(2) - lgamma(2 * n + 2) + lgamma(n + 1) - ({x}) * ({x}))"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0 THEN 1.0 WHEN {x} > 6 THEN 0.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 200), lambda n: {term}))) END)"


def chi2(x: str) -> str:
    """Upper tail with one degree of freedom."""
    return erfc(f"sqrt(({x}) / 2)")


def normal_two_sided(z: str) -> str:
    return erfc(f"(abs({z}) / sqrt(2))")


def _lower(a: str, b: str, x: str) -> str:
    front = f"exp(({a}) * ln({x}) + ({b}) * ln(1 - ({x})) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma(({a}) + ({b})))"
    term = f"exp(lgamma(({a}) + ({b}) + n) - lgamma(({a}) + ({b})) - lgamma(({a}) + 1 + n) + lgamma(({a}) + 1) + n * ln({x}))"
    return f"(CASE WHEN {x} <= 0 THEN 0.0 ELSE {front} * list_sum(list_transform(range(0, {TERMS}), lambda n: {term})) END)"


def betainc(a: str, b: str, x: str) -> str:
    """Regularised incomplete beta function."""
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 1 THEN 1.0 WHEN {x} > (({a}) + 1) / (({a}) + ({b}) + 2) THEN 1 - {_lower(b, a, f'(1 - ({x}))')} ELSE {_lower(a, b, x)} END)"


def f1(x: str, df: str) -> str:
    """Upper tail of F(1, df), and both tails of t for x = t * t."""
    return betainc(f"({df}) / 2.0", "0.5", f"(({df}) / (({df}) + ({x})))")


def binomial(k: str, n: str, p: str) -> str:
    """P(X >= k)."""
    return f"(CASE WHEN {k} <= 0 THEN 1.0 ELSE {betainc(f'({k})', f'(({n}) - ({k}) + 1)', p)} END)"


def fisher_doubled(a: str, b: str, c: str, d: str) -> str:
    """min(1, 2 x tail) on the side of a's expectation, of whole numbers; rows (a, b) and (c, d)."""
    r, k, n = f"({a} + {b})", f"({a} + {c})", f"({a} + {b} + {c} + {d})"
    term = (
        f"exp(lgamma({k} + 1) - lgamma(x + 1) - lgamma({k} - x + 1) + lgamma({n} - {k} + 1) - lgamma({r} - x + 1) - lgamma({n} - {k} - {r} + x + 1) "
        f"- lgamma({n} + 1) + lgamma({r} + 1) + lgamma({n} - {r} + 1))"
    )
    up = f"list_sum(list_transform(range({a}, least({r}, {k}) + 1), lambda x: {term}))"
    down = f"list_sum(list_transform(range(greatest(0, {r} + {k} - {n}), {a} + 1), lambda x: {term}))"
    return f"(CASE WHEN {n} = 0 OR {r} = 0 OR {k} = 0 OR {r} = {n} OR {k} = {n} THEN 1.0 ELSE least(1.0, 2 * CASE WHEN {a} * {n} >= {r} * {k} THEN {up} ELSE {down} END) END)"


def normal_isf(p: str) -> str:
    """Inverse of the upper tail, for p from 1e-12 to 0.5: fifty halvings."""
    mid = "(s[1] + s[2]) / 2"
    tail = f"0.5 * {erfc('((s[1] + s[2]) / 2 / sqrt(2))')}"
    return f"list_reduce(list_prepend([0.0, 8.0], list_transform(range(0, 50), lambda i: [0.0, 0.0])), lambda s, i: CASE WHEN {tail} > {p} THEN [{mid}, s[2]] ELSE [s[1], {mid}] END)[1]"


def bh(source: str, p: str, q: str = "q", drop: bool = False) -> str:
    """source (a table) with column q by Benjamini and Hochberg; null p count as 1 in the number of tests, or with drop not at all."""
    n = f"count({p}) OVER ()" if drop else "count(*) OVER ()"
    rank = f"count({p}) OVER (ORDER BY {p} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    inner = f"SELECT *, {n} AS bh_n, {rank} AS bh_r FROM {source}"
    later = f"min({p} * bh_n / bh_r) OVER (ORDER BY {p} DESC NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"(SELECT * EXCLUDE (bh_n, bh_r), CASE WHEN {p} IS NOT NULL THEN least(1.0, {later}) END AS {q} FROM ({inner}))"
