"""Column expressions for proportions, effect sizes and intervals, and vectorised tails."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from . import special

EPS = 1e-6


def clip(x: Column, low: float, high: float) -> Column:
    """x within low..high; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def beta(m: Column, c: Column) -> Column:
    """m / c, null without coverage."""
    return F.try_divide(m.cast("double"), c)


def logit(b: Column) -> Column:
    b = clip(b, EPS, 1 - EPS)
    return F.ln(b / (1 - b))


def logit_jacobian(b: Column) -> Column:
    b = clip(b, EPS, 1 - EPS)
    return 1 / (b * (1 - b))


def log2_odds_ratio(case: Column, control: Column) -> Column:
    a, b = clip(case, EPS, 1 - EPS), clip(control, EPS, 1 - EPS)
    return F.log2((a / (1 - a)) / (b / (1 - b)))


def welch_ci(case: Column, var_case: Column, control: Column, var_control: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Difference +- z standard errors, within -1..1; var_*: variances of the means."""
    diff, half = case - control, z * F.sqrt(var_case + var_control)
    return clip(diff - half, -1, 1), clip(diff + half, -1, 1)


def delta_ci(coef: Column, se: Column, reference: Column | float = 0.0, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the difference of proportions that a coefficient on the log-odds scale means at a reference log-odds."""

    def at(eta: Column) -> Column:
        return 1 / (1 + F.exp(-eta))

    ref = reference if isinstance(reference, Column) else F.lit(reference)
    return at(ref + coef - z * se) - at(ref), at(ref + coef + z * se) - at(ref)


def newcombe_ci(m_a: Column, c_a: Column, m_b: Column, c_b: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Hybrid of two Wilson intervals for the difference of proportions."""

    def wilson(m, n):
        p = F.try_divide(m.cast("double"), n)
        mid = (p + z * z / (2 * n)) / (1 + z * z / n)
        half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
        return p, mid - half, mid + half

    p1, l1, u1 = wilson(m_a, c_a)
    p2, l2, u2 = wilson(m_b, c_b)
    return p1 - p2 - F.sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2), p1 - p2 + F.sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2)


@pandas_udf(DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    return pd.Series(special.chi2_sf(x.to_numpy(float))).where(x.notna().to_numpy())


@pandas_udf(DoubleType())
def f1_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of F(1, df)."""
    ok = (x.notna() & df.notna()).to_numpy()
    return pd.Series(special.f_sf(x.fillna(0).to_numpy(float), 1.0, df.fillna(1).to_numpy(float))).where(ok)


@pandas_udf(DoubleType())
def f_tail(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    ok = (x.notna() & d2.notna()).to_numpy()
    return pd.Series(special.f_sf(x.fillna(0).to_numpy(float), d1.to_numpy(float), d2.fillna(1).to_numpy(float))).where(ok)


@pandas_udf(DoubleType())
def chi2_tail_of(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail with the degrees of freedom of the column, one value for all rows or a few."""
    v, d, out = x.fillna(0).to_numpy(float), df.to_numpy(float), pd.Series(float("nan"), index=range(len(x)))
    for k in set(d.tolist()):
        out[d == k] = special.chi2_sf(v[d == k], k)
    return out.where(x.notna().to_numpy())


@pandas_udf(DoubleType())
def t_tails(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = (t.notna() & df.notna()).to_numpy()
    return pd.Series(special.t_sf2(t.fillna(0).to_numpy(float), df.fillna(1).to_numpy(float))).where(ok)


@pandas_udf(DoubleType())
def normal_isf(p: pd.Series) -> pd.Series:
    return pd.Series(special.norm_isf(p.fillna(0.5).to_numpy(float))).where(p.notna().to_numpy())


@pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    return pd.Series(special.norm_sf(z.fillna(0).to_numpy(float))).where(z.notna().to_numpy())


@pandas_udf(DoubleType())
def fisher_tail(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(special.fisher_doubled(a, b, c, d))


@pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided by the tables at most as likely."""
    return pd.Series(special.fisher_two_sided(a, b, c, d))


@pandas_udf(DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k)."""
    return pd.Series(special.binom_sf(k.to_numpy(float) - 1, n.to_numpy(float), p.to_numpy(float)))
