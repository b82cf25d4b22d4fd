"""Regression per site over any design, and sample-level models: clock and deconvolution."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.tables import written


#: What a formula may do to a column of numbers.
TRANSFORMS = {"log": np.log, "log2": np.log2, "log10": np.log10, "exp": np.exp, "sqrt": np.sqrt, "center": lambda v: v - v.mean(), "standardize": lambda v: (v - v.mean()) / v.std()}


def _terms(formula: str, covariates: list[str] | tuple[str, ...]) -> tuple[bool, list[tuple[str, ...]]]:
    """(whether there is an intercept, terms as factors): a * b is a + b + a:b, a term behind a minus goes, `0` or `- 1` takes the intercept; main effects first."""
    intercept, terms = True, []
    text = formula.split("~", 1)[-1]
    for sign, term in re.findall(r"([+-]?)\s*((?:[^+\-(]|\([^)]*\))+)", text):
        term = term.strip()
        if term in ("0", "1"):
            intercept = (term == "1") == (sign != "-")
            continue
        made: list[tuple[str, ...]] = [()]
        for part in re.split(r"\*(?!\*)(?![^(]*\))", term):
            own = tuple(f.strip() for f in part.split(":"))
            made = made + [(*m, *own) for m in made]
        made = [m for m in dict.fromkeys(made) if m]
        if any(not f for m in made for f in m):
            raise ValueError(f"term {term!r} is not understood")
        terms = [t for t in terms if t not in made] if sign == "-" else [*terms, *(m for m in made if m not in terms)]
    terms += [(c,) for c in covariates if (c,) not in terms]
    return intercept, sorted(terms, key=len)


def design(obs: list[dict], formula: str = "~", covariates: list[str] | tuple[str, ...] = ()) -> tuple[list[str], np.ndarray]:
    """(term names, matrix) of a formula over rows of samples, and covariates added to it.

    Numbers are taken as they are, text and C(name) as levels against the first
    sorted one; without an intercept the first factor of levels has a column for
    each. Terms: a + b, a:b, a * b, - a, 0 or - 1, I(a ** 2), and the functions
    of TRANSFORMS, with or without `np.` before. A missing value is an
    error.
    """
    intercept, terms = _terms(formula, covariates)

    def values(name: str) -> list:
        if name not in obs[0]:
            raise ValueError(f"no column {name!r}; there are {sorted(obs[0])}")
        col = [o[name] for o in obs]
        if any(v is None or v != v for v in col):
            raise ValueError(f"column {name!r} has missing values")
        return col

    def numbers(name: str) -> np.ndarray:
        return np.array([float(v) for v in values(name)])

    whole = not intercept

    def factor(name: str) -> list[tuple[str, np.ndarray]]:
        nonlocal whole
        power, call = re.fullmatch(r"I\((\w+)\s*\*\*\s*(\d+)\)", name), re.fullmatch(r"(?:np\.)?(\w+)\((\w+)\)", name)
        if power:
            return [(name, numbers(power[1]) ** int(power[2]))]
        if call and call[1] in TRANSFORMS:
            return [(name, TRANSFORMS[call[1]](numbers(call[2])))]
        if call and call[1] != "C" or not call and not re.fullmatch(r"\w+", name):
            raise ValueError(f"factor {name!r} is not understood")
        col = values(call[2] if call else name)
        if not call:
            try:
                return [(name, np.array([float(v) for v in col]))]
            except (TypeError, ValueError):
                pass
        levels, all_, whole = sorted({str(v) for v in col}), whole, False
        return [(f"{name}[{'' if all_ else 'T.'}{lv}]", np.array([float(str(v) == lv) for v in col])) for lv in levels[0 if all_ else 1 :]]

    names, cols = (["Intercept"], [np.ones(len(obs))]) if intercept else ([], [])
    for t in terms:
        made = [("", np.ones(len(obs)))]
        for part in t:
            made = [(f"{a}:{n}".strip(":"), x * y) for a, x in made for n, y in factor(part)]
        names += [n for n, _ in made]
        cols += [c for _, c in made]
    if not names:
        raise ValueError("a formula without terms")
    return names, np.stack(cols, axis=1)


def contrast(spec: str | list | np.ndarray, names: list[str]) -> np.ndarray:
    """Rows over term names: of `a - b`, `2 * a + b` or `a = b`, of several such after commas (tested jointly), or numbers as they are."""
    if not isinstance(spec, str):
        rows = np.atleast_2d(np.asarray(spec, float))
        if rows.shape[1] != len(names):
            raise ValueError(f"a contrast has a number for each of {names}")
        return rows
    out = []
    for text in spec.split(","):
        left, _, right = text.partition("=")
        row = np.zeros(len(names))
        for side, sign in ((left, 1.0), (right, -1.0)):
            for s, num, name in re.findall(r"([+-]?)\s*(?:(\d+\.?\d*)\s*\*\s*)?([A-Za-z_][\w.\[\]:()]*)", side):
                if name not in names:
                    raise ValueError(f"no term {name!r}")
                row[names.index(name)] += sign * (-1 if s == "-" else 1) * float(num or 1)
        out.append(row)
    return np.array(out)


#: Fixed values that the fits share with published figures: bound of the linear predictor, of a fitted probability, and when a fit counts as separated.
ETA_BOUND, MU_BOUND, SEPARATED = 30.0, 1e-6, 29.999


def irls(m: np.ndarray, n: np.ndarray, x: np.ndarray, rounds: int = 25, tol: float = 1e-6) -> dict[str, np.ndarray]:
    """Binomial logistic fits of sites x samples at once: beta, cov, deviance, pearson, n_eff; NaN where it separates or has under two samples."""
    some = n > 0
    y = np.where(some, m / np.maximum(n, 1), 0.5)
    p = x.shape[1]

    def solve(w, z):
        a = np.einsum("sj,ji,jk->sik", w, x, x) + 1e-10 * np.eye(p)
        return np.linalg.solve(a, np.einsum("sj,ji,sj->si", w, x, z)[..., None])[..., 0]

    start = np.clip(y, MU_BOUND, 1 - MU_BOUND)
    beta = solve(n.astype(float), np.log(start / (1 - start)))
    live = np.arange(len(m))  # a site that has converged stays as it is, whatever the others do
    for _ in range(rounds):
        if not len(live):
            break
        eta = np.clip(beta[live] @ x.T, -ETA_BOUND, ETA_BOUND)
        mu = np.clip(1 / (1 + np.exp(-eta)), MU_BOUND, 1 - MU_BOUND)
        new = solve(n[live] * mu * (1 - mu), eta + (y[live] - mu) / (mu * (1 - mu)))
        moved = np.abs(new - beta[live]).max(axis=1) >= tol
        beta[live] = new
        live = live[moved]
    eta = np.clip(beta @ x.T, -ETA_BOUND, ETA_BOUND)
    mu = np.clip(1 / (1 + np.exp(-eta)), MU_BOUND, 1 - MU_BOUND)
    a = np.einsum("sj,ji,jk->sik", n * mu * (1 - mu), x, x) + 1e-10 * np.eye(p)
    with np.errstate(divide="ignore", invalid="ignore"):
        dev = 2 * np.where(some, np.where(m > 0, m * np.log(np.maximum(y, 1e-300) / mu), 0) + np.where(n - m > 0, (n - m) * np.log(np.maximum(1 - y, 1e-300) / (1 - mu)), 0), 0).sum(axis=1)
    pearson = np.where(some, n * (y - mu) ** 2 / (mu * (1 - mu)), 0).sum(axis=1)
    n_eff = some.sum(axis=1)
    bad = (n_eff < 2) | ((np.abs(eta) >= SEPARATED) & some).any(axis=1)
    beta[bad] = np.nan
    dev, pearson = np.where(bad, np.nan, dev), np.where(bad, np.nan, pearson)
    return {"beta": beta, "cov": np.linalg.inv(a), "deviance": dev, "pearson": pearson, "n_eff": n_eff}


def _fits(sites: DataFrame, samples: list[str], x_full: np.ndarray, x_reduced: np.ndarray | None, coef: int, contrasts: np.ndarray | None, block: int) -> DataFrame:
    """Per site: the statistic, estimate and variance at dispersion 1, Pearson's sum and the residual degrees of freedom."""
    own = [F.sum(F.when(F.col("sample") == s, F.col(c))).alias(f"{k}{j}") for j, s in enumerate(samples) for k, c in (("m", "n_meth"), ("n", "coverage"))]
    wide = sites.where(F.col("sample").isin(samples)).groupBy("chrom", "pos").agg(*own)
    rows = None if contrasts is None else np.atleast_2d(np.asarray(contrasts, float))

    def run(batches):
        for g in batches:
            for at in range(0, len(g), block):
                part = g.iloc[at : at + block]
                m, n = (np.nan_to_num(part[[f"{k}{j}" for j in range(len(samples))]].to_numpy(float)) for k in "mn")
                full = irls(m, n, x_full)
                if rows is None:
                    red = irls(m, n, x_reduced)
                    stat, est, var = np.maximum(red["deviance"] - full["deviance"], 0), full["beta"][:, coef], full["cov"][:, coef, coef]
                else:
                    v = full["beta"] @ rows.T
                    mid = np.einsum("ai,sij,bj->sab", rows, full["cov"], rows)
                    stat = np.einsum("sa,sab,sb->s", np.nan_to_num(v), np.linalg.pinv(np.nan_to_num(mid)), np.nan_to_num(v)) / len(rows)
                    stat[np.isnan(v).any(axis=1) | (full["n_eff"] < x_full.shape[1] + 1)] = np.nan
                    est, var = v[:, 0], mid[:, 0, 0]
                yield pd.DataFrame({
                    "chrom": part["chrom"], "pos": part["pos"], "coef": est, "_var": var, "_stat": stat, "_pearson": full["pearson"],
                    "df_resid": np.maximum(full["n_eff"] - x_full.shape[1], 1).astype(int), "_eta": full["beta"][:, 0],
                })

    out = wide.mapInPandas(run, "chrom string, pos int, coef double, _var double, _stat double, _pearson double, df_resid int, _eta double")
    return out.select("chrom", "pos", "df_resid", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("coef", "_var", "_stat", "_pearson", "_eta")))


def with_fit_dispersion(fits: DataFrame, mode: str = "site", min_sites: int = 100, pseudo: float = 4.0) -> DataFrame:
    """fits with phi: Pearson's sum over its degrees of freedom, by site, by chromosome, or mixed (shrink: with a fixed weight, eb: with one from the spread of the sites' own)."""
    x = fits.withColumn("_site", F.greatest(F.lit(1.0), F.coalesce(F.col("_pearson") / F.col("df_resid"), F.lit(1.0))))
    if mode == "site":
        return x.withColumn("phi", F.col("_site")).drop("_site")
    ok = F.col("_pearson").isNotNull()
    by = x.groupBy("chrom").agg(
        F.count_if(ok).alias("_k"), (F.sum(F.when(ok, F.col("_pearson"))) / F.sum(F.when(ok, F.col("df_resid")))).alias("_all"),
        F.avg(F.when(ok, F.col("_site"))).alias("_m"), F.var_pop(F.when(ok, F.col("_site"))).alias("_v"),
    )
    enough = F.col("_k") >= min_sites
    spread = enough & (F.col("_v") > 1e-9)
    by = by.select(
        "chrom", F.greatest(F.lit(1.0), F.when(enough, F.col("_all")).otherwise(1.0)).alias("_chrom"),
        F.when(spread, F.greatest(F.lit(1.0), 2 * (F.col("_m") ** 2 / F.when(spread, F.col("_v")) + 2))).otherwise(pseudo).alias("_w"),
    )
    x = x.join(by, "chrom")
    if mode == "chrom":
        return x.withColumn("phi", F.col("_chrom")).drop("_site", "_chrom", "_w")
    w = F.col("_w") if mode == "eb" else F.lit(pseudo)
    mixed = F.greatest(F.lit(1.0), (F.col("df_resid") * F.col("_site") + w * F.col("_chrom")) / (F.col("df_resid") + w))
    return x.withColumn("phi", F.when(ok, mixed).otherwise(F.col("_chrom"))).drop("_site", "_chrom", "_w")


def glm(
    sites: DataFrame, samples: list[str], x_full: np.ndarray, x_reduced: np.ndarray | None = None, coef: int = 1, contrasts: np.ndarray | None = None,
    reference: str = "adaptive", dispersion: str = "site", block: int = 4096,
) -> DataFrame:
    """Per site: the deviance test of full against reduced, or Wald's test of contrasts; with bounds of the difference that coef means from the fit's intercept."""
    x_full = np.asarray(x_full, float)
    k = 1 if contrasts is None else len(np.atleast_2d(contrasts))
    fits = _fits(sites, samples, x_full, None if x_reduced is None else np.asarray(x_reduced, float), coef, contrasts, block)
    x = with_fit_dispersion(fits if dispersion == "site" else written(fits), dispersion)
    x = x.withColumns({"stat": F.col("_stat") / F.col("phi"), "coef_se": F.sqrt(F.col("_var") * F.col("phi"))})
    use_f = {"adaptive": F.col("phi") > 1, "F": F.lit(True), "chi2": F.lit(False)}[reference]
    p = F.when(use_f, C.f_tail(F.col("stat"), F.lit(float(k)), F.col("df_resid").cast("double"))).otherwise(C.chi2_tail_of(F.col("stat") * k, F.lit(float(k))))
    lo, hi = C.delta_ci(F.col("coef"), F.col("coef_se"), F.col("_eta"))
    return x.select("chrom", "pos", "phi", "df_resid", "coef", "coef_se", "stat", p.alias("pvalue"), lo.alias("meth_diff_ci_lo"), hi.alias("meth_diff_ci_hi"))


def two_group_glm(sites: DataFrame, case: list[str], control: list[str], dispersion: str = "eb", reference: str = "adaptive") -> DataFrame:
    """The likelihood-ratio test of a treatment term; dispersion by site is mixed with the chromosome's below six samples."""
    samples = [*case, *control]
    x = np.stack([np.ones(len(samples)), [1.0] * len(case) + [0.0] * len(control)], axis=1)
    mode = "shrink" if dispersion == "site" and len(samples) < 6 else dispersion
    return glm(sites, samples, x, x[:, :1], dispersion=mode, reference=reference)


def age_clock(sites: DataFrame, coefficients: DataFrame, manifest: DataFrame, intercept: float = 0.0, transform: str | None = None) -> DataFrame:
    """intercept + sum of coefficient x beta; a sample's missing site counts with the other samples' mean."""
    panel = manifest.where("chrom IS NOT NULL AND pos IS NOT NULL").join(coefficients, "cpg_id").select("chrom", "pos", "cpg_id", "coefficient")
    samples = sites.select("sample").distinct()
    b = sites.join(panel, ["chrom", "pos"]).groupBy("sample", "cpg_id", "coefficient").agg(F.try_divide(F.sum("n_meth").cast("double"), F.sum("coverage")).alias("beta"))
    seen = b.groupBy("cpg_id", "coefficient").agg(F.avg("beta").alias("mean_beta")).where("mean_beta IS NOT NULL")
    full = samples.crossJoin(seen).join(b.select("sample", "cpg_id", "beta"), ["sample", "cpg_id"], "left")  # samples x panel, both short
    raw = full.groupBy("sample").agg((F.lit(intercept) + F.sum(F.col("coefficient") * F.coalesce("beta", "mean_beta"))).alias("x"), F.count("beta").alias("n_found"))
    age = F.when(F.col("x") < 0, F.exp("x") - 1).otherwise(21 * F.col("x") + 20) if transform == "horvath" else F.col("x")
    return raw.select("sample", age.alias("age"), "n_found")


def nnls_of_sums(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Least squares with non-negative coefficients by the active-set method, from the sums g = A'A and c = A'b."""
    n = len(c)
    x, on, least = np.zeros(n), np.zeros(n, bool), 1e-12 * max(1.0, float(np.abs(c).max(initial=0)))
    for _ in range(10 * n):
        w = c - g @ x
        w[on] = -np.inf
        if on.all() or w.max() <= least:
            break
        on[int(w.argmax())] = True
        while True:
            s = np.zeros(n)
            s[on] = np.linalg.lstsq(g[np.ix_(on, on)], c[on], rcond=None)[0]
            if (s[on] > 0).all():
                x = s
                break
            low = on & (s <= 0)
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            on &= x > 1e-14
            x[~on] = 0
    return x


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same from the rows themselves."""
    return nnls_of_sums(a.T @ a, a.T @ b)


def deconvolve(sites: DataFrame, reference: DataFrame, manifest: DataFrame, cell_types: list[str]) -> DataFrame:
    """(sample, cell_type, proportion), non-negative and summing to 1; null for a sample that covers no site of the panel.

    Each task sums the products of cell types and levels by sample; what meets
    for a sample is a number for each two cell types, not its panel.
    """
    k = len(cell_types)
    panel = manifest.where("chrom IS NOT NULL AND pos IS NOT NULL").join(reference, "cpg_id").select("chrom", "pos", *cell_types)
    x = sites.where("coverage > 0").join(panel, ["chrom", "pos"]).select("sample", (F.col("n_meth") / F.col("coverage")).alias("beta"), *cell_types)

    def sums(batches):
        for b in batches:
            names = b.column(0).dictionary_encode()
            code = names.indices.to_numpy()
            a = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:]], axis=1)  # level first
            for i, name in enumerate(names.dictionary.to_pylist()):
                own = a[code == i]
                p = (own[:, 1:].T @ own).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(p), pa.string()), pa.array(np.arange(len(p), dtype=np.int32)), pa.array(p)], ["sample", "at", "v"])

    total = x.mapInArrow(sums, "sample string, at int, v double").groupBy("sample", "at").agg(F.sum("v").alias("v"))

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        p = g.sort_values("at")["v"].to_numpy().reshape(k, k + 1)
        got = nnls_of_sums(p[:, 1:], p[:, 0])
        return pd.DataFrame({"sample": g["sample"].iloc[0], "cell_type": cell_types, "proportion": got / got.sum() if got.sum() > 0 else got})

    got = total.groupBy("sample").applyInPandas(solve, "sample string, cell_type string, proportion double")
    every = sites.select("sample").distinct().withColumn("cell_type", F.explode(F.array(*map(F.lit, cell_types))))
    return every.join(got, ["sample", "cell_type"], "left")


