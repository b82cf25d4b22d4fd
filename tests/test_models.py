"""Queries that SQL does not express, against brute force and closed forms."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe.functions import special
from cytoframe.operators import fdr, models, profiles, qc, sequence, tests
from cytoframe.plans import catalog
from cytoframe.sources import views as V

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sites(spark):
    return V.sites(spark, DATA).cache()


@pytest.fixture(scope="module")
def wide(sites):
    return sites.toPandas().sort_values(["sample", "chrom", "pos"])


def enumerated(y, means, self_loop, gauss):
    """(best path, posteriors) over every path of states."""
    k, n = len(means), len(y)
    best, top, post = None, -np.inf, np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        lp = -np.log(k)
        for t, s in enumerate(path):
            if t:
                lp += np.log(self_loop if s == path[t - 1] else (1 - self_loop) / (k - 1))
            if np.isnan(y[t]):
                lp -= np.log(k)
            elif gauss:
                lp += -0.5 * ((y[t] - means[s]) / 0.1) ** 2 - np.log(0.1 * np.sqrt(2 * np.pi))
            else:
                lp += y[t] * np.log(means[s]) + (1 - y[t]) * np.log(1 - means[s])
        if lp > top + 1e-12:
            best, top = path, lp
        for t, s in enumerate(path):
            post[t, s] += np.exp(lp)
    return list(best), post / post.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("means, gauss", [([0.15, 0.65], False), ([-0.2, 0.0, 0.2], True)])
def test_segments_against_every_path(means, gauss):
    rng = np.random.default_rng(4)
    for loop in (0.6, 0.95):
        y = rng.uniform(-0.3, 0.3, 7) if gauss else rng.random(7)
        y[3] = np.nan
        path, post = sequence.hmm_segment(y, means, loop, "gaussian" if gauss else "bernoulli")
        want, p = enumerated(y, means, loop, gauss)
        assert path.tolist() == want and np.allclose(post, p)


def runs(path, pos, state):
    out, at = [], 0
    for s, g in itertools.groupby(path):
        n = len(list(g))
        if s == state:
            out.append((pos[at], pos[at + n - 1] + 1, n))
        at += n
    return out


def test_hmm_states_and_low_regions(spark, wide):
    states = {(r["sample"], r["chrom"], r["pos"]): (r["state"], r["posterior"]) for r in catalog.QUERIES["hmm_states"](spark, DATA).collect()}
    low = {(r["sample"], r["chrom"], r["start"], r["end"], r["n_cpgs"]) for r in catalog.QUERIES["hmr_lmr"](spark, DATA).collect()}
    n, want = 0, set()
    for (s, c), g in wide[wide.coverage > 0].groupby(["sample", "chrom"]):
        beta = (g.n_meth / g.coverage).to_numpy()
        if len(g) < 5:
            continue
        path, post = sequence.hmm_segment(beta, [0.15, 0.65], 0.85)
        for p, a, b in zip(g.pos, path, post[:, -1]):
            assert states[s, c, p][0] == a and abs(states[s, c, p][1] - b) < 1e-6
            n += 1
        path, _ = sequence.hmm_segment(beta, [0.25, 0.75], 0.85)
        at = 0
        for a, b, k in runs(path.tolist(), g.pos.tolist(), 0):
            at = g.pos.tolist().index(a)
            if k >= 4 and beta[at : at + k].mean() < 0.5:
                want.add((s, c, a, b, k))
    assert n == len(states) and low == want


def test_smoothers_against_their_formulas(spark, wide):
    g = {(r["sample"], r["chrom"], r["pos"]): r["smoothed"] for r in catalog.QUERIES["smooth_gaussian"](spark, DATA).collect()}
    b = {(r["sample"], r["chrom"], r["pos"]): r["smoothed"] for r in catalog.QUERIES["smooth_bsmooth"](spark, DATA).collect()}
    assert len(g) == len(b) == int((wide.coverage > 0).sum())
    part = wide[(wide["sample"] == "s1") & (wide.chrom == "chr1") & (wide.coverage > 0)]
    pos, beta, cov = part.pos.to_numpy(float), (part.n_meth / part.coverage).to_numpy(float), part.coverage.to_numpy(float)
    grid = np.arange(pos[0], pos[-1] + 50, 50)
    gb, gw = np.interp(grid, pos, beta), np.maximum(np.interp(grid, pos, cov), 0.1)
    far = np.arange(-80, 81)
    k = np.exp(-0.5 * (far / 20) ** 2)
    at = np.clip(np.arange(len(grid))[:, None] + far, 0, len(grid) - 1)
    filtered = (gb[at] * gw[at] * k).sum(axis=1) / (gw[at] * k).sum(axis=1)
    assert np.allclose(np.interp(pos, grid, filtered), [g["s1", "chr1", int(p)] for p in pos], atol=1e-6)
    for i in range(0, len(pos), 3):
        d = np.sort(np.abs(pos[max(0, i - 70) : i + 71] - pos[i]))
        width = max(1000.0, d[min(70, len(d)) - 1] + 1)
        inside = np.abs(pos - pos[i]) <= width
        u = (pos[inside] - pos[i]) / width
        w = np.sqrt(np.maximum(1 - np.abs(u) ** 3, 0) ** 3 * cov[inside])
        x = np.vander(u, min(2, inside.sum() - 1) + 1, increasing=True)
        fit = np.linalg.lstsq(x * w[:, None], beta[inside] * w, rcond=None)[0][0]
        assert abs(np.clip(fit, 0, 1) - b["s1", "chr1", int(pos[i])]) < 1e-5


def test_low_domains_by_direct_smoothing(spark, wide):
    got = {(r["sample"], r["chrom"], r["start"], r["end"], r["n_cpgs"]) for r in catalog.QUERIES["pmd"](spark, DATA).collect()}
    want = set()
    for (s, c), g in wide[wide.coverage > 0].groupby(["sample", "chrom"]):
        if len(g) < 10:
            continue
        pos, beta, cov = g.pos.to_numpy(float), (g.n_meth / g.coverage).to_numpy(float), g.coverage.to_numpy(float)
        d = np.abs(pos[:, None] - pos)
        w = np.where(d <= 40_000, np.exp(-0.5 * (d / 10_000) ** 2), 0) * cov
        path, _ = sequence.hmm_segment((w * beta).sum(axis=1) / w.sum(axis=1), [0.275, 0.8], 0.999)
        want |= {(s, c, int(a), int(b), k) for a, b, k in runs(path.tolist(), g.pos.tolist(), 0) if b - a >= 2000}
    assert got == want


def test_planted_domains_and_islands(spark):
    rng = np.random.default_rng(42)
    pos = np.sort(rng.choice(5_000_000, 5000, replace=False))
    p = np.where((pos >= 2_000_000) & (pos < 3_000_000), 0.3, 0.85)
    d = spark.createDataFrame([("a", "chr1", int(x), int(m), 20) for x, m in zip(pos, rng.binomial(20, p))], "sample string, chrom string, pos int, n_meth int, coverage int")
    got = sequence.pmd(d).collect()
    inside = sum(max(0, min(r["end"], 3_000_000) - max(r["start"], 2_000_000)) for r in got)
    assert inside > 900_000 and sum(r["end"] - r["start"] for r in got) < 1_200_000
    rng = np.random.default_rng(7)
    pos = np.unique(np.concatenate([np.arange(1000, 90_000, 400), np.linspace(5000, 5500, 50).astype(int), np.linspace(49_000, 51_800, 8).astype(int)]))
    low = ((pos >= 5000) & (pos <= 5500)) | ((pos >= 49_000) & (pos <= 51_800))
    d = spark.createDataFrame([("a", "chr1", int(x), int(m), 25) for x, m in zip(pos, rng.binomial(25, np.where(low, 0.03, 0.85)))], "sample string, chrom string, pos int, n_meth int, coverage int")
    kinds = {(r["kind"], 4500 < r["start"] < 6000, 48_000 < r["start"] < 52_000) for r in sequence.hmr(d).collect()}
    assert ("HMR", True, False) in kinds and ("LMR", False, True) in kinds


def test_regions_by_states_of_the_difference(spark):
    got = {(r["chrom"], r["start"], r["end"], r["dmr_type"]) for r in catalog.QUERIES["dmr_hmm"](spark, DATA).collect()}
    want = set()
    for c, g in V.results(spark, DATA).toPandas().sort_values("pos").groupby("chrom"):
        if len(g) < 5:
            continue
        diff, q, pos = g.meth_diff.to_numpy(float), g.qvalue.to_numpy(), g.pos.tolist()
        path, _ = sequence.hmm_segment(diff, [-0.2, 0.0, 0.2], 0.95, "gaussian", 0.1)
        for state, name in ((0, "hypo"), (2, "hyper")):
            for a, b, n in runs(path.tolist(), pos, state):
                at = pos.index(a)
                if n >= 5 and abs(diff[at : at + n].mean()) >= 0.05 and q[at : at + n].mean() < 0.9:
                    want.add((c, a, b, name))
    assert got == want


def newton(m, n, x):
    """(coefficients, covariance) of a binomial fit of one site, by Newton's method on the likelihood."""
    b = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x, x.T @ (m - n * p))
    return b, np.linalg.inv((x * (n * p * (1 - p))[:, None]).T @ x), p


def test_regression_against_newton(spark, wide):
    got = {(r["chrom"], r["pos"]): r for r in catalog.QUERIES["dmc_glm"](spark, DATA).collect()}
    joint = {(r["chrom"], r["pos"]): r for r in catalog.QUERIES["dmc_contrast"](spark, DATA).collect()}
    x = np.array([[1.0, s in V.CASE, 20 + 7 * i] for i, s in enumerate(V.SAMPLES)])
    done = 0
    for key, g in wide.groupby(["chrom", "pos"]):
        case = g["sample"].isin(V.CASE)
        if len(g) < 5 or case.sum() < 2 or (~case).sum() < 2 or (g.n_meth == 0).any() or (g.n_meth == g.coverage).any():
            continue
        at = [V.SAMPLES.index(s) for s in g["sample"]]
        m, n, own = g.n_meth.to_numpy(float), g.coverage.to_numpy(float), x[at]
        (b, cov, p), (_, _, p0) = newton(m, n, own), newton(m, n, own[:, [0, 2]])
        ll = lambda p: (m * np.log(p) + (n - m) * np.log(1 - p)).sum()
        phi = max(1.0, (n * (m / n - p) ** 2 / (p * (1 - p))).sum() / max(len(g) - 3, 1))
        stat, r = 2 * (ll(p) - ll(p0)) / phi, got[key]
        df = max(len(g) - 3, 1)
        pv = special.f_sf(np.array([stat]), 1.0, np.array([df]))[0] if phi > 1 else special.chi2_sf(np.array([stat]))[0]
        assert np.allclose([r["coef"], r["coef_se"], r["phi"], r["stat"], r["pvalue"]], [b[1], np.sqrt(cov[1, 1] * phi), phi, stat, pv], atol=2e-4), key
        c = np.array([0.0, 1.0, -1.0])
        assert abs(joint[key]["stat"] - (c @ b) ** 2 / (c @ cov @ c) / phi) < 2e-4 * max(1, abs(joint[key]["stat"]))
        done += 1
    assert done >= 5


def test_two_group_regression_in_closed_form(spark, sites):
    got = {(r["chrom"], r["pos"]): r for r in catalog.QUERIES["dmc_bb_lr"](spark, DATA).collect()}
    x = tests.raw_statistics(tests.with_dispersion(tests.accumulate(sites, F.col("sample").isin(V.CASE)))).collect()
    done = 0
    for r in x:
        if r["both"] and 0.02 < r["pi_a"] < 0.98 and 0.02 < r["pi_b"] < 0.98:
            g = got[r["chrom"], r["pos"]]
            if g["coef"] is None:  # a fit that the bound of the linear predictor ended
                continue
            coef = np.log(r["pi_a"] / (1 - r["pi_a"])) - np.log(r["pi_b"] / (1 - r["pi_b"]))
            assert abs(g["coef"] - coef) < 1e-4 and abs(g["stat"] * g["phi"] - r["lr_raw"]) < 1e-3 * max(1, r["lr_raw"])
            lo, hi = g["meth_diff_ci_lo"], g["meth_diff_ci_hi"]
            assert lo <= r["pi_a"] - r["pi_b"] + 1e-5 and r["pi_a"] - r["pi_b"] <= hi + 1e-5
            done += 1
    assert done > 50


def test_fit_dispersion_modes(spark):
    rng = np.random.default_rng(1)
    rows = [("c1", i, 6, float(rng.gamma(4, 4))) for i in range(150)] + [("c2", i, 6, float(rng.gamma(4, 4))) for i in range(20)] + [("c2", 99, 6, None)]
    fits = spark.createDataFrame(rows, "chrom string, pos int, df_resid int, _pearson double")
    site = {(c, p): max(1.0, (x or 0) / d) for c, p, d, x in rows}
    own = [site["c1", i] for i in range(150)]
    chrom = {"c1": max(1.0, sum(r[3] for r in rows[:150]) / 900), "c2": 1.0}
    w = {"c1": max(1.0, 2 * (np.mean(own) ** 2 / np.var(own) + 2)), "c2": 4.0}
    for mode in ("site", "chrom", "shrink", "eb"):
        for r in models.with_fit_dispersion(fits, mode).collect():
            s, c = site[r["chrom"], r["pos"]], chrom[r["chrom"]]
            k = w[r["chrom"]] if mode == "eb" else 4.0
            want = {"site": s, "chrom": c}.get(mode, c if r["_pearson"] is None else max(1.0, (6 * s + k * c) / (6 + k)))
            assert abs(r["phi"] - want) < 1e-9


def test_deconvolution_is_the_least_squares_optimum(spark, wide):
    got = {}
    for r in catalog.QUERIES["deconvolve"](spark, DATA).collect():
        got.setdefault(r["sample"], {})[r["cell_type"]] = r["proportion"]
    for s, g in wide[wide.coverage > 0].groupby("sample"):
        a = np.stack([(g.pos % k) / k for k in (700, 1100, 1300)], axis=1).astype(float)
        x = np.array([got[s][t] for t in ("t1", "t2", "t3")])
        assert (x >= 0).all() and abs(x.sum() - 1) < 1e-5
        b = (g.n_meth / g.coverage).to_numpy(float)
        scale = (b @ a @ x) / (x @ a.T @ a @ x)  # proportions are the fit, scaled
        grad = a.T @ (b - a @ (scale * x))
        assert (grad <= 1e-3 * abs(a.T @ b).max()).all() and (np.abs(grad[x > 1e-6]) <= 1e-3 * abs(a.T @ b).max()).all()


def test_coordinates_against_a_decomposition(spark, wide):
    got = {r["sample"]: r for r in catalog.QUERIES["pca"](spark, DATA).collect()}
    m = wide.assign(b=wide.n_meth / wide.coverage).pivot_table(index=["chrom", "pos"], columns="sample", values="b").dropna()
    x = (m.sub(m.mean(axis=1), axis=0)).to_numpy().T
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    for k in (0, 1):
        ours = np.array([got[n][f"pc{k + 1}"] for n in m.columns])
        assert np.allclose(np.abs(ours), np.abs(u[:, k] * s[k]), atol=1e-5) and abs(abs(ours @ u[:, k]) - s[k]) < 1e-4


def test_intervals_and_power(spark):
    from cytoframe.functions import columns as C

    d = spark.createDataFrame([(56, 70, 48, 80)], "a int, n int, b int, m int")
    lo, hi = C.newcombe_ci(*(F.col(c) for c in "anbm"))
    r = d.select(lo.alias("lo"), hi.alias("hi")).first()
    assert abs(r["lo"] - 0.0524) < 1e-4 and abs(r["hi"] - 0.3339) < 1e-4  # the published example of the method
    lo, hi = C.delta_ci(F.lit(1.0), F.lit(0.5), 0.0)
    r = d.select(lo.alias("lo"), hi.alias("hi")).first()
    assert abs(r["hi"] - (1 / (1 + np.exp(-1 - 0.5 * 1.959963984540054)) - 0.5)) < 1e-12 and r["lo"] < r["hi"]
    assert qc.power(0.4, 20, n_per_group=4) > qc.power(0.2, 20, n_per_group=4) > 0.05
    n = qc.power(0.1, 20, power=0.8)
    assert qc.power(0.1, 20, n_per_group=int(n)) >= 0.8 > qc.power(0.1, 20, n_per_group=int(n) - 1)


def test_tails_by_values_in_rows(spark):
    from cytoframe.functions import columns as C

    d = spark.createDataFrame([(3, 10, 0.2), (3, 10, 0.6)], "k int, n int, p double").coalesce(1)
    got = [r[0] for r in d.select(C.binomial_tail("k", "n", "p")).collect()]
    want = [sum(float(np.prod(np.arange(10 - j + 1, 11)) / np.prod(np.arange(1, j + 1) if j else [1])) * p**j * (1 - p) ** (10 - j) for j in range(3, 11)) for p in (0.2, 0.6)]
    assert np.allclose(got, want)
    assert special.fisher_two_sided([3], [1], [1], [3])[0] == pytest.approx(34 / 70)  # the lady's tea


def test_linkage_orders():
    x = np.array([0.0, 10.0, 0.4, 10.3, 5.0])
    order = profiles.average_linkage(np.abs(x[:, None] - x))
    assert sorted(order) == [0, 1, 2, 3, 4] and abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1
    assert profiles.average_linkage(np.zeros((0, 0))) == [] and profiles.average_linkage(np.zeros((1, 1))) == [0]


def test_clustered_orders(spark, sites):
    c = qc.sample_correlation(sites, V.SAMPLES)
    assert sorted(profiles.clustered_samples(c, V.SAMPLES)) == V.SAMPLES
    m = profiles.region_matrix(sites, V.regions(spark, DATA), V.SAMPLES)
    assert len(profiles.clustered_regions(m, V.SAMPLES, 30)) == min(30, m.count())


def test_hot_p_values_and_nulls(spark):
    d = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 1.0D WHEN id % 7 = 1 THEN null ELSE (id + 1) / 6000.0D END AS pvalue")
    got = fdr.adjust(d).collect()
    p = np.array([1.0 if r["pvalue"] is None else r["pvalue"] for r in got])
    rank = (p[:, None] >= p[None, :]).sum(axis=1)
    raw = p * len(p) / rank
    want = np.array([min(1.0, raw[p >= v].min()) for v in p])
    assert len(got) == 5000
    for r, w in zip(got, want):
        assert r["qvalue"] is None if r["pvalue"] is None else abs(r["qvalue"] - w) < 1e-9


def test_a_site_s_fit_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(7)
    n = rng.integers(1, 40, (30, 6))
    m = rng.binomial(n, rng.random((30, 1)))
    x = np.stack([np.ones(6), [1, 1, 1, 0, 0, 0], rng.random(6)], axis=1)
    whole = models.irls(m, n, x)
    for i in range(30):
        one = models.irls(m[i : i + 1], n[i : i + 1], x)
        assert np.allclose(one["beta"][0], whole["beta"][i], equal_nan=True, rtol=1e-12, atol=1e-12)


def test_formulas():
    obs = [{"treatment": i % 2, "age": 20.0 + i, "donor": "abc"[i % 3], "n": i + 1} for i in range(12)]
    names, x = models.design(obs, "~ treatment * donor + log(age)")
    assert names == ["Intercept", "treatment", "donor[T.b]", "donor[T.c]", "log(age)", "treatment:donor[T.b]", "treatment:donor[T.c]"]
    assert np.allclose(x[:, 4], np.log([o["age"] for o in obs])) and np.allclose(x[:, 5], x[:, 1] * x[:, 2])
    assert models.design(obs, "~ treatment * donor - treatment:donor")[0] == ["Intercept", "treatment", "donor[T.b]", "donor[T.c]"]
    names, x = models.design(obs, "~ 0 + donor + I(age ** 2) + np.sqrt(n) + center(age)", ["treatment"])
    assert names == ["donor[a]", "donor[b]", "donor[c]", "I(age ** 2)", "np.sqrt(n)", "center(age)", "treatment"]
    assert (x[:, :3].sum(axis=1) == 1).all() and np.allclose(x[:, 3], [o["age"] ** 2 for o in obs]) and abs(x[:, 5].sum()) < 1e-9
    assert models.design(obs, "treatment - 1")[0] == ["treatment"] and models.design(obs, "~ treatment", ["treatment", "age"])[0] == ["Intercept", "treatment", "age"]
    assert models.design(obs, "~ C(n) - C(n) + treatment")[0] == ["Intercept", "treatment"]
    for bad, why in (("~ treatment + nothing", "no column"), ("~ bs(age)", "not understood"), ("~ age ^ 2", "not understood"), ("~ 0", "without terms")):
        with pytest.raises(ValueError, match=why):
            models.design(obs, bad)
    with pytest.raises(ValueError, match="missing"):
        models.design([*obs, {"treatment": 1, "age": None, "donor": "a", "n": 3}], "~ age")
